"""The five batch commands: universe, update, scan, validate, report.

Downloads are files of the same contract: pipe-separated listings, a folder of <symbol>.csv, a folder of the reserve source.
"""

from __future__ import annotations

import argparse
import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.operators import anomalies, calendar, evidence, features, ingest, portfolio, report, scoring, simulation
from barline.sources import feeds, html_tables, shared, state, store, universe
from barline.sources.batches import register
from barline.sources.versions import VersionedStore


def _bars(spark: SparkSession, path: str) -> DataFrame:
    rows = ingest.quality_filter(VersionedStore(spark, path, store.BAR_SCHEMA).read())
    rows = calendar.trim_incomplete(calendar.business_days(rows))
    return calendar.with_sessions(rows.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")}))


def run_universe(spark: SparkSession, a: argparse.Namespace) -> None:
    """The union of macro series, listing, pages of European indices and pairs, and its snapshot of the day; groups without a symbol are told."""
    sources = {"macro": feeds.macro(spark)}
    if a.listing:
        sources["us"] = universe.listed(spark, a.listing, "US")
    if a.eu_pages and not a.no_eu:
        sources["eu"] = html_tables.listed_pages(spark, a.eu_pages)
    if a.pairs and not a.no_crypto:
        sources["crypto"] = universe.crypto(universe.read_pairs(spark, a.pairs), a.quote, a.most_pairs)
    rows, missing = universe.build(sources)
    state.write_state(rows, a.universe)
    state.save_universe(rows, f"{a.universe}-snapshots", a.today)
    unasked = {g for g, out in (("equity_eu", a.no_eu), ("crypto", a.no_crypto)) if out}
    for (grp,) in missing.where(~F.col("grp").isin(*unasked)).collect():  # of the eight groups
        print(f"no symbol in group {grp}")


def _feed(spark: SparkSession, a: argparse.Namespace, plan: DataFrame) -> DataFrame:
    """Bars of the planned symbols from their own start on; what a first pass lacked is asked for once more."""
    register(spark)
    earliest = plan.agg(F.min("start").alias("start")).first().start
    files = spark.read.format("bar_files").option("path", a.feed).load()
    files = files.where(F.col("date") >= F.lit(earliest)) if earliest else files
    asked = lambda p: files.join(p.select("symbol", "start"), "symbol").where("start is null or date >= start").drop("start")
    first = shared.saved(asked(plan), "first-pass")
    lacking = plan.join(first.select("symbol").distinct(), "symbol", "left_anti")
    return first.unionByName(shared.saved(asked(lacking), "second-pass"))


def run_update(spark: SparkSession, a: argparse.Namespace) -> None:
    """The planned history of each symbol from the feed, what it lacks from the reserve; a version of the store with poor coverage is never made.

    Every ``--refresh-days`` days, or with ``--full``, whole histories replace the stored ones and the screens of whole series apply; on the days
    between, bars since seven days before the last one are merged. Marks and failures are written after the store: a stop in between asks again.
    """
    listed = spark.read.option("header", True).csv(a.universe).select("symbol", "grp")
    bars = VersionedStore(spark, a.store, store.BAR_SCHEMA)
    old, failed = bars.read(), state.read_failed(spark, f"{a.store}-failed")
    marks = state.read_marks(spark, f"{a.store}-marks")
    full = a.full or state.reload_due(bars.notes().get("reloaded_on"), a.today, a.refresh_days)
    begin = F.coalesce(F.lit(a.start or None).cast("date"), F.add_months(F.lit(a.today).cast("date"), -12 * a.years))
    plan = ingest.plan_downloads(listed, old, marks, a.today).join(ingest.not_worth_asking(failed, a.today), "symbol", "left_anti")
    plan = plan.join(ingest.last_dates(old), "symbol", "left")
    plan = plan.orderBy("symbol").limit(a.limit) if a.limit else plan
    start = F.when((F.col("plan") == "recent") & F.lit(not full), F.date_sub("last_date", 7)).otherwise(begin)
    plan = shared.saved(plan.select("symbol", "plan", start.alias("start")), "plan")
    got = _feed(spark, a, plan).join(listed, "symbol").select(*old.columns)
    if a.reserve:
        lacking = plan.join(got.select("symbol").distinct(), "symbol", "left_anti").select("symbol")
        more, reasons = feeds.reserve(spark, a.reserve, lacking, a.start)
        got = got.unionByName(ingest.splice(more.join(listed, "symbol"), old).select(*old.columns))
        print({r.reason: r.symbols for r in reasons.collect()})
    got = shared.saved(store.coerce(got).where("close > 0 and high >= low").select(*old.columns), "bars")
    told = ingest.download_summary(got, plan, old).first().asDict()
    print(told)
    gate = lambda rows: ingest.check_coverage(rows, listed, a.min_coverage)
    if told["verdict"] == "nothing":
        print("the store stays as it is")
    elif full or not bars.versions():
        kept = ingest.prune(ingest.quality_filter(ingest.replace_refreshed(old, got)), listed)
        bars.replace(store.clean(kept.withColumn("_sequence", F.lit(0)), "_sequence").drop("_sequence"), {"reloaded_on": a.today}, gate)
    else:
        bars.merge(got, gate=gate)
    answered = got.select("symbol").distinct()
    asked_on = marks.unionByName(plan.where("plan = 'full'").select("symbol", F.to_date(F.lit(a.today)).alias("asked_on"))).groupBy("symbol").agg(F.max("asked_on").alias("asked_on"))
    failures = ingest.count_failures(failed, plan, answered, a.today)
    for name, rows in (("marks", shared.saved(asked_on, "marks")), ("failed", shared.saved(failures, "failed"))):  # they read what they replace
        state.write_state(rows, f"{a.store}-{name}")
    bars.vacuum(a.keep_versions)
    if not a.no_freshness:
        calendar.check_freshness(bars.read(), a.today, a.max_late)


def run_scan(spark: SparkSession, a: argparse.Namespace) -> None:
    bars = _bars(spark, a.store)
    dates = calendar.rebalance_dates(bars, a.period, min_days=400, last=a.history_months)
    found = anomalies.detect(bars, a.min_dollar_volume)
    panel = features.sample_panel(features.build_features(bars), dates, a.min_dollar_volume)
    state.save_stage({"anomalies": found}, a.out_dir)
    panel = anomalies.apply_quarantine(panel, spark.read.parquet(f"{a.out_dir}/anomalies"))
    state.save_stage({"panel": panel}, a.out_dir)
    panel = spark.read.parquet(f"{a.out_dir}/panel")
    state.save_stage({"scores": scoring.score_panel(panel), "forward": features.forward_returns(bars)}, a.out_dir)
    listed = spark.read.option("header", True).csv(a.universe)
    scored = spark.read.parquet(f"{a.out_dir}/scores").where("score_global is not null")
    state.save_stage({"funnel.csv": report.funnel(listed, bars, panel, scored)}, a.out_dir)


def run_validate(spark: SparkSession, a: argparse.Namespace) -> None:
    scored, forward = spark.read.parquet(f"{a.out_dir}/scores"), spark.read.parquet(f"{a.out_dir}/forward")
    said = None
    for h, n in features.HORIZONS.items():
        ic = evidence.information_coefficient(scored, forward, h)
        rows = evidence.verdict(evidence.ic_summary(ic, evidence.overlap(n)).withColumn("horizon", F.lit(h)))
        said = rows if said is None else said.unionByName(rows)
        spread = evidence.decile_spread(evidence.with_decile(scored, forward, h))
        state.save_stage({f"net_{h}.csv": evidence.net_of_costs(spread, evidence.turnover(scored, h), a.cost_bps)}, a.out_dir)
    state.save_stage({"verdict": said}, a.out_dir)
    state.save_stage({"verdict.csv": spark.read.parquet(f"{a.out_dir}/verdict")}, a.out_dir)


def _portfolio_sections(spark: SparkSession, a: argparse.Namespace, bars: DataFrame, listed: DataFrame) -> list[str]:
    """What the portfolios hold in euros, their returns, fills and dropped orders; nothing where no day is done."""
    done = simulation.days(spark, a.portfolio_dir)
    if not done:
        return []
    books = simulation.load(spark, a.portfolio_dir, done[-1])
    money = listed.select("symbol", "currency" if "currency" in listed.columns else F.lit("USD").alias("currency"))
    prices = portfolio.in_euros(bars, money, portfolio.rates_of(bars))
    closes = prices.join(F.broadcast(prices.agg(F.max("date").alias("date"))), "date", "left_semi")  # one row
    one = F.col("broker") == next(iter(portfolio.BROKERS))  # all brokers hold the same; costs differ
    held = report.composition(books.positions.where(one), closes, books.books.where(one)).orderBy("scenario", F.desc("value"), "symbol")
    state.save_stage({"composition.csv": held}, a.portfolio_dir)
    curve, fills = (simulation.ledger(spark, a.portfolio_dir, t) for t in ("curve", "fills"))
    bench = simulation.benchmark(prices, done[0], a.benchmark).select("date", "value")
    tables = {f"Returns, {n} days": report.period_of_books(curve, bench, n).orderBy("scenario", "broker") for n in (30, 90, 365)}
    tables |= {"Composition": held, "Trades": fills.orderBy(F.desc("date"), "scenario", "broker", "symbol"), "Dropped orders": books.dropped.orderBy("scenario", "broker", "symbol")}
    tables["Saved by dropping"] = report.savings(books.dropped, books.books).orderBy("scenario", "broker")
    return [report.section(name, rows) for name, rows in tables.items()]


def run_report(spark: SparkSession, a: argparse.Namespace) -> None:
    """A page of short tables. A symbol that moves with a better placed one is marked; its year is drawn beside it."""
    scored, panel, said = (spark.read.parquet(f"{a.out_dir}/{t}") for t in ("scores", "panel", "verdict"))
    listed = spark.read.option("header", True).csv(a.universe)
    bars = shared.saved(_bars(spark, a.store), "bars", by="symbol")
    tables = {"Overview": report.tiles(scored, listed, spark.read.parquet(f"{a.out_dir}/anomalies")), "Evidence": said}
    tables["Scores"] = report.histogram(report.report_rows(scored, panel), "score_global").orderBy("bin")
    rows = report.report_rows(scored, panel)
    for h in features.HORIZONS:
        order = [F.desc_nulls_last(f"pct_{h}"), F.desc_nulls_last(f"score_{h}"), "symbol"]
        best = shared.saved(scoring.report_ranking(rows, h, a.top).withColumn("place", F.row_number().over(Window.orderBy(*order))), "ranking")  # the list only
        twins = scoring.redundant(bars, best, max_corr=a.max_corr).select("symbol", F.col("twin").alias("moves_with"))
        lines = report.sparkline(bars).join(best.select("symbol"), "symbol", "left_semi").select("symbol", report.drawn(F.col("points")).alias("year"))
        tables[f"Ranking, {h}"] = best.join(twins, "symbol", "left").join(lines, "symbol", "left").orderBy("place")
        if not a.no_comments:
            parts = scoring.contributions(panel, scoring.WEIGHTS[h]).join(best.select("symbol"), "symbol", "left_semi")
            tables[f"Comments, {h}"] = report.comments(parts).join(best.select("symbol", "place"), "symbol").where(F.col("place") <= a.comment_top).orderBy("place")
    sections = [report.section(name, rows) for name, rows in tables.items()]
    if not a.no_portfolio:
        weights = {r.horizon: r.weight for r in evidence.evidence_weights(said).collect()}
        best = portfolio.expected_alpha(scored, said, bars, weights).orderBy(F.desc("alpha"), "symbol").limit(a.top)
        sections.append(report.section("Expected alpha", best))
        try:
            sections += _portfolio_sections(spark, a, bars, listed)
        except Exception:
            if not a.portfolio_optional:
                raise
            traceback.print_exc()  # told in full; the rest of the report stands
    text = report.page("Ranking of series", sections)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out_dir}/report")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("barline")
    p.add_argument("--store", default="data/bars")
    p.add_argument("--universe", default="data/universe")
    p.add_argument("--out-dir", default="out")
    p.add_argument("--today", required=True, help="ISO date; commands never look at the clock")
    commands = p.add_subparsers(required=True)

    def command(name: str, run: Callable, **options: object) -> None:
        c = commands.add_parser(name, help=run.__doc__)
        c.set_defaults(run=run)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if default is False:
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, default=default, type=type(default))

    command("universe", run_universe, listing="", eu_pages="", pairs="", quote="USDT", most_pairs=300, no_eu=False, no_crypto=False)
    command("update", run_update, feed="feed", reserve="", start="", years=8, limit=0, full=False, refresh_days=30, min_coverage=75.0, keep_versions=2, max_late=2, no_freshness=False)
    command("scan", run_scan, period="month", history_months=96, min_dollar_volume=1e6)
    command("validate", run_validate, cost_bps=10.0)
    command("report", run_report, top=30, comment_top=12, max_corr=0.8, no_comments=False, no_portfolio=False, portfolio_optional=False, portfolio_dir="portfolio", benchmark="SPY")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a)


if __name__ == "__main__":
    main()
