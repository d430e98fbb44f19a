"""Feeds, small state, and the daily step of the portfolios on hand-made tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from barline import cli
from barline.operators import ingest, portfolio, report, simulation
from barline.sources import feeds, state, store
from barline.sources.versions import VersionedStore

DAYS = [datetime.date(2024, 1, 1) + datetime.timedelta(days=k) for k in range(12)]


def prices(spark, upto):
    rows = [(s, d, 10.0 + k + j, 10.5 + k + j) for j, s in enumerate(("A", "B", "C")) for k, d in enumerate(DAYS) if not (s == "C" and k == 1)]
    rows = [(s, d, None if s == "B" and d == DAYS[1] else o, c) for s, d, o, c in rows]
    return spark.createDataFrame(rows, "symbol string, date date, open double, close double").where(F.col("date") <= str(upto))


def test_days_of_the_portfolios(spark, tmp_path):
    folder = f"file://{tmp_path}/sim"
    groups = spark.createDataFrame([("A", "equity_us"), ("B", "etf")], "symbol string, grp string")
    alphas = spark.createDataFrame([("A", 0.3), ("B", 0.2), ("C", 0.1)], "symbol string, alpha double")
    both = {s: alphas for s in portfolio.SCENARIOS}

    def step(day, names):
        return simulation.step(spark, folder, str(day), prices(spark, day), groups, {"short": names}, both)

    first = step(DAYS[0], ["A", "B", "C"])
    assert first.positions.count() == 0 and first.pending.count() == 6  # short, with each broker
    again = step(DAYS[0], ["A"])
    assert again.pending.count() == 6 and simulation.days(spark, folder) == [str(DAYS[0])]
    second = step(DAYS[1], ["A"])
    held = {(r.broker, r.symbol): r for r in second.positions.collect()}
    assert {k[1] for k in held} == {"A", "B"} and second.pending.count() == 0  # C has no price, and is not tried twice; no rebalance within the week
    a = held["trade_republic", "A"]
    order = first.pending.where("broker = 'trade_republic' and symbol = 'A'").first().amount
    assert a.units == pytest.approx((order - 1) / (11.0 * (1 + 15 / 2e4))) and a.cost == pytest.approx(order - 1)
    b = held["trade_republic", "B"]
    assert b.units == pytest.approx(b.cost / (12.5 * (1 + 8 / 2e4)))  # at the close: it had no open
    books = {(r.scenario, r.broker): r for r in second.books.collect()}
    assert books["short", "etoro"].cash >= 0 and books["long", "etoro"].cash == portfolio.CAPITAL * 0.995
    curve = {(str(r.date), r.scenario, r.broker): r for r in simulation.ledger(spark, folder, "curve").collect()}
    assert len(curve) == 16 and 0.9 * portfolio.CAPITAL < curve[str(DAYS[1]), "short", "trade_republic"].value < 1.2 * portfolio.CAPITAL
    third = step(DAYS[7], ["C"])
    assert {(r.symbol, r.side) for r in third.pending.where("broker = 'trade_republic'").collect()} >= {("C", "purchase")}
    fills = simulation.ledger(spark, folder, "fills")
    assert fills.count() == 4 and {r.side for r in fills.collect()} == {"purchase"}
    saved = report.savings(third.dropped, third.books)
    assert saved.count() == 8 and saved.where("scenario = 'short' and saved >= 0").count() == 2
    with pytest.raises(ValueError):
        step(DAYS[3], ["A"])


def test_purchases_go_by_rank_while_cash_lasts(spark):
    """Cash for 1.3 of three orders: it goes to the best placed symbols, whatever their names."""
    book = ("short", "etoro")
    state_ = simulation.start(spark)
    cash = state_.books.withColumn("cash", F.when((F.col("scenario") == book[0]) & (F.col("broker") == book[1]), 13_000.0).otherwise(F.col("cash")))
    ranked = ["ZZZ", "MMM", "AAA"]
    pending = spark.createDataFrame([(*book, s, "purchase", 10_000.0, DAYS[0], k) for k, s in enumerate(ranked)], simulation.PENDING)
    quotes = spark.createDataFrame([(s, d, 10.0, 10.0) for s in ranked for d in DAYS[:2]], "symbol string, date date, open double, close double")
    groups = spark.createDataFrame([(s, "etf") for s in ranked], "symbol string, grp string")
    _, fills = simulation.fill(simulation.State(cash, state_.positions, pending, state_.dropped), quotes, groups, str(DAYS[1]))
    assert {r.symbol: r.amount for r in fills.collect()} == {"ZZZ": 10_000.0, "MMM": 3_000.0}


def test_best_target_of_equal_alphas_is_the_first_by_name(spark):
    held = spark.createDataFrame([("OLD", 5000.0)], "symbol string, cost double")
    targets = spark.createDataFrame([("B",), ("A",)], "symbol string")
    alphas = spark.createDataFrame([("A", 0.02), ("B", 0.02), ("OLD", 0.0)], "symbol string, alpha double")
    avoided = set()
    for groups in ([("A", "crypto"), ("B", "etf")], [("B", "etf"), ("A", "crypto")]):
        plan = portfolio.plan_orders(held, targets.repartition(3), alphas, spark.createDataFrame(groups, "symbol string, grp string"), 40000.0, "trade_republic")
        avoided |= {(r.decision, r.avoided) for r in plan.where("symbol = 'OLD'").collect()}
    assert len(avoided) == 1


def test_benchmark_waits_for_an_open(spark):
    out = simulation.benchmark(prices(spark, DAYS[4]), str(DAYS[0]), "A").orderBy("date").collect()
    units = (portfolio.CAPITAL - 1) / (11.0 * (1 + 8 / 2e4))
    assert [r.date for r in out] == DAYS[1:5] and out[0].value == pytest.approx(units * 11.5, abs=0.01)
    assert simulation.benchmark(prices(spark, DAYS[4]), str(DAYS[0]), "B").count() == 0


def test_selection_by_quotas(spark):
    n = 24
    rows = [(DAYS[0], f"s{k:02}", "G", float(k), float(k), float(n - k), float(n - k)) for k in range(n)] + [(DAYS[0], "alone", "H", 99.0, 99.0, 99.0, 99.0)]
    scored = spark.createDataFrame(rows, "date date, symbol string, grp string, score_short double, pct_short double, score_long double, pct_long double")
    bars = spark.createDataFrame([(f"s{k:02}", i + 1, 100.0 + ((i * (k * 7 + 3)) % 13), 10.0) for k in range(n) for i in range(60)], "symbol string, sess int, close double, volume double")
    bad = spark.createDataFrame([("s23",)], "symbol string")
    got = simulation.select(scored, bad, bars, 4, {"short": 0.25, "long": 0.75})
    assert len(got) == 4 and got[0] == "s00" and "s23" not in got and "alone" not in got
    assert got[3] > "s15"  # the best of the short horizon that is no bet twice


def test_feeds(spark, tmp_path):
    feeds.register(spark)
    (tmp_path / "BTC").mkdir()
    row = lambda k: f"{k * 86400000},1,2,0.5,{k},3"
    head = "ts,open,high,low,close,volume\n"
    (tmp_path / "BTC" / "page-00000.csv").write_text(head + "\n".join(row(k) for k in (0, 1, 2)))
    (tmp_path / "BTC" / "page-00001.csv").write_text(head + "\n".join(row(k) for k in (2, 3)))
    (tmp_path / "BTC" / "page-00002.csv").write_text(head + row(9))
    out = spark.read.format("paged_candles").option("path", str(tmp_path)).option("symbols", "BTC,ETH").option("page", 3).option("start_ms", 86400000).load()
    assert sorted((str(r.date), r.close) for r in out.collect()) == [("1970-01-02", 1.0), ("1970-01-03", 2.0), ("1970-01-04", 3.0)]
    venues = spark.createDataFrame([(0, "a", "USDT", False), (1, "b", "USD", True), (2, "c", "USD", True)], "place int, venue string, quote string, reachable boolean")
    assert [tuple(r) for r in feeds.first_venue(venues).collect()] == [("b", "USD")] and feeds.first_venue(venues.where("place = 0")).count() == 0
    reserve = tmp_path / "reserve"
    reserve.mkdir()
    for name, text in {"aaa.us": "2024-01-02,1,2,1,1.5,10\n2023-01-02,1,2,1,1,10\nbad,1,2,1,1,1", "old.us": "2020-01-02,1,2,1,1.5,10", "nil.us": "x,,,,,"}.items():
        (reserve / f"{name}.csv").write_text("Date,Open,High,Low,Close,Volume\n" + text + "\n")
    symbols = spark.createDataFrame([(s,) for s in ("AAA", "OLD", "NIL", "GONE", "^VIX")], "symbol string")
    bars, reasons = feeds.reserve(spark, str(reserve), symbols, "2023-06-01")
    assert [(r.symbol, r.close) for r in bars.collect()] == [("AAA", 1.5)]
    assert {r.reason: r.symbols for r in reasons.collect()} == {"ok": 1, "too old": 1, "no rows": 1, "no file": 1, "not carried": 1}


def test_small_state(spark, tmp_path):
    path = str(tmp_path / "marks")
    assert state.read_marks(spark, path).count() == 0 and state.read_failed(spark, path).count() == 0
    state.write_state(spark.createDataFrame([], state.MARKS), path)
    assert state.read_marks(spark, path).count() == 0
    state.write_state(spark.createDataFrame([("a", "2024-01-01"), ("b", "never")], "symbol string, asked_on string"), path)
    assert [r.symbol for r in state.still_asked(state.read_marks(spark, path), "2024-01-20").collect()] == ["a"]
    state.write_state(spark.createDataFrame([("a", "2024-01-01")], "symbol string, since string"), path)
    assert [r.failures for r in state.read_failed(spark, path).collect()] == [1]
    assert state.reload_due(None, "2024-01-06") and state.reload_due("2023-11-01", "2024-01-06") and not state.reload_due("2024-01-01", "2024-01-06")
    u = feeds.macro(spark).limit(5)
    state.save_universe(u, str(tmp_path / "snap"), "2024-01-01")
    state.save_universe(u.limit(2), str(tmp_path / "snap"), "2024-02-01")
    assert [state.universe_on(spark, str(tmp_path / "snap"), d).count() for d in ("2024-01-15", "2024-02-15")] == [5, 2]


def test_coverage_is_an_error_when_poor(spark):
    bars = spark.createDataFrame([(f"s{k}", d) for k in range(10) for d in DAYS[:5] if k < 5 or d != DAYS[4]], "symbol string, date date")
    listed = spark.createDataFrame([(f"s{k}",) for k in range(10)], "symbol string")
    with pytest.raises(ingest.PoorCoverage):
        ingest.check_coverage(bars, listed)
    assert ingest.check_coverage(bars, listed, 40.0) == 50.0


def test_commands(spark, tmp_path, capsys):
    feed = tmp_path / "feed"
    feed.mkdir()
    (tmp_path / "l.txt").write_text("Symbol|Security Name|ETF\n" + "".join(f"S{k:02}|Name {k}|N\n" for k in range(24)))
    day = datetime.date(2022, 1, 3)
    dates = [d for k in range(800) if (d := day + datetime.timedelta(days=k)).weekday() < 5]
    for k in range(24):
        lines = [f"{d},{p},{p * 1.01},{p * 0.99},{p * 1.002},{100000 + k}" for i, d in enumerate(dates) for p in [100 + ((i * (k + 3) * 7) % 23) / 10 + k]]
        (feed / f"S{k:02}.csv").write_text("date,open,high,low,close,volume\n" + "\n".join(lines) + "\n")
    base = ["--store", f"{tmp_path}/bars", "--universe", f"{tmp_path}/universe", "--out-dir", f"{tmp_path}/out", "--today", str(dates[-1])]
    for command in (["universe", "--listing", str(tmp_path / "l.txt")], ["update", "--feed", str(feed), "--min-coverage", "10.0"], ["scan"], ["validate"]):
        cli.main(base + command)
    book = f"{tmp_path}/portfolio"
    prices = VersionedStore(spark, f"{tmp_path}/bars", store.BAR_SCHEMA).read()
    alphas = spark.createDataFrame([(s, 0.05) for s in ("S01", "S02", "S03")], "symbol string, alpha double")
    for day in dates[-40:-36]:
        simulation.step(spark, book, str(day), prices.where(F.col("date") <= F.lit(day)), prices.select("symbol", "grp").distinct(), {"short": ["S01", "S02", "S03"]}, {"short": alphas})
    report_ = ["report", "--top", "5", "--max-corr", "0.5", "--portfolio-dir", book, "--benchmark", "S00"]
    cli.main(base + report_)
    said = capsys.readouterr().out
    assert "no symbol in group crypto" in said
    assert spark.read.parquet(f"{tmp_path}/out/scores").where("score_short is not null").count() > 0
    page = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/out/report").collect())
    assert "Ranking, short" in page and "S0" in page and "moves_with" in page and "▁" in page
    assert all(f"<h2>{t}" in page for t in ("Composition", "Trades", "Dropped orders", "Returns, 365 days", "Scores"))
    held = {(r.scenario, r.symbol) for r in spark.read.option("header", True).csv(f"{book}/composition.csv").collect()}
    assert {("short", f"S0{k}") for k in (1, 2, 3)} <= held and ("long", "CASH") in held
    assert state.universe_on(spark, f"{tmp_path}/universe-snapshots", "2030-01-01").count() == 152


def test_universe_of_four_sources(spark, tmp_path, capsys):
    (tmp_path / "l.txt").write_text("Symbol|Security Name|ETF\nAAA|Name|N\nTLT|Bonds|Y\n")
    (tmp_path / "eu").mkdir()
    for name, marks in {"dax.DE": ["SAP", "ALV.DE", "AAA.DE"], "ftse.L": ["VOD"]}.items():
        rows = "".join(f"<tr><td>x</td><td>{m}</td></tr>" for m in [*marks, *[f"{name[0]}{k}" for k in range(15)]])
        (tmp_path / "eu" / f"{name}.html").write_text(f"<table><tr><th>Company</th><th>Ticker</th></tr>{rows}</table>")
    (tmp_path / "pairs.csv").write_text("symbol,base,quote,spot,active,quote_volume\nBTC/USDT,BTC,USDT,true,true,9\nETH/USDT,ETH,USDT,true,false,8\nXRP/USDT,XRP,USDT,true,true,x\nBTC/EUR,BTC,EUR,true,true,7\n")
    base = ["--universe", f"{tmp_path}/u", "--today", "2024-01-02", "universe", "--listing", f"{tmp_path}/l.txt", "--eu-pages", f"{tmp_path}/eu", "--pairs", f"{tmp_path}/pairs.csv"]
    read = lambda: {r.symbol: (r.grp, r.currency) for r in spark.read.option("header", True).csv(f"{tmp_path}/u").collect()}
    cli.main(base)
    got = read()
    assert got["TLT"][0] == "bond" and got["AAA"] == ("equity_us", "USD") and got["SAP.DE"] == ("equity_eu", "EUR") and got["VOD.L"] == ("equity_eu", "GBP")
    assert {s for s, (g, _) in got.items() if g == "crypto"} == {"BTC/USDT", "XRP/USDT"} and "AAA.DE" in got and "no symbol" in capsys.readouterr().out  # no ETF is left
    cli.main([*base, "--no-eu", "--no-crypto", "--most-pairs", "1"])
    assert not {g for g, _ in read().values()} & {"crypto", "equity_eu"}
    told = capsys.readouterr().out
    assert "equity_eu" not in told and "crypto" not in told and "etf" not in told.replace("no symbol in group etf", "")
