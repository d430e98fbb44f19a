"""Work and memory of one task stay the same as tables grow."""

from contextlib import redirect_stdout
from io import StringIO

from pyspark.sql import functions as F

from barline.operators import anomalies, evidence, ewm, features, portfolio, scoring
from barline.plans import catalog
from barline.sources import bars as sources
from barline.sources import shared

DATA = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    with redirect_stdout(StringIO()) as out:
        df.explain()
    return out.getvalue()


def market(spark, folder) -> object:
    k = F.col("id")
    rows = spark.range(30 * 150).select((k % 30).alias("symbol"), F.lit("g").alias("grp"), F.expr("date_add(date'2020-01-01', int(id / 30))").alias("date"), (k / 30).cast("int").alias("sess"))
    price = 50 + F.pmod(F.hash("symbol", "sess"), F.lit(1000)) / 100
    rows = rows.where(F.pmod(F.hash("sess", "symbol"), F.lit(11)) != 3).withColumns({"open": price, "high": price + 1, "low": price - 1, "close": price + 0.25, "volume": 100 * price})
    rows.write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def values(df) -> dict:
    return {(x["symbol"], x["date"]): [round(v, 9) if isinstance(v, float) else v for v in x] for x in df.collect()}


def moves(df) -> list[str]:
    """The exchanges of a plan that deal rows by a hash."""
    return [x.strip(" :+-") for x in plan_of(df).splitlines() if "Exchange hashpartitioning" in x]


def test_histories_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    bars = market(spark, tmp_path / "bars")
    one = values(ewm.with_ewm(bars)), values(features.build_features(bars))
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    tasks = -(-bars.count() // 100)
    assert tasks > 8 == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for make, want in zip((ewm.with_ewm, features.build_features), one, strict=True):
        assert values(make(bars)) == want
        assert all(f", {tasks}), REPARTITION_BY_NUM" in x for x in moves(make(bars)) if "symbol" in x) and moves(make(bars))


def test_panels_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    bars = market(spark, tmp_path / "bars")
    panel = features.build_features(bars).where("sess % 10 = 9").select("*")
    one = values(scoring.score_panel(panel))
    monkeypatch.setattr(shared, "PANEL_ROWS_A_TASK", 30)
    scored = scoring.score_panel(panel)
    tasks = -(-panel.count() // 30)
    assert tasks > 8 and values(scored) == one
    assert moves(scored) and all(f", {tasks}), REPARTITION_BY_NUM" in x for x in moves(scored))


def test_panels_are_not_sorted_to_meet_their_quantiles(spark, tmp_path, monkeypatch):
    panel = features.build_features(market(spark, tmp_path / "bars")).where("sess % 10 = 9")
    one = values(scoring.score_panel(panel))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # below the footers of the saved quantiles
    try:
        scored = scoring.score_panel(panel)
        assert plan_of(scored).count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan_of(scored) and values(scored) == one
        monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(shared, "PANEL_ROWS_A_TASK", 30)
        scored = scoring.score_panel(panel)
        tasks = -(-panel.count() // 30)
        assert plan_of(scored).count("SortMergeJoin") == 2 and values(scored) == one
        assert all(f", {tasks}), REPARTITION_BY_NUM" in x for x in moves(scored)) and tasks > 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_and_bars_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    saved = market(spark, tmp_path / "bars")
    one = values(sources.supplier_week(spark, DATA)), values(features.forward_returns(saved))
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    lines = sources.table(spark, DATA, "lineitem").count()
    for made, want, rows in ((sources.supplier_week(spark, DATA), one[0], lines), (features.forward_returns(saved), one[1], saved.count())):
        got = [x for x in moves(made) if "suppkey" in x or "symbol" in x]
        assert values(made) == want and got and all(f", {-(-rows // 100)}), REPARTITION_BY_NUM" in x for x in got)
        assert "SortMergeJoin" not in plan_of(made)


def test_no_task_holds_all_lines_that_it_reads(spark, monkeypatch):
    """Dealt over many tasks, lines would be held as they are read, a whole row group at once; they are spread over few tasks first."""
    lines = sources.table(spark, DATA, "lineitem").count()
    one = values(sources.supplier_week(spark, DATA))
    monkeypatch.setattr(shared, "ROWS_A_TASK", lines // 250)
    tasks = shared.tasks_for(sources.table(spark, DATA, "lineitem"))
    steps = [x for x in moves(sources.supplier_week(spark, DATA)) if "l_orderkey" in x or "l_suppkey" in x]
    assert tasks > 200 and len(steps) == 2
    assert f", {tasks}), REPARTITION_BY_NUM" in steps[0] and "l_orderkey" in steps[1] and ", 200), REPARTITION_BY_NUM" in steps[1]
    monkeypatch.setattr(shared, "ROWS_A_TASK", lines // 20)
    monkeypatch.setattr(shared, "unheld", lambda _: 8)
    assert values(sources.supplier_week(spark, DATA)) == one and any(", 8), REPARTITION_BY_NUM" in x for x in moves(sources.supplier_week(spark, DATA)))


def test_evidence_is_dealt_by_the_number_of_scores(spark, monkeypatch):
    """Ranks of scores and the join with forward returns follow neither the session's partitions nor a broadcast that Spark chooses by the size of files."""
    k = F.col("id")
    rows = spark.range(40 * 30).select(F.expr("date_add(date'2020-01-01', int(id / 40))").alias("date"), (k % 40).alias("symbol"), F.lit("G").alias("grp"))
    scored = rows.withColumn("score_short", F.when(F.col("symbol") % 13 > 0, F.pmod(F.hash("date", "symbol"), F.lit(25)) / 10))
    forward = rows.union(rows.withColumn("date", F.date_add("date", 1000))).select("date", "symbol", (F.pmod(F.hash("symbol", "date"), F.lit(97)) / 100).alias("fwd_short"))

    def made() -> dict:
        return {
            "ic": evidence.information_coefficient(scored, forward, "short", 5),
            "deciles": evidence.with_decile(scored, forward, "short", 5),
        }

    one = {name: sorted(df.collect()) for name, df in made().items()}
    assert all(one.values())
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    tasks = {"ic": -(-scored.where("score_short is not null").count() // 100), "deciles": -(-scored.where("score_short is not null").count() // 100)}
    for name, df in made().items():
        assert sorted(df.collect()) == one[name]
        dealt = [x for x in moves(df) if f", {tasks[name]}), REPARTITION_BY_NUM" in x]
        assert len(dealt) >= 3 and tasks[name] > 8
        assert all("date" in x and "symbol" not in x and "grp" not in x for x in moves(df) if x not in dealt)  # by the session's own partitions: the dates


def test_screening_and_volatility_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    bars = market(spark, tmp_path / "bars")
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    dealt = f", {-(-bars.count() // 100)}), REPARTITION_BY_NUM"
    found = portfolio.annual_volatility(bars)
    assert moves(found) and all(dealt in x for x in moves(found))
    assert any(dealt in x for x in moves(anomalies.detect(bars)))


def test_blocks_end_with_their_last_session(spark):
    """The windows over blocks share a sort by session within a block; by block alone, the last row is left to chance."""
    rows = spark.range(100).selectExpr("id % 5 as symbol", "id as sess", "1.0D as close", "2.0D as high", "0.5D as low")
    assert not [x for x in plan_of(ewm.indicators(rows)).splitlines() if "Sort [" in x and "_b#" in x and "sess" not in x]


def test_orders_are_not_computed_anew_for_each_book(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_alphas", lambda spark, d: spark.createDataFrame([(k, (50 - k) / 100) for k in range(1, 101)], "symbol long, alpha double"))
    assert "CartesianProduct" not in plan_of(catalog.execute_orders(spark, DATA))


def test_fills_of_books_that_span_batches(spark):
    rows = [(s, "etoro", f"{k:03}", "sale" if k % 5 == 0 else "purchase", 90.0, 2.0, 10.0, 1.0, 0.0, k) for s in ("long", "short") for k in range(40)]
    orders = spark.createDataFrame(rows, "scenario string, broker string, symbol string, side string, amount double, units_held double, price double, fee double, half_spread double, turn int")
    cash = spark.createDataFrame([("long", "etoro", 1000.0), ("short", "etoro", 100.0)], "scenario string, broker string, cash double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = portfolio.execute(orders, cash).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for book, money in (("long", 1000.0), ("short", 100.0)):
        mine, want = sorted((x for x in got if x.scenario == book), key=lambda x: x.place), []
        for k in [k for k in range(40) if k % 5 == 0] + [k for k in range(40) if k % 5]:
            amount = 20.0 if k % 5 == 0 else min(90.0, money)
            if k % 5 == 0 or amount > 1.0:
                money += amount - 1.0 if k % 5 == 0 else -amount
                want.append((f"{k:03}", amount, money))
        assert [(x.symbol, x.amount, x.cash_after) for x in mine] == want
        assert [x.place for x in mine] == list(range(len(want)))
