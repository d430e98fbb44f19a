"""Small tables with expected values written by hand."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions import rolling as r
from barline.operators import anomalies, calendar, evidence, ewm, features, ingest, portfolio, scoring
from barline.sources import html_tables, store, universe
from barline.sources.batches import register
from barline.streaming import bars as stream

DAY0 = datetime.date(2024, 1, 1)  # a Monday


def day(k):
    return DAY0 + datetime.timedelta(days=k)


def series(spark, values, symbol="A", start=1):
    rows = [(symbol, "G", day(k), k + start, v, v, v, v, 10.0) for k, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "symbol string, grp string, date date, sess int, open double, high double, low double, close double, volume double")


def column(df, name, key="sess"):
    return [x[0] for x in df.orderBy(key).select(name).collect()]


def test_frames_count_sessions_and_not_rows(spark):
    bars = series(spark, [1.0, 2.0, None, None, 5.0, 6.0])
    c, w = F.col("close"), r.Windows()
    out = w.add(bars.withColumns({"before": r.at(c, -1), "change": r.change(c, 4)}), {"sma": w.sma("close", 4)})
    assert column(out, "before") == [None, 1.0, None, 5.0]
    assert column(out, "change") == [None, None, 4.0, 2.0]
    assert column(out, "sma") == [None, 1.5, 3.5, 5.5]


def test_exponential_average_with_gaps():
    x = pd.Series([np.nan, 1, 2, np.nan, np.nan, 4, 5])
    assert x.ewm(alpha=0.5, adjust=False, min_periods=2).mean().tolist()[2:] == [1.5, 1.5, 1.5, 3.5, 4.25]


def test_rising_closes_have_rsi_50_and_no_trend_is_null(spark):
    bars = series(spark, [float(k) for k in range(1, 31)])
    out = ewm.with_ewm(bars)
    assert set(column(out, "rsi14")) == {50.0}
    flat = series(spark, [7.0] * 12).withColumn("y", F.ln("close"))
    w = r.Windows()
    assert column(w.add(flat, {"fit": w.fit("y", 5)}), "fit") == [None] * 12


def test_z_scores(spark):
    rows = [("few", k, float(k)) for k in range(4)] + [("same", k, 3.0) for k in range(6)] + [("same", 9, None)] + [("one", k, v) for k, v in enumerate([1.0, 1.0, 1.0, 1.0, 1.0, 100.0, None])]
    df = spark.createDataFrame([(DAY0, g, f"{g}{k}", v) for g, k, v in rows], "date date, grp string, symbol string, f float")
    z = {x.symbol: x.z for x in scoring.z_scores(df, ["f"], ["symbol"]).collect()}
    assert all(z[f"few{k}"] is None for k in range(4))
    assert all(z[f"same{k}"] == 0.0 for k in (0, 1, 2, 3, 4, 5, 9))
    assert z["one6"] is None and z["one5"] == pytest.approx(np.sqrt(5)) and z["one0"] == pytest.approx(-1 / np.sqrt(5))


def test_percentile_of_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0), (1, None)], "g int, x double")
    assert sorted(column(df.select("x", scoring.average_rank("x", ["g"]).alias("rank")), "rank", "x"), key=str) == [1.5, 1.5, 3.0, None]


def scored(spark, n):
    return spark.createDataFrame([(DAY0, f"s{k:03}", "G", float(k)) for k in range(n)], "date date, symbol string, grp string, score_short double")


@pytest.mark.parametrize("n,rank,expected", [(10, 1, 1), (10, 10, 10), (11, 2, 1), (11, 6, 5), (91, 64, 7), (91, 91, 10), (9, None, None)])
def test_deciles(spark, n, rank, expected):
    s = scored(spark, n)
    out = {x.symbol: x.bin for x in evidence.with_decile(s, s.select("date", "symbol", F.col("score_short").alias("fwd_short")), "short").collect()}
    assert out.get(f"s{rank - 1:03}" if rank else None) == expected and (rank or not out)


def test_turnover_fills_up_with_rows_without_a_score(spark):
    rows = [(day(0), "a", 2.0), (day(0), "b", None), (day(0), "c", None), (day(7), "a", 1.0), (day(7), "c", 5.0), (day(7), "d", None)]
    df = spark.createDataFrame([(d, s, "G", v) for d, s, v in rows], "date date, symbol string, grp string, score_short double")
    assert [(x.date, x.turnover) for x in evidence.turnover(df, "short", 2).collect()] == [(day(7), 0.5)]


def plain_newey_west(x, lags):
    d = x - x.mean()
    s = d @ d / len(x)
    for k in range(1, min(lags, len(x) - 1) + 1):
        s += 2 * (1 - k / (lags + 1)) * (d[k:] @ d[:-k]) / len(x)
    return np.sqrt(max(s, 1e-12) / len(x))


@pytest.mark.parametrize("lags", [0, 2, 11])
def test_newey_west(spark, lags):
    x = np.random.default_rng(1).normal(0.1, 1, 40).cumsum() / 10
    df = spark.createDataFrame([(day(k), "G", float(v)) for k, v in enumerate(x)] + [(day(k), "few", 1.0) for k in range(4)], "date date, grp string, ic double")
    out = {y.grp: y.se for y in evidence.newey_west(df, lags).collect()}
    assert out["G"] == pytest.approx(plain_newey_west(x, lags)) and out["few"] is None


def test_verdicts_and_weights(spark):
    rows = [("short", "a", 0.05, 3.0, 40), ("medium", "a", 0.05, 1.6, 40), ("long", "a", 0.584, 26.8, 7), ("long", "b", 0.2, 9.0, 40), ("long", "c", 0.01, None, 40)]
    out = evidence.verdict(spark.createDataFrame(rows, "horizon string, grp string, ic_mean double, t_stat double, periods long"))
    said = {(x.horizon, x.grp): (x.usable, x.verdict) for x in out.collect()}
    assert said["short", "a"] == (True, "consistent signal") and said["medium", "a"][1].startswith("weak")
    assert [said["long", g][0] for g in "abc"] == [False] * 3
    weights = {x.horizon: x.weight for x in evidence.evidence_weights(out).collect()}
    assert weights == pytest.approx({"short": 2 / 2.6, "medium": 0.6 / 2.6, "long": 0.0})
    none = evidence.evidence_weights(out.where("false"))
    assert {x.weight for x in none.collect()} == {1 / 3}


def test_rates_as_of(spark):
    dates = spark.createDataFrame([(day(k),) for k in (0, 1, 2, 5)], "date date")
    rates = spark.createDataFrame([(day(1), "USD", 1.1), (day(2), "USD", None), (day(4), "USD", 1.3)], "date date, currency string, rate double")
    assert column(portfolio.rates_as_of(dates, rates), "rate", "date") == [None, 1.1, 1.1, 1.3]
    one = spark.range(1).select(portfolio.to_euros(F.lit(110.0), F.lit("USD"), F.lit(1.1)).alias("a"), portfolio.to_euros(F.lit(5.0), F.lit("EUR"), F.lit(2.0)).alias("b"), portfolio.to_euros(F.lit(5.0), F.lit("USD"), F.lit(None).cast("double")).alias("c")).first()
    assert (round(one.a, 9), one.b, one.c) == (100.0, 5.0, 5.0)


def test_screening_finds_injected_faults(spark):
    rng = np.random.default_rng(0)
    paths = {s: 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300))) for s in ("clean", "split", "tick", "frozen", "thin", "twin1", "dead")}
    paths["split"][200:] /= 4
    paths["tick"][150] *= 1.6
    paths["frozen"][250:260] = paths["frozen"][249]
    paths["twin2"] = paths["twin1"] * 1.0
    rows = []
    for s, p in paths.items():
        for k, v in enumerate(p):
            if s == "dead" and k > 280:
                continue
            volume = 0.0 if s == "thin" and k % 3 == 0 else 1e6
            v = float(v)
            rows.append((s, "G", day(k), k + 1, v * 0.99, v * 1.01, v * 0.98, v, volume))
    bars = spark.createDataFrame(rows, "symbol string, grp string, date date, sess int, open double, high double, low double, close double, volume double")
    flags = {x.symbol: {f for f in anomalies.SEVERITY if x[f]} for x in anomalies.detect(bars).collect()}
    assert flags == {"clean": set(), "split": {"unadjusted_split"}, "tick": {"bad_tick"}, "frozen": {"stale"}, "thin": {"zero_volume"}, "twin1": set(), "twin2": {"duplicate"}, "dead": {"dead"}}


def test_incomplete_last_session_goes(spark):
    rows = [(f"s{k}", day(d), 1.0) for d in range(30) for k in range(20 if d < 29 else 5)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    assert calendar.trim_incomplete(bars).agg(F.max("date")).first()[0] == day(28)


def test_freshness(spark):
    bars = spark.createDataFrame([("a", datetime.date(2026, 8, 14))], "symbol string, date date")
    with pytest.raises(calendar.StaleData):
        calendar.check_freshness(bars, "2026-08-19")
    assert calendar.check_freshness(bars, "2026-08-16") == 0
    with pytest.raises(calendar.StaleData):
        calendar.check_freshness(bars.limit(0), "2026-08-19")


def test_failures_in_a_row(spark):
    def names(*s):
        return spark.createDataFrame([(x,) for x in s], "symbol string")

    none = spark.createDataFrame([], "symbol string, since date, failures int")
    once = ingest.count_failures(none, names("A", "B", "C"), names("A"), "2024-01-01")
    twice = ingest.count_failures(once, names("B", "C"), names("C"), "2024-01-02")
    assert {tuple(x) for x in twice.collect()} == {("B", DAY0, 2)}
    assert [x.symbol for x in ingest.not_worth_asking(twice, "2024-01-10").collect()] == ["B"] and ingest.not_worth_asking(twice, "2024-02-10").count() == 0


def test_no_look_ahead(spark):
    bars = series(spark, [float(100 + 10 * np.sin(k / 3) + k / 5) for k in range(90)])
    cut = 70
    now, before = (features.build_features(b, ewm=True).where(F.col("sess") == cut).drop("symbol", "grp", "date").first() for b in (bars, bars.where(F.col("sess") <= cut)))
    assert [x is None for x in now] == [x is None for x in before]
    assert [x for x in now if x is not None] == pytest.approx([x for x in before if x is not None])


NAMES = [("T-Rex 2X Long NVIDIA", "NVDX", True), ("10x Genomics", "TXG", False), ("ProShares Short S&P500", "SH", True), ("iShares Short Treasury Bond", "SHV", False), ("ProShares UltraShort Gold", "GLL", True), ("VIX Futures Fund", "V", True), ("Direxion Daily Gold Bull 3X", "N", True), ("Gold Shares", "GLD", False)]


def test_wrappers(spark):
    df = spark.createDataFrame(NAMES, "name string, symbol string, out boolean")
    assert df.where(universe.is_wrapper(F.col("name"), F.col("symbol")) != F.col("out")).count() == 0


def test_listing_and_html(spark, tmp_path):
    (tmp_path / "l.txt").write_text("Symbol|Security Name|Test Issue|Financial Status|ETF\nAAA|One|N|N|N\nBR.B|Two|N||N\nT$T|Three|N|N|N\nTST|Test|Y|N|N\nLEV|Big 2X Long|N|N|Y\nBAD|Late|N|D|N\nFND|Fund|N|N|Y\nFile Creation Time: 1||||\n")
    out = universe.listed(spark, str(tmp_path / "l.txt"), "NASDAQ")
    assert {(x.symbol, x.grp) for x in out.collect()} == {("AAA", "equity_us"), ("BR-B", "equity_us"), ("FND", "etf")}
    page = "<table><tr><th>Name</th><th>Ticker</th></tr>" + "".join(f"<tr><td>n</td><td>ab {k}</td></tr>" for k in range(15)) + "<tr><td>n</td><td>x.L</td></tr></table>"
    assert html_tables.tickers(page, ".PA")[-2:] == ["AB14.PA", "X.L"] and html_tables.tickers(None) == []


def test_store_and_batches(spark, tmp_path):
    path = str(tmp_path / "bars")
    assert store.load(spark, path).count() == 0
    rows = [("a", "g", day(0), 1.0, 1), ("a", "g", day(0), 2.0, 2), ("b", "h", day(0), None, 3)]
    df = spark.createDataFrame(rows, "symbol string, grp string, date date, close float, seq int")
    store.save(df, path, "seq")
    assert [(x.symbol, x.close) for x in store.load(spark, path).collect()] == [("a", 2.0)]
    (tmp_path / "AAA.csv").write_text("date,open,high,low,close,volume\n2024-01-01,1,2,0.5,1.5,10\n2024-01-02,1,2,0.5,,10\n")
    register(spark)
    out = spark.read.format("bar_files").option("path", str(tmp_path)).option("pieces", 2).load()
    assert [(x.symbol, x.close) for x in out.collect()] == [("AAA", 1.5)]


def test_selection_takes_the_liquid_clone():
    corr = {("g1", "g2"): 0.99, ("g1", "s"): 0.1, ("g2", "s"): 0.1, ("g1", "g3"): 0.85, ("g2", "g3"): 0.85, ("s", "g3"): 0.0}
    assert portfolio.choose(["g1", "g2", "g3", "s"], corr, {"g1": 1.0, "g2": 10.0}, 3) == ["g2", "s"]
    assert portfolio.choose(["g2", "s"], corr, {}, 3, taken=["g1"]) == ["s"]


def test_execution_never_spends_more_than_there_is(spark):
    orders = [("x", "b", "keep", "sale", 0.0, 10.0, 50.0), ("x", "b", "a", "purchase", 400.0, 0.0, 20.0), ("x", "b", "c", "purchase", 400.0, 0.0, None), ("x", "b", "d", "purchase", 900.0, 0.0, 10.0), ("x", "b", "e", "purchase", 10.0, 0.0, 10.0)]
    df = spark.createDataFrame([(*o, 1.0, 0.001, k) for k, o in enumerate(orders)], "scenario string, broker string, symbol string, side string, amount double, units_held double, price double, fee double, half_spread double, turn int")
    cash = spark.createDataFrame([("x", "b", 100.0)], "scenario string, broker string, cash double")
    fills = {f.symbol: f for f in portfolio.execute(df, cash).collect()}
    assert set(fills) == {"keep", "a", "d"} and fills["keep"].amount == 499.5
    assert fills["d"].amount == pytest.approx(100 + 499.5 - 1 - 400) and fills["d"].cash_after == 0
