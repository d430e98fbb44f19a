"""The daily update: several days, stops, broken and silent symbols, poor coverage; filters that reach the data source."""

import datetime

import pytest
from pyspark.sql import functions as F

from barline import cli
from barline.operators import calendar, ingest
from barline.sources import batches, state, store
from barline.sources.versions import VersionedStore

DATES = [d for k in range(900) if (d := datetime.date(2022, 1, 3) + datetime.timedelta(days=k)).weekday() < 5]


def put(feed, symbol, dates, level=100.0):
    lines = [f"{d},{p},{p * 1.01},{p * 0.99},{p * 1.002},{100000 + i}" for i, d in enumerate(dates) for p in [level + (i * 7) % 23 / 10]]
    (feed / f"{symbol}.csv").write_text("date,open,high,low,close,volume\n" + "\n".join(lines) + "\n")


class World:
    def __init__(self, spark, folder, symbols=8):
        self.spark, self.feed, self.path = spark, folder / "feed", f"file://{folder}/bars"
        self.feed.mkdir()
        self.symbols = [f"S{k}" for k in range(symbols)]
        (folder / "l.txt").write_text("Symbol|Security Name|ETF\n" + "".join(f"{s}|Name|N\n" for s in self.symbols))
        rows = spark.createDataFrame([(s, "us_stock") for s in self.symbols], "symbol string, grp string")
        state.write_state(rows, f"{folder}/universe")
        self.base = ["--store", self.path, "--universe", f"{folder}/universe", "--out-dir", f"{folder}/out", "--today"]

    def day(self, n, *options, silent=(), from_day=0):
        """The feed up to the n-th session, and an update on that day."""
        for k, s in enumerate(self.symbols):
            if s not in silent:
                put(self.feed, s, DATES[from_day:n], 100.0 + k)
        cli.main([*self.base, str(DATES[n - 1]), "update", "--feed", str(self.feed), *options])

    def store(self):
        return VersionedStore(self.spark, self.path, store.BAR_SCHEMA)

    def seen(self):
        return {r.symbol: (r.n, r.last) for r in self.store().read().groupBy("symbol").agg(F.count("*").alias("n"), F.max("date").alias("last")).collect()}


def test_three_days(spark, tmp_path):
    w = World(spark, tmp_path)
    w.day(500)
    assert w.seen() == {s: (500, DATES[499]) for s in w.symbols}
    w.day(501, from_day=480)  # the feed has lost the old bars: the store keeps them
    assert w.seen() == {s: (501, DATES[500]) for s in w.symbols}
    w.day(503)
    assert w.seen() == {s: (503, DATES[502]) for s in w.symbols} and w.store().versions()[-1] == 3
    assert w.store().notes()["reloaded_on"] == str(DATES[499])
    w.day(530, from_day=100)  # over 30 days later: a whole reload
    assert w.seen() == {s: (430, DATES[529]) for s in w.symbols} and w.store().notes()["reloaded_on"] == str(DATES[529])


@pytest.mark.parametrize("step", ["write_folders", "commit", "vacuum"])
def test_a_stop_loses_nothing(spark, tmp_path, monkeypatch, step):
    w = World(spark, tmp_path, 3)
    w.day(420)

    def stop(*a, **k):
        raise KeyboardInterrupt

    monkeypatch.setattr(VersionedStore, step, stop)
    with pytest.raises(KeyboardInterrupt):
        w.day(421)
    monkeypatch.undo()
    assert set(w.seen().values()) == {(421 if step == "vacuum" else 420, DATES[420 if step == "vacuum" else 419])}
    w.day(422)
    assert set(w.seen().values()) == {(422, DATES[421])}


def test_silent_and_broken_symbols(spark, tmp_path):
    w = World(spark, tmp_path, 10)
    w.day(450)
    (w.feed / "S1.csv").write_text("date,open\n2022-01-03,x\n")
    (w.feed / "S2.csv").unlink()
    w.day(451, silent=("S1", "S2"))
    seen = w.seen()
    assert seen["S1"] == seen["S2"] == (450, DATES[449]) and seen["S0"] == (451, DATES[450])
    assert {(r.symbol, r.failures) for r in state.read_failed(spark, f"{w.path}-failed").collect()} == {("S1", 1), ("S2", 1)}
    w.day(452, silent=("S1", "S2"))
    put(w.feed, "S1", DATES[:453])
    w.day(453, silent=("S1", "S2"))  # after two failures they are left alone for a while
    assert w.seen()["S1"][0] == 450
    assert {(r.symbol, r.failures) for r in state.read_failed(spark, f"{w.path}-failed").collect()} == {("S1", 2), ("S2", 2)}


def test_poor_coverage_makes_no_version(spark, tmp_path):
    w = World(spark, tmp_path)
    w.day(420)
    for s in w.symbols[2:]:
        (w.feed / f"{s}.csv").unlink()
    with pytest.raises(ingest.PoorCoverage):
        w.day(421, silent=w.symbols[2:])
    assert w.store().versions() == [1] and set(w.seen().values()) == {(420, DATES[419])}
    cli.main([*w.base, str(DATES[420]), "update", "--feed", str(w.feed), "--min-coverage", "10.0"])
    assert w.seen()["S0"] == (421, DATES[420]) and w.seen()["S7"] == (420, DATES[419])


def test_short_histories_are_asked_for_once_a_month(spark, tmp_path):
    w = World(spark, tmp_path, 3)
    w.day(100)
    marks = {r.symbol: r.asked_on for r in state.read_marks(spark, f"{w.path}-marks").collect()}
    assert marks == {s: DATES[99] for s in w.symbols}
    w.day(101)
    assert {r.symbol: r.asked_on for r in state.read_marks(spark, f"{w.path}-marks").collect()} == marks


def test_stale_data_is_told(spark, tmp_path):
    w = World(spark, tmp_path, 3)
    w.day(420)
    with pytest.raises(calendar.StaleData):
        cli.main([*w.base, str(DATES[430]), "update", "--feed", str(w.feed)])


def test_filters_reach_the_reader(spark, tmp_path):
    for k in range(6):
        put(tmp_path, f"S{k}", DATES[:10])
    (tmp_path / "S9.csv").write_bytes(b"\xff\xfe broken")
    batches.register(spark)
    rows = spark.read.format("bar_files").option("path", str(tmp_path)).option("pieces", 3).load()
    some = rows.where(F.col("symbol").isin("S1", "S3", "S9") & (F.col("date") >= F.lit(DATES[7])) & (F.col("volume") > 0))
    assert sorted((r.symbol, r.date) for r in some.collect()) == [(s, d) for s in ("S1", "S3") for d in DATES[7:10]]
    plan = some._jdf.queryExecution().executedPlan().toString()
    kept = [line for line in plan.splitlines() if "Filter" in line and "PushedFilters" not in line]
    assert not any("symbol" in line and " IN " in line for line in kept)
    assert rows.where(F.col("date") > F.lit(DATES[8])).count() == 6
    reader = batches._Reader({"path": str(tmp_path)})
    left = list(reader.pushFilters([batches.In(("symbol",), ("S1", "S2")), batches.EqualTo(("symbol",), "S2"), batches.GreaterThanOrEqual(("date",), DATES[3]), batches.GreaterThan(("volume",), 1.0)]))
    assert reader.symbols == {"S2"} and reader.start == str(DATES[3]) and left == [batches.GreaterThan(("volume",), 1.0)]
