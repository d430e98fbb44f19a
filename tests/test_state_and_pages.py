"""State that survives bad values and broken files; redundancy against a plain fold; euros; candles by pages, in batches and as a stream."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barline.operators import portfolio, scoring
from barline.sources import batches, feeds, state

DEEP = "a double, s struct<x: double, l: array<float>>, m map<string, double>, n string"


def test_bad_numbers_become_null_at_every_depth(spark, tmp_path):
    bad, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(bad, (inf, [1.0, bad, -inf]), {"k": bad, "l": 2.0}, "x"), (1.5, None, None, None)], DEEP)
    state.write_json(rows, f"{tmp_path}/s")
    got = sorted((r.asDict(True) for r in state.read_json(spark, f"{tmp_path}/s", DEEP).collect()), key=lambda r: r["n"] or "")
    assert got == [{"a": 1.5, "s": None, "m": None, "n": None}, {"a": None, "s": {"x": None, "l": [1.0, None, None]}, "m": {"k": None, "l": 2.0}, "n": "x"}]


@pytest.mark.parametrize("text", ['{"a": 1}\n{"a": 2', "nothing of the kind", '{"a": {"b": 1}}'])
def test_a_broken_file_is_an_empty_state(spark, tmp_path, text):
    (tmp_path / "part.json").write_text(text)
    out = state.read_json(spark, str(tmp_path), "a int, b string")
    assert out.count() == 0 and out.columns == ["a", "b"]
    assert state.read_json(spark, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "part.json").write_text('{"a": 1}\n{"b": "x"}\n')
    assert sorted((r.a or 0, r.b) for r in state.read_json(spark, str(tmp_path), "a int, b string").collect()) == [(0, "x"), (1, None)]


def plain_redundant(returns, ranked, limit):
    kept, found = [], {}
    for s in ranked:
        near = []
        for k in kept:
            both = sorted(set(returns[s]) & set(returns[k]))
            x, y = [returns[s][t] for t in both], [returns[k][t] for t in both]
            mx, my = sum(x) / len(x), sum(y) / len(y)
            below = math.sqrt(sum((v - mx) ** 2 for v in x) * sum((v - my) ** 2 for v in y))
            near.append((abs(sum((v - mx) * (w - my) for v, w in zip(x, y, strict=True)) / below), k))
        best = max(near, key=lambda v: v[0], default=(0.0, None))
        if best[0] >= limit:
            found[s] = best[1]
        else:
            kept.append(s)
    return found


def test_redundant_is_the_plain_fold(spark):
    draw = random.Random(5)
    base = {k: [draw.gauss(0, 1) for _ in range(80)] for k in range(4)}
    levels, returns = [], {}
    for k in range(14):
        close, mine = 100.0, {}
        for t in range(80):
            r = 0.01 * (base[k % 4][t] * (-1 if k % 3 == 0 else 1) + draw.gauss(0, 0.2 + 0.12 * (k // 4)))
            close *= math.exp(r)
            if (t * (k + 20)) % 17:
                levels.append((f"s{k:02}", t + 1, close))
        have = {t: c for s, t, c in levels if s == f"s{k:02}"}
        returns[f"s{k:02}"] = {t: math.log(have[t] / have[t - 1]) for t in have if t - 1 in have}
    bars = spark.createDataFrame(levels, "symbol string, sess int, close double")
    ranked = [f"s{k:02}" for k in random.Random(2).sample(range(14), 14)]
    places = spark.createDataFrame([(s, k + 1) for k, s in enumerate(ranked)], "symbol string, place int")
    for limit in (0.5, 0.8, 0.95):
        got = {r.symbol: r.twin for r in scoring.redundant(bars, places, 126, limit).collect()}
        assert got == plain_redundant(returns, ranked, limit) and (limit > 0.9 or got)
    assert scoring.redundant(bars, places.limit(0)).count() == 0
    alone = spark.createDataFrame([("s01", 1), ("unknown", 2)], "symbol string, place int")
    assert scoring.redundant(bars, alone).count() == 0


def test_prices_in_euros(spark):
    bars = spark.createDataFrame([(s, f"2024-01-0{d}", 110.0, 7) for s in ("EU", "GB", "US", "SE", "NEW") for d in (1, 2, 3)], "symbol string, date string, close double, volume int").withColumn("date", F.to_date("date"))
    money = spark.createDataFrame([("EU", "eur"), ("GB", "GBP"), ("US", "USD"), ("SE", "SEK")], "symbol string, currency string")
    rates = spark.createDataFrame([("2024-01-02", "USD", 1.1), ("2023-12-01", "GBP", 0.5), ("2024-01-03", "GBP", 0.0)], "date string, currency string, rate double").withColumn("date", F.to_date("date"))
    out = portfolio.in_euros(bars, money, rates, ("close",))
    got = {(r.symbol, r.date.day): round(r.close, 6) for r in out.collect()}
    # The rate of December is known on the first session, whatever the sessions are.
    assert got == {(s, d): 110.0 if s == "EU" or d == 1 else 100.0 for s in ("EU", "US", "SE", "NEW") for d in (1, 2, 3)} | {("GB", 1): 220.0, ("GB", 2): 220.0, ("GB", 3): 110.0}
    assert out.columns == bars.columns


DAY = 86400000


def put_page(folder, symbol, number, days, torn=""):
    (folder / symbol).mkdir(exist_ok=True)
    lines = [f"{k * DAY},1,2,0.5,{k},3\n" for k in days]
    (folder / symbol / f"page-{number:05d}.csv").write_text("ts,open,high,low,close,volume\n" + "".join(lines) + torn)


def days_of(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.symbol, []).append(int(r.close))
    return {s: sorted(v) for s, v in out.items()}


def test_a_stream_of_pages_goes_on_where_it_stopped(spark, tmp_path):
    feeds.register(spark)
    pages, checkpoint = tmp_path / "pages", f"{tmp_path}/state"
    pages.mkdir()
    seen = []

    def run(stop=False):
        def take(batch, number):
            seen.append((number, days_of(batch)))
            if stop:
                raise RuntimeError("stopped")

        stream = spark.readStream.format("paged_candles").option("path", str(pages)).option("start_ms", DAY).load()
        stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    put_page(pages, "BTC", 0, (0, 1, 2))
    put_page(pages, "BTC", 1, (2, 3))
    run()
    assert [rows for _, rows in seen] == [{"BTC": [1, 2, 3]}]  # none before the start, no overlap
    seen.clear()
    run()
    assert not any(rows for _, rows in seen)  # nothing is read twice
    seen.clear()
    put_page(pages, "BTC", 1, (2, 3, 4), torn=f"{5 * DAY},1,2,0.5,5,")  # a page that grows, and a line that is not whole yet
    put_page(pages, "ETH", 0, (7,))
    with pytest.raises(Exception, match="stopped"):
        run(stop=True)
    put_page(pages, "BTC", 1, (2, 3, 4, 5))
    put_page(pages, "BTC", 2, (5, 6))
    run()
    run()  # what came after the batch that was repeated
    first = [rows for number, rows in seen if number == seen[0][0]]
    assert first[0] == first[1] == {"BTC": [4], "ETH": [7]}  # the batch that was stopped comes again as it was
    assert [rows for number, rows in seen if number > seen[0][0]] == [{"BTC": [5, 6]}]


def test_filters_reach_the_pages(spark, tmp_path):
    feeds.register(spark)
    for s in ("AAA", "BBB", "CCC"):
        put_page(tmp_path, s, 0, (1, 2, 3))
    load = lambda: spark.read.format("paged_candles").option("path", str(tmp_path)).load()
    some = load().where(F.col("symbol").isin("AAA", "CCC") & (F.col("date") >= F.lit("1970-01-03").cast("date")))
    assert days_of(some) == {"AAA": [2, 3], "CCC": [2, 3]} and days_of(load())["BBB"] == [1, 2, 3]
    reader = feeds._Pages({"path": str(tmp_path)})
    assert list(reader.pushFilters([batches.EqualTo(("symbol",), "BBB")])) == [] and [p.symbol for p in reader.partitions()] == ["BBB"]
