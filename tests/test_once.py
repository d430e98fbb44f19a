"""What several steps of a query read is made once."""

import pytest
from pyspark.sql import functions as F

from barline.operators import evidence, scoring
from barline.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def counted(spark):
    """A table as it is, and how many of its rows have been made so far."""

    def of(rows):
        made, rows = spark.sparkContext.accumulator(0), rows.coalesce(1)

        def through(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(through, rows.schema), made

    return of


def scores(spark):
    k = F.col("id")
    rows = spark.range(40 * 12).select(F.expr("date_add(date'1995-01-02', int(id / 40) * 7)").alias("date"), (k % 40).alias("symbol"), F.lit("ASIA").alias("grp"))
    return rows.withColumns({f"score_{h}": F.pmod(F.hash("date", "symbol", F.lit(h)), F.lit(97)) / 10.0 for h in ("short", "medium")})


def test_contributions_make_the_panel_once(spark, counted):
    rows = scores(spark).withColumns({f: F.col("score_short") + n for n, f in enumerate(scoring.WEIGHTS["medium"])})
    rows = rows.unionByName(rows.limit(5).withColumns({"grp": F.lit(None).cast("string"), "date": F.lit("1994-01-01").cast("date")}))
    panel, made = counted(rows)
    got = scoring.contributions(panel, scoring.WEIGHTS["medium"]).collect()
    assert len(got) == 40 * 10 and {str(x.date) for x in got} == {"1995-03-20"} and made.value == 40 * 12 + 5


def test_turnover_makes_scores_once(spark, counted):
    rows, made = counted(scores(spark))
    got = evidence.turnover(rows, "short", 20).collect()
    assert len(got) == 11 and all(0 <= x.turnover <= 1 for x in got) and made.value == 40 * 12


def test_net_of_costs_makes_bars_and_scores_once(spark, counted, monkeypatch):
    rows, made = counted(scores(spark))
    week, bars = catalog.week, []
    monkeypatch.setattr(scoring, "score_panel", lambda panel, weights: rows)
    monkeypatch.setattr(catalog, "week", lambda *a: bars.append(week(*a)) or bars[-1])
    assert len(catalog.queries()["net_of_costs"](spark, DATA).collect()) <= 1
    assert len(bars) == 1 and made.value == 40 * 12


def test_orders_are_planned_from_alphas_made_once(spark, counted, monkeypatch):
    rows, made = counted(scores(spark))
    week, bars = catalog.week, []
    monkeypatch.setattr(scoring, "score_panel", lambda panel, weights: rows)
    monkeypatch.setattr(catalog, "week", lambda *a: bars.append(week(*a)) or bars[-1])
    assert catalog.queries()["plan_orders"](spark, DATA).collect()
    assert len(bars) == 1 and made.value == 40 * 12
