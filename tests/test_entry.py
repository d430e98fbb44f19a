import __spark_entry__ as entry


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and out.columns == ["date", "symbol", "score_short", "pct_short"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
