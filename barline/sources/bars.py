"""Bars (symbol, grp, date, open, high, low, close, volume) built from tables of single trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.sources.shared import beside, dealt, spread, tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_bars(trades: DataFrame, symbol: str, date: str, price: str, quantity: str, order: list[str], grp: str | None = None) -> DataFrame:
    """One bar for each symbol and date; open and close follow the total order of ``order``."""
    turn = F.struct(*order)
    keys = [F.col(symbol).alias("symbol"), F.col(date).alias("date"), *([F.col(grp).alias("grp")] if grp else [])]
    out = trades.groupBy(*keys).agg(
        F.min_by(price, turn).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, turn).alias("close"),
        F.sum(quantity).alias("volume"),
    )
    return out if grp else out.withColumn("grp", F.lit("ALL"))


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def _lines(spark: SparkSession, sf_dir: str, date: Column, tasks: int = 1) -> DataFrame:
    """tasks: over how many the caller deals them."""
    lines = spread(table(spark, sf_dir, "lineitem").select(*LINE_ORDER), tasks, "l_orderkey", "l_linenumber")
    return lines.withColumns({"price": F.col("l_extendedprice") / F.col("l_quantity"), "date": date})


def supplier_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by week, grouped by region.

    A bar has two or three lines, seldom in one file split, so lines are dealt by their number as they are: reduced before, they would be sorted twice.
    Many lines are spread first, so that no task holds a whole row group of them.
    """
    tasks = tasks_for(table(spark, sf_dir, "lineitem"))
    lines = dealt(_lines(spark, sf_dir, F.to_date(F.date_trunc("week", "l_shipdate")), tasks), tasks, "l_suppkey", "date")
    rows = to_bars(lines, "l_suppkey", "date", "price", "l_quantity", LINE_ORDER).drop("grp")
    return beside(rows, supplier_region(spark, sf_dir), 64, tasks, "symbol")


def supplier_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, grp: region of each supplier."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("grp"))


def brand_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, F.to_date(F.date_trunc("month", "l_shipdate")))
    return to_bars(_branded(lines, spark, sf_dir), "p_brand", "date", "price", "l_quantity", LINE_ORDER)


def brand_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, F.to_date("l_shipdate"))
    return to_bars(_branded(lines, spark, sf_dir), "p_brand", "date", "price", "l_quantity", LINE_ORDER)


def _branded(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))


def events_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by day; the value of an event is its price, each event has volume 1."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"), "value", F.lit(1.0).alias("one"), "ts", "event_id")
    return to_bars(events, "user_id", "date", "value", "one", ["ts", "event_id"])
