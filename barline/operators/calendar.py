"""The common calendar: sessions are the dates on which any symbol traded, numbered from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def calendar(bars: DataFrame) -> DataFrame:
    """date, sess. As many rows as dates: the window over all of them stays small whatever the number of bars."""
    dates = bars.select("date").where("date is not null").distinct()
    return dates.withColumn("sess", F.row_number().over(Window.orderBy("date")))


def with_sessions(bars: DataFrame) -> DataFrame:
    return bars.join(F.broadcast(calendar(bars)), "date")  # a row for each date


def business_days(bars: DataFrame) -> DataFrame:
    """Bars of Monday to Friday."""
    return bars.where(F.weekday("date") < 5)


def session_counts(bars: DataFrame) -> DataFrame:
    return bars.where("close is not null").groupBy("date").agg(F.count("*").alias("bars"))


def last_complete_session(bars: DataFrame, window: int = 20, threshold: float = 0.6) -> DataFrame:
    """One row: the last date with at least threshold times the median count of the window of dates before it.

    A date without earlier ones counts as complete; if none qualifies, the last date.
    """
    before = Window.orderBy("date").rowsBetween(-window, -1)
    counts = session_counts(bars).withColumn("usual", F.percentile("bars", F.lit(0.5)).over(before))
    complete = (F.col("usual").isNull()) | (F.col("usual") <= 0) | (F.col("bars") >= threshold * F.col("usual"))
    return counts.agg(F.coalesce(F.max(F.when(complete, F.col("date"))), F.max("date")).alias("date"))


def trim_incomplete(bars: DataFrame, window: int = 20, threshold: float = 0.6) -> DataFrame:
    last = last_complete_session(bars, window, threshold).select(F.col("date").alias("last"))
    return bars.join(F.broadcast(last), F.col("date") <= F.col("last")).drop("last")  # one row


def rebalance_dates(bars: DataFrame, period: str = "month", min_days: int = 0, last: int | None = None) -> DataFrame:
    """Last session of each period from min_days after the first date on, the latest ``last`` of them, and the last session."""
    days = calendar(bars)
    ends = days.groupBy(F.date_trunc(period, "date").alias("period")).agg(F.max("date").alias("date")).select("date")
    if min_days:
        first = days.agg(F.min("date").alias("first"))
        ends = ends.join(F.broadcast(first), F.col("date") >= F.date_add("first", min_days)).select("date")
    if last is not None:
        ends = ends.orderBy(F.desc("date")).limit(last)
    return ends.union(days.agg(F.max("date").alias("date"))).distinct()


def next_session(bars: DataFrame) -> DataFrame:
    """date, next_date: the session on which a decision of that date is carried out."""
    return calendar(bars).withColumn("next_date", F.lead("date").over(Window.orderBy("date"))).select("date", "next_date")


def sessions_late(last: str, today: str) -> Column:
    """Business days after ``last`` up to ``today`` (columns); 10000 where last is null."""
    days = F.filter(F.sequence(F.col(last), F.col(today)), lambda d: F.weekday(d) < 5)
    return F.when(F.col(last).isNull(), F.lit(10000)).when(F.col(last) > F.col(today), F.lit(0)).otherwise(F.greatest(F.size(days) - 1, F.lit(0)))


class StaleData(RuntimeError):
    """The newest bar is too old."""


def check_freshness(bars: DataFrame, today: str, most: int = 2) -> int:
    """Sessions that the newest bar is late; raises StaleData beyond ``most`` or without bars."""
    newest = bars.agg(F.max("date").alias("last")).withColumn("today", F.to_date(F.lit(today)))
    late = newest.select(sessions_late("last", "today")).first()[0]
    if late > most:
        raise StaleData(f"the newest bar is {late} sessions old; {most} are allowed")
    return late
