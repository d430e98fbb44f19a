"""Keeping the store: deduplication, plausibility, splicing, planning of downloads, failure counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_last(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Of rows with equal keys the one of largest sequence; of several such, the largest by their hash, whatever their order."""
    order = Window.partitionBy(*keys).orderBy(F.desc(sequence), F.desc(F.xxhash64(*[c for c in rows.columns if c not in keys])))
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def keep_first(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(sequence)
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def upsert(store: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows; of equal keys the new one stays."""
    both = store.withColumn("_turn", F.lit(0)).unionByName(update.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, "_turn").drop("_turn")


def last_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("date").alias("last_date"))


def quality_filter(bars: DataFrame, max_gap_ratio: float = 0.35) -> DataFrame:
    """Plausible bars of plausible symbols.

    Bars have a positive close and a high not under the low. Symbols go that three times gain over 900 % or lose
    over 90 % on the observation before, and those with too few bars for their span (unless it is short).
    """
    rows = bars.where("close > 0 and high >= low")
    move = F.try_divide("close", F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))) - 1
    wild = rows.withColumn("move", move).where("move > 9 or move < -0.9").groupBy("symbol").count().where("count >= 3").select("symbol")
    rows = rows.join(wild, "symbol", "left_anti")
    span = rows.groupBy("symbol").agg(F.count("*").alias("n"), (F.datediff(F.max("date"), F.min("date")) * 252 / 365).alias("expected"))
    full = span.where((F.col("n") >= F.col("expected") * (1 - max_gap_ratio)) | (F.col("expected") < 60)).select("symbol")
    return rows.join(full, "symbol", "left_semi")


def enough_history(bars: DataFrame, least: int = 250) -> DataFrame:
    """Bars of symbols with so many closes."""
    full = bars.groupBy("symbol").agg(F.count("close").alias("n")).where(F.col("n") >= least).select("symbol")
    return bars.join(full, "symbol", "left_semi")


def splice(reserve: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of the reserve source that the store lacks, at the level of the store's prices.

    The factor is that of the closes on the last common date, used between 0.2 and 5. Unknown symbols pass whole.
    """
    common = reserve.select("symbol", "date", "close").join(store.select("symbol", "date", F.col("close").alias("own")), ["symbol", "date"])
    factor = common.groupBy("symbol").agg(F.max_by(F.try_divide("own", "close"), "date").alias("factor")).where("factor > 0.2 and factor < 5")
    newest = store.groupBy("symbol").agg(F.max("date").alias("newest"))
    rows = reserve.join(factor, "symbol", "left").join(newest, "symbol", "left").where("newest is null or date > newest")
    scale = F.coalesce("factor", F.lit(1.0))
    return rows.withColumns({c: F.col(c) * scale for c in ("open", "high", "low", "close")}).drop("factor", "newest")


def plan_downloads(universe: DataFrame, store: DataFrame, asked: DataFrame, today: str, behind_days: int = 30, short_rows: int = 400, ask_again_days: int = 30) -> DataFrame:
    """symbol, plan (full or recent): unknown, late and short symbols get their whole history.

    A short one does not if it was asked for lately (asked: symbol, asked_on). If under half are known, all get it.
    """
    now = F.to_date(F.lit(today))
    known = store.groupBy("symbol").agg(F.max("date").alias("last"), F.count("*").alias("n"))
    rows = universe.select("symbol").join(known, "symbol", "left").join(asked.groupBy("symbol").agg(F.max("asked_on").alias("asked_on")), "symbol", "left")
    share = universe.select("symbol").join(known, "symbol", "left").agg(F.avg(F.when(F.col("last").isNotNull(), 1.0).otherwise(0.0)).alias("share"))
    rows = rows.join(F.broadcast(share))  # one row
    fresh_ask = F.coalesce(F.datediff(now, F.col("asked_on")) < ask_again_days, F.lit(False))
    full = F.col("last").isNull() | (F.datediff(now, F.col("last")) > behind_days) | ((F.col("n") < short_rows) & ~fresh_ask)
    return rows.select("symbol", F.when(full | (F.col("share") < 0.5), "full").otherwise("recent").alias("plan"))


def replace_refreshed(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """A full reload: rows of refreshed symbols are replaced, not merged."""
    return store.join(fresh.select("symbol").distinct(), "symbol", "left_anti").unionByName(fresh)


def prune(store: DataFrame, universe: DataFrame, most: float = 0.2) -> DataFrame:
    """Rows of symbols of the universe; all rows if more than the share ``most`` of symbols would go."""
    kept = universe.select("symbol").distinct().withColumn("kept", F.lit(True))
    have = store.select("symbol").distinct().join(kept, "symbol", "left")
    gone = have.agg((F.count_if(F.col("kept").isNull()) / F.greatest(F.count("*"), F.lit(1))).alias("gone"))
    rows = store.join(kept, "symbol", "left").join(F.broadcast(gone))  # one row
    return rows.where(F.col("kept").isNotNull() | (F.col("gone") > most)).drop("kept", "gone")


def count_failures(failed: DataFrame, asked: DataFrame, answered: DataFrame, today: str) -> DataFrame:
    """symbol, since, failures: consecutive failures; an answer clears them, symbols not asked keep theirs."""
    now = F.to_date(F.lit(today))
    tried = asked.select("symbol").distinct().join(answered.select("symbol").distinct().withColumn("ok", F.lit(True)), "symbol", "left").withColumn("tried", F.lit(True))
    rows = failed.select("symbol", "since", "failures").join(tried, "symbol", "full_outer")
    lost = F.col("tried").isNotNull() & F.col("ok").isNull()
    rows = rows.where(lost | F.col("tried").isNull())
    return rows.select("symbol", F.coalesce("since", now).alias("since"), (F.coalesce("failures", F.lit(0)) + F.when(lost, 1).otherwise(0)).alias("failures"))


def not_worth_asking(failed: DataFrame, today: str, days: int = 30, least: int = 2) -> DataFrame:
    return failed.where((F.col("failures") >= least) & (F.datediff(F.to_date(F.lit(today)), F.col("since")) < days)).select("symbol")


def coverage_of_last_session(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """date, symbols, usual, pct: symbols of the universe on the last business date, the median of the twenty before, percent of the universe."""
    days = bars.join(universe.select("symbol").distinct(), "symbol", "left_semi").where(F.weekday("date") < 5).groupBy("date").agg(F.countDistinct("symbol").alias("symbols"))
    order = Window.orderBy("date")
    rows = days.withColumns({"usual": F.percentile("symbols", F.lit(0.5)).over(order.rowsBetween(-20, -1)), "next": F.lead("date").over(order)})
    size = universe.agg(F.countDistinct("symbol").alias("size"))
    return rows.where("next is null").join(F.broadcast(size)).select("date", "symbols", "usual", (F.col("symbols") * 100 / F.col("size")).alias("pct"))


class PoorCoverage(RuntimeError):
    """Too few symbols have a bar on the last session."""


def check_coverage(bars: DataFrame, universe: DataFrame, least_pct: float = 75.0) -> float:
    """Percent of the universe on the last session; raises PoorCoverage under ``least_pct``."""
    row = coverage_of_last_session(bars, universe).first()
    if row is None or row.pct < least_pct:
        raise PoorCoverage(f"{0.0 if row is None else row.pct:.1f} % of the universe on the last session; {least_pct:.0f} % are wanted")
    return row.pct


def download_summary(fresh: DataFrame, asked: DataFrame, store: DataFrame) -> DataFrame:
    """One row: asked, answered, rows, newest, newest_before, verdict (nothing, few answers, goes back, nothing new, or ok)."""
    got = fresh.agg(F.countDistinct("symbol").alias("answered"), F.count("*").alias("rows"), F.max("date").alias("newest"))
    n, before = asked.agg(F.countDistinct("symbol").alias("asked")), store.agg(F.max("date").alias("newest_before"))
    rows = got.crossJoin(n).crossJoin(before)  # one row each
    said = (
        F.when(F.col("rows") == 0, "nothing")
        .when(F.col("answered") < 0.5 * F.col("asked"), "few answers")
        .when(F.col("newest") < F.col("newest_before"), "goes back")
        .when(F.col("newest") == F.col("newest_before"), "nothing new")
        .otherwise("ok")
    )
    return rows.select("asked", "answered", "rows", "newest", "newest_before", said.alias("verdict"))
