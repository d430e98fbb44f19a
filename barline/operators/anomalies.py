"""Screening of series: eight flags per symbol over the last sessions, their severity, and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.functions import rolling as r
from barline.sources.shared import dealt, tasks_for

# Usual split ratios, severity of each flag, severity of a quarantine.
SPLIT_RATIOS = (2, 2.5, 3, 4, 5, 6, 7, 8, 10, 15, 20)
SEVERITY = {"unadjusted_split": 5.0, "bad_tick": 4.0, "flat_bars": 3.0, "stale": 2.5, "dead": 2.0, "duplicate": 2.0, "zero_volume": 1.0, "illiquid": 1.0}
QUARANTINE_AT = 4.0


def recent(bars: DataFrame, lookback: int = 504) -> DataFrame:
    """Bars of the last sessions, with newest, first and the number of sessions looked at."""
    span = bars.agg(F.max("sess").alias("newest"), F.max("date").alias("newest_date"), F.min("sess").alias("oldest"))
    span = span.withColumn("sessions", F.least(F.col("newest") - F.col("oldest") + 1, F.lit(lookback)))
    return bars.join(F.broadcast(span), F.col("sess") > F.col("newest") - lookback)  # one row


def longest_run(rows: DataFrame, flag: str) -> DataFrame:
    """symbol, run: the longest run of consecutive sessions with the flag; a missing bar ends a run."""
    islands = rows.where(flag).withColumn("island", F.col("sess") - F.row_number().over(Window.partitionBy("symbol").orderBy("sess")))
    return islands.groupBy("symbol", "island").count().groupBy("symbol").agg(F.max("count").alias("run"))


def duplicates(bars: DataFrame, sessions: int = 250, least: int = 100) -> DataFrame:
    """symbol of each series whose last returns equal, to six decimals, those of a symbol before it.

    The close before a gap carries on over it, as do returns of 0 inside the gap.
    """
    newest = bars.agg(F.max("sess").alias("newest"))
    order = Window.partitionBy("symbol").orderBy("sess")
    rows = bars.where("close is not null").withColumns({"gap": F.col("sess") - F.lag("sess").over(order), "ret": F.try_divide("close", F.lag("close").over(order)) - 1})
    rows = rows.join(F.broadcast(newest), F.col("sess") > F.col("newest") - sessions).where("ret is not null")  # one row
    # A gap before the bar holds sessions without change; only those inside the span count.
    zeros = F.least(F.col("gap") - 1, F.col("sess") - 1 - (F.col("newest") - sessions))
    tail = rows.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("sess", zeros.cast("int").alias("zeros"), F.round("ret", 6).alias("ret")))).alias("path"), F.max("newest").alias("newest"), F.max("sess").alias("last"))
    values = F.concat(F.flatten(F.transform("path", lambda p: F.concat(F.array_repeat(F.lit(0.0), p["zeros"]), F.array(p["ret"] + 0.0)))), F.array_repeat(F.lit(0.0), (F.col("newest") - F.col("last")).cast("int")))
    prints = tail.select("symbol", values.alias("values")).where(F.size("values") >= least).select("symbol", F.md5(F.to_json("values")).alias("digest"))
    return prints.withColumn("place", F.row_number().over(Window.partitionBy("digest").orderBy("symbol"))).where("place > 1").select("symbol")


def detect(bars: DataFrame, min_dollar_volume: float = 1e6, stale_sessions: int = 8, lookback: int = 504) -> DataFrame:
    """symbol, the flags of SEVERITY, severity, quarantine, dollar_volume (median), last_date. Bars are counted, and dealt as those of ``build_features``."""
    rows = dealt(recent(bars, lookback), tasks_for(bars), "symbol")
    c, v = F.col("close"), F.col("volume")
    rows = rows.withColumns({"before": r.at(c, -1), "after5": r.at(c, 5)})
    rows = rows.withColumns({"lr": F.ln(F.try_divide(c, F.col("before"))), "jump": F.try_divide(c, F.col("before")), "still": F.coalesce(F.abs(c - F.col("before")) <= 1e-12, F.lit(False))})
    w = r.Windows()
    rows = rows.withColumns({"lr_next": r.at(F.col("lr"), 1), "own_sd": F.stddev_samp("lr").over(Window.partitionBy("symbol"))})
    rows = w.add(rows, {"sigma": w.guarded(w.deviation("lr", 120), "lr", 120, 40)})
    tolerance = F.least(F.greatest(2.5 * F.coalesce("own_sd", F.lit(0.02)), F.lit(0.02)), F.lit(0.10))
    ratios = F.array(*[F.lit(float(x)) for k in SPLIT_RATIOS for x in (k, 1 / k)])
    near = F.exists(ratios, lambda x: F.abs(F.col("jump") - x) / x < F.col("tolerance"))
    rows = rows.withColumn("tolerance", tolerance)
    split = near & (F.abs(F.col("jump") - 1) > 0.25) & (F.abs(F.try_divide("after5", c) - 1) < 0.25)
    tick = (F.abs("lr") > 6 * F.col("sigma")) & (F.col("lr_next") * F.col("lr") < 0) & (F.abs("lr_next") > 0.6 * F.abs("lr")) & (F.abs("lr") > 0.2)
    flat = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == c)

    def some(flag: Column) -> Column:
        return F.coalesce(F.bool_or(flag), F.lit(False))

    report = rows.groupBy("symbol").agg(
        some(split).alias("unadjusted_split"),
        some(tick).alias("bad_tick"),
        (F.count_if(flat) / F.max("sessions") > 0.20).alias("flat_bars"),
        (F.count_if(v <= 0) / F.max("sessions") > 0.10).alias("zero_volume"),
        F.coalesce(F.datediff(F.max("newest_date"), F.max(F.when(c.isNotNull(), F.col("date")))) > 10, F.lit(False)).alias("dead"),
        F.median(c * v).alias("dollar_volume"),
        F.max(F.when(c.isNotNull(), F.col("date"))).alias("last_date"),
    )
    report = report.withColumn("illiquid", F.coalesce("dollar_volume", F.lit(0.0)) < min_dollar_volume)
    report = report.join(longest_run(rows, "still"), "symbol", "left").withColumn("stale", F.coalesce("run", F.lit(0)) >= stale_sessions).drop("run")
    twice = duplicates(bars.join(F.broadcast(bars.agg(F.max("sess").alias("top"))), F.col("sess") > F.col("top") - lookback).drop("top"))
    report = report.join(twice.withColumn("duplicate", F.lit(True)), "symbol", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
    severity = F.lit(0.0)
    for flag, weight in SEVERITY.items():
        severity = severity + F.when(F.col(flag), weight).otherwise(0.0)
    report = report.withColumn("severity", severity).withColumn("quarantine", F.col("severity") >= QUARANTINE_AT)
    return report.select("symbol", *SEVERITY, "severity", "quarantine", "dollar_volume", "last_date")


def summary(report: DataFrame) -> DataFrame:
    """flag, symbols, severity: how many symbols have each flag."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("on"), F.lit(w).alias("severity")) for f, w in SEVERITY.items()]))
    return report.select(each.alias("x")).groupBy("x.flag", "x.severity").agg(F.count_if("x.on").alias("symbols")).select("flag", "symbols", "severity")


def apply_quarantine(panel: DataFrame, report: DataFrame) -> DataFrame:
    return panel.join(report.where("quarantine").select("symbol"), "symbol", "left_anti")
