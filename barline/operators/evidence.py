"""Whether a ranking carried information: rank correlation, robust t, deciles, turnover, costs, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.operators.scoring import average_rank
from barline.sources.shared import beside, dealt, saved, tasks_for

MIN_PAIRS = 30
MIN_PERIODS = 20
REBALANCE_DAYS = 21


def with_forward(scored: DataFrame, forward: DataFrame, horizon: str) -> DataFrame:
    """date, symbol, grp, x, y: score and forward return where both are known, groups of a date dealt over tasks by the number of scores.

    Scores are saved and counted; forward returns are there for all sessions, so those of the other dates are left out before the two meet.
    """
    scores = saved(scored.select("date", "symbol", "grp", F.col(f"score_{horizon}").alias("x")).where("x is not null and grp is not null"), "scores")
    ahead = forward.select("date", "symbol", F.col(f"fwd_{horizon}").alias("y")).where("y is not null")
    ahead = ahead.join(F.broadcast(scores.select("date").distinct()), "date", "left_semi")  # a row for each date
    tasks = tasks_for(scores)
    return dealt(beside(ahead, scores, 64, tasks, "date", "symbol"), tasks, "date", "grp")


def information_coefficient(scored: DataFrame, forward: DataFrame, horizon: str, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """date, grp, n, ic: Spearman's correlation of score and forward return; null where either is constant."""
    rows = with_forward(scored, forward, horizon)
    ranked = rows.select("date", "grp", average_rank("x", ["date", "grp"]).alias("rx"), average_rank("y", ["date", "grp"]).alias("ry"))
    ic = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return ranked.groupBy("date", "grp").agg(F.count("*").alias("n"), ic.alias("ic")).where(F.col("n") >= min_pairs)


def newey_west(ic: DataFrame, lags: int) -> DataFrame:
    """grp, se: standard error of the mean of ic, robust to overlap; null under five values. Gaps are ignored."""
    values = ic.where("ic is not null and not isnan(ic)")
    whole = Window.partitionBy("grp")
    order = whole.orderBy("date")
    d = values.withColumn("d", F.col("ic") - F.avg("ic").over(whole)).withColumn("size", F.count("*").over(whole))
    for k in range(1, lags + 1):
        d = d.withColumn(f"p{k}", F.col("d") * F.lag("d", k).over(order))
    total: Column = F.sum(F.col("d") * F.col("d"))
    for k in range(1, lags + 1):
        total = total + F.coalesce(F.sum(F.when(F.col("size") > k, F.col(f"p{k}") * (2 * (1 - F.lit(k) / (F.least(F.lit(lags), F.lit(10**9)) + 1))))), F.lit(0.0))
    out = d.groupBy("grp").agg(F.count("*").alias("n"), total.alias("s"))
    return out.select("grp", F.when(F.col("n") >= 5, F.sqrt(F.greatest(F.col("s") / F.col("n"), F.lit(1e-12)) / F.col("n"))).alias("se"))


def overlap(days: int, rebalance_days: int = REBALANCE_DAYS) -> int:
    return max(-(-days // max(rebalance_days, 1)), 1)


def ic_summary(ic: DataFrame, overlap_periods: int = 1) -> DataFrame:
    """grp, periods, ic_mean, ic_std, ic_positive_pct, t_stat (robust), t_naive; three decimals."""
    ic = saved(ic, "coefficients")  # read for the means and for their errors
    means = ic.groupBy("grp").agg(F.count("*").alias("periods"), F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"), (F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)) * 100).alias("p"))
    both = means.join(newey_west(ic, max(overlap_periods - 1, 0)), "grp", "left")
    three = lambda c: F.bround(c, 3)
    return both.select(
        "grp",
        "periods",
        three(F.col("m")).alias("ic_mean"),
        three(F.col("s")).alias("ic_std"),
        three(F.col("p")).alias("ic_positive_pct"),
        three(F.try_divide("m", "se")).alias("t_stat"),
        three(F.try_divide(F.col("m") * F.sqrt("periods"), F.col("s"))).alias("t_naive"),
    )


def with_decile(scored: DataFrame, forward: DataFrame, horizon: str, bins: int = 10) -> DataFrame:
    """date, grp, symbol, fwd, bin: equal parts of the ranks within (date, grp); groups with fewer values than bins are left out."""
    rows = with_forward(scored, forward, horizon).withColumnRenamed("y", "fwd")
    peers = Window.partitionBy("date", "grp")
    rank = F.row_number().over(peers.orderBy("x", "symbol"))
    rows = rows.withColumn("level", F.dense_rank().over(peers.orderBy("x")))  # of the largest: how many values there are
    rows = rows.withColumns({"rank": rank, "size": F.count("*").over(peers), "values": F.max("level").over(peers)}).where(F.col("values") >= bins)
    return rows.withColumn("bin", F.greatest(F.lit(1), F.ceil(F.try_divide((F.col("rank") - 1) * bins, F.col("size") - 1)))).select("date", "grp", "symbol", "fwd", F.col("bin").cast("int").alias("bin"))


def decile_stats(binned: DataFrame) -> DataFrame:
    return binned.groupBy("grp", "bin").agg(F.bround(F.avg("fwd"), 4).alias("mean"), F.bround(F.median("fwd"), 4).alias("median"), F.bround(F.stddev_samp("fwd"), 4).alias("std"), F.count("fwd").alias("count"))


def decile_spread(binned: DataFrame, bins: int = 10) -> DataFrame:
    """grp, date, spread: mean of the best bin less that of the worst."""
    top, low = F.avg(F.when(F.col("bin") == bins, F.col("fwd"))), F.avg(F.when(F.col("bin") == 1, F.col("fwd")))
    return binned.groupBy("grp", "date").agg((top - low).alias("spread"))


def turnover(scored: DataFrame, horizon: str, top: int = 50) -> DataFrame:
    """grp, date, turnover of the best ``top`` between neighbouring dates; rows without a score fill up, last by symbol. The best are saved, so scores are made once."""
    order = Window.partitionBy("grp", "date").orderBy(F.desc_nulls_last(f"score_{horizon}"), "symbol")
    best = saved(scored.where("grp is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("grp", "date", "symbol"), "best")
    days = best.select("grp", "date").distinct().withColumn("turn", F.row_number().over(Window.partitionBy("grp").orderBy("date")))
    now = best.join(days, ["grp", "date"])
    before = now.select("grp", "symbol", (F.col("turn") + 1).alias("turn"), F.lit(1).alias("stayed"))
    kept = now.join(before, ["grp", "symbol", "turn"], "left").groupBy("grp", "date", "turn").agg(F.count("*").alias("size"), F.count("stayed").alias("stayed"))
    return kept.where("turn > 1").select("grp", "date", (1 - F.col("stayed") / F.col("size")).alias("turnover"))


def mean_turnover(turns: DataFrame) -> DataFrame:
    return turns.groupBy("grp").agg(F.bround(F.avg("turnover"), 3).alias("turnover"))


def net_of_costs(spread: DataFrame, turns: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """grp, spread, cost, net, periods: means over the dates; a date without a turnover costs nothing."""
    rows = spread.join(turns, ["grp", "date"], "left").withColumn("cost", F.coalesce("turnover", F.lit(0.0)) * 2 * cost_bps / 1e4)
    return rows.groupBy("grp").agg(F.bround(F.avg("spread"), 4).alias("spread"), F.bround(F.avg("cost"), 4).alias("cost"), F.bround(F.avg(F.col("spread") - F.col("cost")), 4).alias("net"), F.count("*").alias("periods"))


def verdict(summary: DataFrame) -> DataFrame:
    """summary (horizon, grp, ic_mean, t_stat, periods) with usable and verdict."""
    t, n, m = F.col("t_stat"), F.col("periods"), F.abs("ic_mean")
    none = t.isNull() | F.isnan(t)
    said = (
        F.when(none, "no data")
        .when(n < MIN_PERIODS, F.concat(F.lit("too little evidence: only "), n.cast("string"), F.lit(" windows")))
        .when(m > 0.15, "suspicious: look for a data leak")
        .when(t > 2.5, "consistent signal")
        .when(t > 1.5, "weak signal, not conclusive")
        .otherwise("no evidence of a signal")
    )
    return summary.select("horizon", "grp", "ic_mean", F.bround(t, 2).alias("t_stat"), "periods", (~none & (n >= MIN_PERIODS) & (m <= 0.15)).alias("usable"), said.alias("verdict"))


def evidence_weights(judged: DataFrame, horizons: tuple[str, ...] = ("short", "medium", "long")) -> DataFrame:
    """horizon, weight: share of the median t above 1 (at most 3) of its usable rows; equal shares if none has any."""
    spark = judged.sparkSession
    names = spark.createDataFrame([(h,) for h in horizons], "horizon string")
    rows = judged.where("usable") if "usable" in judged.columns else judged
    power = rows.groupBy("horizon").agg(F.least(F.greatest(F.median("t_stat") - 1, F.lit(0.0)), F.lit(3.0)).alias("power"))
    every = Window.partitionBy()
    out = names.join(power, "horizon", "left").withColumn("power", F.coalesce("power", F.lit(0.0)))
    return out.select("horizon", F.coalesce(F.try_divide(F.col("power"), F.sum("power").over(every)), F.lit(1.0 / len(horizons))).alias("weight"))
