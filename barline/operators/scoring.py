"""Cross-sectional scores: winsorised z-scores within (date, grp), weighted by horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from barline.sources.shared import beside, dealt, panel_tasks_for, saved

# Signed weights of the features of each horizon.
WEIGHTS: dict[str, dict[str, float]] = {
    "short": {"donch_20": 0.16, "macd_hist": 0.14, "ma20_dist": 0.10, "adx14": 0.10, "vol_surge": 0.08, "rs_3m": 0.08, "rsi2": -0.14, "ret_1w": -0.10, "boll_z": -0.06, "vol_ratio": -0.04},
    "medium": {"ret_3m": 0.18, "rs_3m": 0.18, "ma50_over_200": 0.14, "trendfit_3m": 0.10, "dd_from_high": 0.09, "adx14": 0.06, "macd_hist": 0.05, "alpha_6m": 0.05, "vol_ratio": -0.09, "ulcer_6m": -0.06},
    "long": {"mom_12_1": 0.22, "trendfit_12m": 0.15, "slope_12m": 0.14, "rs_12m": 0.13, "sharpe_12m": 0.11, "ma200_dist": 0.05, "sortino_6m": 0.05, "vol_252": -0.10, "ulcer_6m": -0.05},
}
MIN_COVERAGE = 0.7
MIN_PEERS = 20
LOW, HIGH = 0.025, 0.975



def peers_window() -> WindowSpec:
    return Window.partitionBy("date", "grp")


def _number(feature: str) -> Column:
    return F.col(feature).cast("double")


def with_z(rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds peers, and n_<feature> (non-null peers) and z_<feature> of each feature, within (date, grp).

    Two aggregates, quantiles first and then moments of the clipped values, are saved and joined back. They have a row for each date and
    group and are counted, so the wide rows are not sorted to join them. For the quantiles, which keep every value, groups are
    dealt over tasks by the number of rows; moments are first reduced where the rows are. Under five values z is null; without spread it
    is 0 for every row, values or not. rows should be a saved table.
    """
    keys, tasks = ["date", "grp"], panel_tasks_for(rows)
    quantiles = {f: F.percentile(_number(f), F.array(F.lit(LOW), F.lit(HIGH))).alias(f"q_{f}") for f in features}
    held = dealt(rows, tasks, *keys).groupBy(*keys).agg(F.count("*").alias("peers"), *[F.count(f).alias(f"n_{f}") for f in features], *quantiles.values())
    rows = beside(rows, saved(held, "quantiles"), 64 * len(features), tasks, *keys)  # two numbers in an array and a count
    clipped = {f"c_{f}": F.when(F.col(f).isNotNull(), F.least(F.greatest(_number(f), F.get(f"q_{f}", F.lit(0))), F.get(f"q_{f}", F.lit(1)))) for f in features}
    rows = rows.withColumns(clipped).drop(*[f"q_{f}" for f in features])
    moments = rows.groupBy(*keys).agg(*[F.avg(f"c_{f}").alias(f"m_{f}") for f in features], *[F.stddev_pop(f"c_{f}").alias(f"s_{f}") for f in features])
    rows = beside(rows, saved(moments, "moments"), 24 * len(features), tasks, *keys)  # two numbers

    def z(f: str) -> Column:
        spread = F.col(f"s_{f}")
        return F.when(F.col(f"n_{f}") < 5, F.lit(None).cast("double")).when(F.coalesce(spread, F.lit(0.0)) == 0, 0.0).otherwise(F.try_divide(F.col(f"c_{f}") - F.col(f"m_{f}"), spread))

    return rows.withColumns({f"z_{f}": z(f) for f in features}).drop(*[f"{k}_{f}" for k in "cms" for f in features])


def z_scores(rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """date, grp, keep, peers, feature, value, n, z: a row for each feature."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), _number(f).alias("value"), F.col(f"n_{f}").alias("n"), F.col(f"z_{f}").alias("z")) for f in features]))
    return with_z(saved(rows, "panel"), features).select("date", "grp", *keep, "peers", each.alias("x")).select("date", "grp", *keep, "peers", "x.*")


def _total(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def score_columns(weights: dict[str, float], horizon: str, min_coverage: float = MIN_COVERAGE) -> list[dict[str, Column]]:
    """Three steps of columns that end in score_, cov_ and spread_ of a horizon; a feature without any z is not usable."""
    z = {f: F.col(f"z_{f}") for f in weights}
    n, total, mean, sd = (F.col(f"_{k}_{horizon}") for k in ("n", "total", "mean", "sd"))
    present, usable = F.col(f"_present_{horizon}"), F.col(f"_usable_{horizon}")
    sums = {
        f"_usable_{horizon}": _total([F.when(F.col(f"n_{f}") >= 5, abs(w)).otherwise(0.0) for f, w in weights.items()]),
        f"_present_{horizon}": _total([F.when(z[f].isNotNull(), abs(w)).otherwise(0.0) for f, w in weights.items()]),
        f"_total_{horizon}": _total([F.coalesce(z[f] * w, F.lit(0.0)) for f, w in weights.items()]),
        f"_n_{horizon}": _total([z[f].isNotNull().cast("double") for f in weights]),
        f"_mean_{horizon}": F.try_divide(_total([F.coalesce(z[f] if w > 0 else -z[f], F.lit(0.0)) for f, w in weights.items()]), _total([z[f].isNotNull().cast("double") for f in weights])),
    }
    around = _total([F.coalesce(F.pow((z[f] if w > 0 else -z[f]) - mean, F.lit(2)), F.lit(0.0)) for f, w in weights.items()])
    enough, cover = F.col("peers") >= MIN_PEERS, F.try_divide(present, usable)
    said = {
        f"score_{horizon}": F.when(enough & (n > 0) & (cover >= min_coverage), F.try_divide(total, present)),
        f"cov_{horizon}": F.when(enough, cover),
        f"spread_{horizon}": F.when(enough & (n > 1), sd),
    }
    return [sums, {f"_sd_{horizon}": F.sqrt(F.try_divide(around, n - 1))}, said]


def average_rank(value: str, peers: list[str]) -> Column:
    """Rank from 1 among non-null values; equal values share their mean rank."""
    order = Window.partitionBy(*peers).orderBy(F.col(value).asc_nulls_last())
    ties = F.count(value).over(Window.partitionBy(*peers, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(order) + (ties - 1) / 2)


def score_panel(panel: DataFrame, weights: dict[str, dict[str, float]] = WEIGHTS) -> DataFrame:
    """date, symbol, grp, close, score_/cov_/spread_/pct_ of each horizon, score_global. Rows without a group are left out."""
    used = {h: {f: w for f, w in ws.items() if f in panel.columns} for h, ws in weights.items()}
    features = sorted({f for ws in used.values() for f in ws})
    panel = saved(panel.where("grp is not null").select("date", "symbol", "grp", "close", *features), "panel")
    rows = with_z(panel, features)
    steps = [score_columns(ws, h) for h, ws in used.items()]
    for k in range(3):
        rows = rows.withColumns({name: c for step in steps for name, c in step[k].items()})
    rows = dealt(rows.select("date", "symbol", "grp", "close", *[name for step in steps for name in step[2]]), panel_tasks_for(panel), "date", "grp")
    share = {f"pct_{h}": F.bround(F.try_divide(average_rank(f"score_{h}", ["date", "grp"]), F.count(f"score_{h}").over(peers_window())) * 100, 1) for h in weights}
    mean = F.try_divide(_total([F.coalesce(f"score_{h}", F.lit(0.0)) for h in weights]), _total([F.when(F.col(f"score_{h}").isNotNull(), 1.0).otherwise(0.0) for h in weights]))
    return rows.withColumns(share).withColumn("score_global", mean)


def contributions(panel: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Of the last date: date, symbol, grp, feature, z (signed), weight, contribution, value. The panel is saved, so that finding the last date does not make it twice."""
    used = {f: w for f, w in weights.items() if f in panel.columns}
    panel = saved(panel.select("date", "symbol", "grp", *sorted(used)), "panel")
    day = panel.join(F.broadcast(panel.agg(F.max("date").alias("date"))), "date", "left_semi")  # one row
    rows = day.where("grp is not null")
    w = F.element_at(F.create_map(*[F.lit(x) for item in used.items() for x in item]), F.col("feature"))
    long = z_scores(rows, sorted(used), ["symbol"]).where(F.col("peers") >= MIN_PEERS).withColumns({"z": F.col("z") * F.signum(w), "weight": F.abs(w)})
    return long.select("date", "symbol", "grp", "feature", "z", "weight", (F.col("z") * F.col("weight")).alias("contribution"), "value")


def top_picks(scored: DataFrame, horizon: str, n: int = 25, groups: tuple[str, ...] | None = None, max_spread: float = 1.6) -> DataFrame:
    """The n best scores of the last date whose components agree; ties by symbol."""
    rows = scored.join(F.broadcast(scored.agg(F.max("date").alias("date"))), "date", "left_semi")  # one row
    if groups is not None:
        rows = rows.where(F.col("grp").isin(*groups))
    rows = rows.where(F.col(f"score_{horizon}").isNotNull() & (F.coalesce(f"spread_{horizon}", F.lit(9.0)) <= max_spread))
    return rows.orderBy(F.desc(f"score_{horizon}"), "symbol").limit(n)


def report_ranking(scored: DataFrame, horizon: str, n: int = 30) -> DataFrame:
    """Of the last date, by percentile (comparable between groups), then score, then symbol."""
    rows = scored.join(F.broadcast(scored.agg(F.max("date").alias("date"))), "date", "left_semi")  # one row
    return rows.where(F.col(f"score_{horizon}").isNotNull()).orderBy(F.desc_nulls_last(f"pct_{horizon}"), F.desc_nulls_last(f"score_{horizon}"), "symbol").limit(n)


def correlations(bars: DataFrame, symbols: list, window: int = 126) -> DataFrame:
    """a, b (a < b), corr of log returns over the last sessions, for a short list of symbols."""
    return _pairs(bars.where(F.col("symbol").isin(symbols)), bars, window)


def _pairs(some: DataFrame, bars: DataFrame, window: int) -> DataFrame:
    """Correlations of the symbols of some bars over the last sessions of all bars."""
    recent = some.join(F.broadcast(bars.agg(F.max("sess").alias("newest"))), F.col("sess") >= F.col("newest") - window)  # one row
    before = F.max("close").over(Window.partitionBy("symbol").orderBy("sess").rangeBetween(-1, -1))
    r = recent.withColumn("r", F.ln(F.try_divide("close", before))).where("r is not null").select("symbol", "sess", "r")
    x, y = r.select("sess", F.col("symbol").alias("a"), F.col("r").alias("x")), r.select("sess", F.col("symbol").alias("b"), F.col("r").alias("y"))
    return x.join(y, "sess").where("a < b").groupBy("a", "b").agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("corr"))


def redundant(bars: DataFrame, ranked: DataFrame, window: int = 126, max_corr: float = 0.8) -> DataFrame:
    """symbol, twin, corr: of a short ranked list (symbol, place; places from 1, no two alike) each symbol that moves with a better placed one that is kept.

    The twin is the kept symbol of the largest absolute correlation, the better placed one of equals. A symbol without a twin is kept itself, so
    the list is folded in its order; it has as many rows as the report shows, and is one array.
    """
    places = ranked.select("symbol", F.col("place").cast("int").alias("place"))
    both = _pairs(bars.join(places.select("symbol"), "symbol", "left_semi"), bars, window)
    a, b = (places.select(F.col("symbol").alias(k), F.col("place").alias(f"at_{k}")) for k in "ab")
    both = both.join(a, "a").join(b, "b").where(F.abs("corr") >= max_corr)
    # back: minus the place of the better one, so that of equal correlations it is the larger
    near = both.select(F.greatest("at_a", "at_b").alias("place"), F.struct(F.abs("corr").alias("corr"), (-F.least("at_a", "at_b")).alias("back")).alias("x")).groupBy("place").agg(F.collect_list("x").alias("near"))
    line = places.join(near, "place", "left").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("near", F.array().cast("array<struct<corr:double,back:int>>")).alias("near")))).alias("line"))

    def step(done: Column, x: Column) -> Column:
        twin = F.array_max(F.filter(x["near"], lambda n: F.array_contains(done["kept"], -n["back"])))
        kept = F.when(twin.isNull(), F.array_append(done["kept"], x["place"])).otherwise(done["kept"])
        return F.struct(kept.alias("kept"), F.when(twin.isNull(), done["found"]).otherwise(F.array_append(done["found"], F.struct(x["place"].alias("place"), (-twin["back"]).alias("twin"), twin["corr"].alias("corr")))).alias("found"))

    nothing = F.struct(F.array().cast("array<int>").alias("kept"), F.array().cast("array<struct<place:int,twin:int,corr:double>>").alias("found"))
    found = line.select(F.explode(F.aggregate("line", nothing, step)["found"]).alias("x")).select("x.*")
    better = places.select(F.col("symbol").alias("twin_symbol"), F.col("place").alias("twin"))
    return found.join(places, "place").join(better, "twin").select("symbol", F.col("twin_symbol").alias("twin"), "corr")
