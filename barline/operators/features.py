"""The feature history of each symbol, its sample at rebalance dates, and forward returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.functions import rolling as r
from barline.operators.ewm import with_ewm
from barline.sources.shared import dealt, tasks_for

# Sessions ahead of each horizon.
HORIZONS = {"short": 10, "medium": 63, "long": 252}
LIQUID_GROUPS = ("fx", "index")

FEATURES = (
    "ma20_dist ma50_dist ma200_dist ma50_over_200 slope_3m trendfit_3m slope_12m trendfit_12m adx14 "
    "ret_1w ret_1m ret_3m ret_6m ret_12m mom_12_1 rsi14 rsi2 macd_hist "
    "vol_21 vol_252 vol_ratio atr_pct dd_from_high ulcer_6m sharpe_12m sortino_6m "
    "donch_20 donch_252 boll_z gap_ratio vol_surge dollar_vol beta_6m alpha_6m rs_3m rs_12m"
).split()


def benchmark(bars: DataFrame, symbol: object = None) -> DataFrame:
    """sess, bench: the close of a symbol, or the mean close of all, per session."""
    if symbol is not None:
        return bars.where(F.col("symbol") == symbol).select("sess", F.col("close").alias("bench"))
    return bars.groupBy("sess").agg(F.avg("close").alias("bench"))


def benchmark_windows(bench: DataFrame, n: int = 126) -> DataFrame:
    """The benchmark's log return and its variance and mean over n sessions; one row for each session."""
    w = Window.orderBy("sess").rangeBetween(-(n - 1), 0)
    back = F.ln(F.try_divide("bench", F.max("bench").over(Window.orderBy("sess").rangeBetween(-1, -1))))
    out = bench.withColumn("bench_r", back)
    enough = F.count("bench_r").over(w) >= n // 2
    return out.withColumns({"bench_var": F.when(enough, F.var_samp("bench_r").over(w)), "bench_mean": F.when(enough, F.avg("bench_r").over(w))})


def build_features(bars: DataFrame, bench: DataFrame | None = None, ewm: bool = True) -> DataFrame:
    """bars (symbol, grp, date, sess, open, high, low, close, volume) with all FEATURES.

    Without ewm, those that need a recurrence (adx14, rsi14, rsi2, macd_hist, atr_pct) are left out, and the
    whole stays in built-in functions. Windows count sessions of the common calendar. Bars should be a saved table: they are
    counted, and dealt over so many tasks that each holds as many of them however many there are.
    """
    c = F.col("close")
    side = benchmark_windows(benchmark(bars) if bench is None else bench)
    tasks = tasks_for(bars)
    bars = bars.withColumn("dv", c * F.col("volume"))
    df = with_ewm(bars, tasks) if ewm else dealt(bars, tasks, "symbol", "sess")
    df = r.joined(df, r.medians(bars, {"volume_20": ("volume", 20), "dv_63": ("dv", 63)}, tasks))
    df = dealt(df, tasks, "symbol").join(F.broadcast(side), "sess", "left")  # a row for each session
    df = r.with_extremes(df, "close", {"low_20": ("min", 20), "high_20": ("max", 20), "high_126": ("max", 126), "low_252": ("min", 252), "high_252": ("max", 252)})
    df = df.withColumns({"before": r.at(c, -1), "logp": F.when(c > 0, F.ln(c)), "rel": F.try_divide(c, F.col("bench")), "drop126": r.drawdown(c, F.col("high_126"))})
    df = r.centred(r.in_units(df, "close", "unit"), "logp", "level")
    df = df.withColumn("ret", F.ln(F.try_divide(c, F.col("before"))))
    w = r.Windows()
    vol = w.volatility("ret", 252)
    out = {
        "ma20_dist": w.distance_to_sma("unit", 20),
        "ma50_dist": w.distance_to_sma("unit", 50),
        "ma200_dist": w.distance_to_sma("unit", 200),
        "ma50_over_200": r.ratio(w.sma("unit", 50), w.sma("unit", 200)) - 1,
        "slope_3m": w.slope("level", 63),
        "trendfit_3m": w.fit("level", 63),
        "slope_12m": w.slope("level", 252),
        "trendfit_12m": w.fit("level", 252),
        "vol_21": w.volatility("ret", 21),
        "vol_252": vol,
        "vol_ratio": r.ratio(w.volatility("ret", 21), vol),
        "dd_from_high": r.drawdown(c, F.col("high_252")),
        "ulcer_6m": w.ulcer("drop126", 126),
        "sortino_6m": w.sortino("ret", 126),
        "donch_20": w.donchian("close", "low_20", "high_20", 20),
        "donch_252": w.donchian("close", "low_252", "high_252", 252),
        "boll_z": w.bollinger("unit", 20),
        "gap_ratio": w.gap_ratio("open", "close", "before"),
        "vol_surge": w.surge("volume", "volume_20", 20),
        "dollar_vol": w.guarded(F.col("dv_63"), "dv", 63, 21),
        "beta_6m": w.beta("ret", "bench_r", "bench_var", 126),
        "_mean_6m": w.guarded(w.mean("ret", 126), "ret", 126, 63),
    }
    reads = {f"_ago_{n}": r.at(c, -n) for n in (5, 21, 63, 126, 252)} | {f"_rel_{n}": r.at(F.col("rel"), -n) for n in (63, 252)}
    df = w.add(df.withColumns(reads), out)
    changed = {"ret_1w": 5, "ret_1m": 21, "ret_3m": 63, "ret_6m": 126, "ret_12m": 252}
    out = {f: r.ratio(c, F.col(f"_ago_{n}")) - 1 for f, n in changed.items()}
    out |= {"mom_12_1": r.ratio(F.col("_ago_21"), F.col("_ago_252")) - 1, "sharpe_12m": r.ratio(out["ret_12m"], F.col("vol_252"))}
    out |= {f: r.ratio(F.col("rel"), F.col(f"_rel_{n}")) - 1 for f, n in (("rs_3m", 63), ("rs_12m", 252))}
    out |= {"alpha_6m": (F.col("_mean_6m") - F.col("beta_6m") * F.col("bench_mean")) * 252}
    if ewm:
        out |= {"atr_pct": r.ratio(F.col("atr14"), c)}
    df = df.withColumns(out)
    have = [f for f in FEATURES if f in df.columns]
    return df.select("symbol", "grp", "date", "sess", "open", "high", "low", "close", "volume", *have)


def sample_panel(features: DataFrame, dates: DataFrame, min_dollar_volume: float = 1e6, exempt: tuple[str, ...] = LIQUID_GROUPS) -> DataFrame:
    """Rows of the rebalance dates that are liquid enough (some groups are exempt); numbers as floats, as they are scored."""
    rows = features.join(F.broadcast(dates.select("date").distinct()), "date", "left_semi")  # a row for each date
    liquid = (F.coalesce("dollar_vol", F.lit(0.0)) >= min_dollar_volume) | F.col("grp").isin(*exempt)
    rows = rows.where(F.col("close").isNotNull() & liquid)
    numbers = [f for f in (*FEATURES, "close") if f in rows.columns]
    return rows.withColumns({f: F.col(f).cast("float") for f in numbers})


def forward_returns(bars: DataFrame, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """date, symbol, fwd_<horizon>: return over the sessions that follow; only for validation. Bars are counted, and dealt as those of ``build_features``."""
    c = F.col("close")
    return dealt(bars.select("date", "symbol", "sess", "close"), tasks_for(bars), "symbol").select("date", "symbol", *[(r.ratio(r.at(c, n), c) - 1).alias(f"fwd_{h}") for h, n in horizons.items()])
