"""Exponentially weighted indicators in built-in functions: recurrences as a scan of affine steps.

A step of an exponential average is y -> factor * y + addend. Steps compose, so y is the sum of all addends, each times the factors after it.
With E, the sum of -log(factor) up to a bar, that weight is exp(E of the addend - E of the bar). E cuts each history into blocks of DECAY: inside
a block the weights stay within what a double holds, so a running sum serves all its bars. Blocks are then joined: each takes up what the
one before it ends with, BACK times over; what is older has decayed below the rounding of a double.

A gap decays what came before it: after d sessions the old value has the weight (1-a)^d against a of the new one. Averages of values that are
carried through gaps (the signal line, adx) and of moves that are zero there decay once for each session.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from barline.functions.rolling import joined
from barline.sources.shared import dealt, tasks_for

INDICATORS = ("ema12", "ema26", "rsi14", "rsi2", "macd_hist", "atr14", "adx14")
DECAY, BACK = 18, 2



def _by_session() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("sess")


def _so_far() -> WindowSpec:
    return _by_session().rowsBetween(Window.unboundedPreceding, 0)


class Sum:
    """A running sum whose addends decay: E = sessions * -log(1-a) + extra; addends: name -> column."""

    def __init__(self, a: float, sessions: Column, addends: dict[str, Column], extra: Column | None = None):
        self.rate, self.sessions, self.addends = -math.log1p(-a), sessions, addends
        self.extra = F.lit(0.0) if extra is None else extra


def weighted_sums(rows: DataFrame, sums: list[Sum]) -> DataFrame:
    """Adds to each row, for each sum, all its addends up to it, each times exp(E there - E here).

    All share the blocks of the first one, the slowest: one sort, then frames that only grow. Differences of E are taken of its two parts, the
    whole sessions and the rest, so they stay exact however long a history is.
    """
    kept, many = rows.columns, range(len(sums))
    parts = {f"_{part}{k}": c for k, s in enumerate(sums) for part, c in (("d", s.sessions.cast("long")), ("x", s.extra))}
    rows = rows.withColumns(parts | {"_b": F.floor((sums[0].sessions * sums[0].rate + sums[0].extra) / DECAY)})
    own = Window.partitionBy("symbol", "_b").orderBy("sess").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("symbol").orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)  # its last row ends the block before
    rows = rows.withColumns({f"_f{c}": F.first(c).over(own) for c in parts})
    # Reading _f as well, this window comes after the other and finds its sort, by session within a block; alone, Spark would put it first, with a sort by block.
    rows = rows.withColumn("_end", F.last(F.struct(*parts, *[f"_f{c}" for c in parts])).over(earlier)).withColumns({f"_l{c}": F.col(f"_end.{c}") for c in parts})

    def since(k: int, here: str) -> Column:
        return F.exp((F.col(f"{here}_d{k}") - F.col(f"_f_d{k}")) * sums[k].rate + (F.col(f"{here}_x{k}") - F.col(f"_f_x{k}")))

    rows = rows.withColumns({f"_s{k}": since(k, "") for k in many} | {f"_g{k}": since(k, "_l") for k in many})
    names = {name: k for k, s in enumerate(sums) for name in s.addends}
    rows = rows.withColumns({f"_h_{name}": F.coalesce(sums[k].addends[name], F.lit(0.0)) * F.col(f"_s{k}") for name, k in names.items()})
    rows = rows.withColumns({f"_h_{name}": F.sum(f"_h_{name}").over(own) for name in names})
    rows = rows.withColumns({name: F.col(f"_h_{name}") / F.col(f"_s{k}") for name, k in names.items()})
    for _ in range(BACK):
        rows = rows.withColumns({f"_c_{name}": F.last(name).over(earlier) for name in names})
        rows = rows.withColumns({name: (F.col(f"_h_{name}") + F.coalesce(F.col(f"_c_{name}") * F.col(f"_g{k}"), F.lit(0.0))) / F.col(f"_s{k}") for name, k in names.items()})
    return rows.select(*kept, *names)


PATTERNS = {"c": "close", "m": "_gain", "r": "_range"}


def _places(rows: DataFrame) -> DataFrame:
    """Adds how far the values of each pattern have come: sessions since the first, their number, distance from the one before."""
    out = {}
    for p, x in PATTERNS.items():
        at = F.when(F.col(x).isNotNull(), F.col("sess"))
        out |= {f"_{p}_n": F.count(at).over(_so_far()), f"_{p}_d": at - F.last(at, True).over(_by_session().rowsBetween(Window.unboundedPreceding, -1)), f"_{p}_age": F.coalesce(F.last(at, True).over(_so_far()) - F.first(at, True).over(_so_far()), F.lit(0))}
    return rows.withColumns(out)


def _left(p: str, a: float) -> Column:
    """Weight of the old value next to ``a`` of the new one."""
    return F.pow(F.lit(1 - a), F.col(f"_{p}_d"))


def _average(p: str, a: float, columns: dict[str, str]) -> Sum:
    """Exponential averages with gaps; name -> value."""
    d = F.col(f"_{p}_d")
    share = F.when(d.isNull(), 1.0).when(d == 1, a).otherwise(F.lit(a) / (_left(p, a) + a))
    return Sum(a, F.col(f"_{p}_age"), {name: F.col(x) * share for name, x in columns.items()}, F.col(f"_{p}_{round(1000 / a)}"))


def _carried(x: str, a: float) -> Column:
    """Addends of an average of x, which keeps its value through gaps; weight 1 for its first value."""
    before, d = F.lag(x).over(_by_session()), F.col("sess") - F.lag("sess").over(_by_session())
    return F.when(before.isNull(), F.col(x)).otherwise((1 - F.pow(F.lit(1 - a), d - 1)) * (1 - a) * before + a * F.col(x))


def indicators(bars: DataFrame, tasks: int | None = None) -> DataFrame:
    """symbol, sess and INDICATORS, a row for each session with a bar.

    Histories are dealt by symbol over so many tasks (by the number of bars, if not given): a task sorts its share many times over.
    Of bars that repeat a symbol and session the one of the greatest close counts, then of the greatest high and low.
    """
    number = {c: F.col(c).cast("double").alias(c) for c in ("close", "high", "low")}
    own = dealt(bars.where("symbol is not null and sess is not null"), tasks or tasks_for(bars), "symbol")
    one = own.groupBy("symbol", F.col("sess").cast("long").alias("sess")).agg(F.max(F.struct(*number.values())).alias("bar"))
    rows = one.select("symbol", "sess", "bar.close", "bar.high", "bar.low")
    rows = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in number})
    follows = F.lag("sess").over(_by_session()) == F.col("sess") - 1
    rows = rows.withColumns({f"_{c}": F.when(follows, F.lag(c).over(_by_session())) for c in number})
    move, up, down = F.col("close") - F.col("_close"), F.col("high") - F.col("_high"), F.col("_low") - F.col("low")
    zero = F.lit(0.0)
    rows = rows.withColumns(
        {
            "_gain": F.when(move.isNotNull(), F.greatest(move, zero)),
            "_loss": F.when(move.isNotNull(), F.greatest(-move, zero)),
            "_plus": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
            "_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_close")), F.abs(F.col("low") - F.col("_close"))),
        }
    )
    rows = _places(rows)
    ema12, ema26, w14, w2, nine = 2 / 13, 2 / 27, 1 / 14, 1 / 2, 2 / 10
    gaps = {}  # the logarithms of the weights that gaps leave, as running sums
    for p, a in (("c", ema12), ("c", ema26), ("m", w14), ("m", w2), ("r", w14)):
        left = F.when(F.col(f"_{p}_d") > 1, F.ln(_left(p, a) + a)).otherwise(0.0)
        gaps[f"_{p}_{round(1000 / a)}"] = F.sum(left).over(_so_far())
    rows = rows.withColumns(gaps)
    closes = [_average("c", ema26, {"_ema26": "close"}), _average("c", ema12, {"_ema12": "close"})]
    moves, quick = [_average("m", w14, {"_gain14": "_gain", "_loss14": "_loss"})], [_average("m", w2, {"_gain2": "_gain", "_loss2": "_loss"})]
    ranges, turns = [_average("r", w14, {"_atr14": "_range"})], [Sum(w14, F.col("sess"), {"_up": F.col("_plus") * w14, "_down": F.col("_minus") * w14})]
    for group in (closes, moves, quick, ranges, turns):
        rows = weighted_sums(rows, group)
    least = {"_ema12": ("c", 6), "_ema26": ("c", 13), "_gain14": ("m", 14), "_loss14": ("m", 14), "_gain2": ("m", 2), "_loss2": ("m", 2), "_atr14": ("r", 14)}
    known = {x: F.when(F.col(f"_{p}_n") >= n, F.col(x)) for x, (p, n) in least.items()}
    wide = F.when(F.col("sess") >= 14, 100 / F.nullif(known["_atr14"], zero))
    plus, minus = F.col("_up") * wide, F.col("_down") * wide
    rows = rows.withColumns(known | {"_dx": F.try_divide(100 * F.abs(plus - minus), plus + minus), "_line": known["_ema12"] - known["_ema26"]})
    rows = rows.withColumns({"_dx_from": F.min(F.when(F.col("_dx").isNotNull(), F.col("sess"))).over(_so_far()), "_dx_in": _carried("_dx", w14), "_line_in": _carried("_line", nine)})
    rows = weighted_sums(rows, [Sum(w14, F.col("sess"), {"_adx": F.col("_dx_in")}), Sum(nine, F.col("sess"), {"_signal": F.col("_line_in")})])
    rsi = {f"rsi{n}": F.coalesce(100 - 100 / (1 + F.try_divide(f"_gain{n}", f"_loss{n}")), F.lit(50.0)) for n in (14, 2)}
    out = rows.withColumns(rsi | {"macd_hist": F.try_divide(F.col("_line") - F.col("_signal"), F.col("close")), "adx14": F.when(F.col("sess") - F.col("_dx_from") >= 13, F.col("_adx"))})
    named = {"ema12": "_ema12", "ema26": "_ema26", "atr14": "_atr14"}
    return out.select("symbol", "sess", *[F.col(named.get(c, c)).alias(c) for c in INDICATORS])


def with_ewm(bars: DataFrame, tasks: int | None = None) -> DataFrame:
    """bars (symbol, sess, high, low, close, ...) with the columns of INDICATORS; other columns are kept. Null for rows without a symbol or session."""
    tasks = tasks or tasks_for(bars)
    found = indicators(bars, tasks).withColumn("sess", F.col("sess").cast(bars.schema["sess"].dataType)).withColumnsRenamed({"symbol": "_symbol", "sess": "_sess"})
    bars, found = dealt(bars, tasks, "symbol", "sess"), dealt(found, tasks, "_symbol", "_sess")
    return joined(bars, found)
