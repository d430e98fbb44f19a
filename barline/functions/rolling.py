"""Column expressions over the sessions before a bar.

Frames run over session numbers, not over rows, so a missing bar holds its place in the window but is not
counted. All expressions of one table share the same partition and order: one exchange, one sort.

Counts, means, variances, covariances and regressions (``Windows``) are differences of two running sums: one up to the present session, one up
to the last session before the window. Spark carries both frames forward row by row, so a window costs the same whatever its length.
Such differences lose what the whole history outweighs the window: prices should be in units of their own mean and logarithms centred (see
``in_units``, ``centred``), places are counted from the middle of the history, and a variance under the rounding of the running sum
counts as none. NaN and infinities count as missing.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from barline.sources.shared import dealt, tasks_for

#: A sum of squares below this share of the running sum is rounding: the window counts as constant.
NOISE = 4e-15


def so_far(ago: int = 0) -> WindowSpec:
    """All sessions up to the one ``ago`` sessions before; a frame that only grows."""
    return Window.partitionBy("symbol").orderBy("sess").rangeBetween(Window.unboundedPreceding, -ago)


def whole() -> WindowSpec:
    return Window.partitionBy("symbol")


def in_units(df: DataFrame, x: str, name: str) -> DataFrame:
    """Adds ``name``: x over the mean size of x of the symbol; null where that is zero."""
    return df.withColumn(name, F.try_divide(x, F.avg(F.abs(x)).over(whole())))


def centred(df: DataFrame, x: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(x) - F.avg(x).over(whole()))


def at(x: Column, k: int) -> Column:
    """The value k sessions later (earlier if negative); null if there is no bar."""
    return F.max(x).over(Window.partitionBy("symbol").orderBy("sess").rangeBetween(k, k))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def change(x: Column, n: int) -> Column:
    return ratio(x, at(x, -n)) - 1


def momentum(x: Column, n: int, skip: int = 21) -> Column:
    return ratio(at(x, -skip), at(x, -n)) - 1


def log_return(x: Column) -> Column:
    return F.ln(ratio(x, at(x, -1)))


def true_range(high: Column, low: Column, close_before: Column) -> Column:
    return F.greatest(high - low, F.abs(high - close_before), F.abs(low - close_before))


def drawdown(x: Column, top: Column | None = None) -> Column:
    """From the highest value so far, or from ``top``, the highest of a window (see ``with_extremes``)."""
    return ratio(x, F.max(x).over(so_far()) if top is None else top) - 1


class Windows:
    """Statistics of columns over the last n sessions; x and y name columns or are SQL.

    Each method returns an expression over running sums, of which every one is made once, however many statistics use it;
    ``add`` adds the sums that were asked for, evaluates the expressions, and takes the sums away again.
    """

    def __init__(self) -> None:
        self.running: dict[str, tuple[str, str]] = {}
        self.back: dict[str, tuple[str, int]] = {}

    def _window(self, what: str, n: int) -> Column:
        """A running sum or count, up to now less up to before the window."""
        name = self._name(what)
        before = f"{name}_{n}"
        self.back[before] = (name, n)
        return F.expr(f"{name} - coalesce({before}, 0)")

    def _name(self, what: str) -> str:
        return self.running.setdefault(what, (f"_w{len(self.running)}", what))[0]

    @staticmethod
    def _sound(x: str) -> str:
        return f"if(abs({x}) < 1e300, cast({x} as double), null)"

    def count(self, x: str, n: int) -> Column:
        return self._window(f"count({self._sound(x)})", n)

    def total(self, x: str, n: int) -> Column:
        return self._window(f"sum({self._sound(x)})", n)

    def mean(self, x: str, n: int) -> Column:
        return F.try_divide(self.total(x, n), self.count(x, n))

    def guarded(self, value: Column, x: str, n: int, least: int) -> Column:
        return F.when(self.count(x, n) >= least, value)

    def around(self, x: str, n: int) -> Column:
        """Sum of squares around the mean; 0 where it is rounding."""
        squares, m, s = self.total(f"{x} * {x}", n), self.count(x, n), self.total(x, n)
        left = squares - F.try_divide(s * s, m)
        noise = F.col(self._name(f"sum({self._sound(f'{x} * {x}')})")) * NOISE
        return F.when(left > noise, left).otherwise(F.when(m > 0, 0.0))

    def deviation(self, x: str, n: int) -> Column:
        m = self.count(x, n)
        return F.when(m >= 2, F.sqrt(self.around(x, n) / (m - 1)))

    def leaning(self, y: str, n: int) -> Column:
        """Of a full window: sum over its sessions of their distance from the middle, times y."""
        return self.total(f"{y} * (sess - _middle)", n) - self.total(y, n) * (F.col("sess") - (n - 1) / 2 - F.col("_middle"))

    def sma(self, x: str, n: int) -> Column:
        return self.guarded(self.mean(x, n), x, n, max(2, n // 2))

    def distance_to_sma(self, x: str, n: int) -> Column:
        return ratio(F.col(x), self.sma(x, n)) - 1

    def volatility(self, r: str, n: int) -> Column:
        """Annualised, of log returns."""
        return self.guarded(self.deviation(r, n), r, n, n // 2) * math.sqrt(252)

    def slope(self, y: str, n: int) -> Column:
        """Annualised slope of the regression on the session number, full windows only. y: log price, best centred."""
        return self.guarded(self.leaning(y, n) / (n * (n * n - 1) / 12), y, n, n) * 252

    def fit(self, y: str, n: int) -> Column:
        """R squared of that regression; null for constant y."""
        lean = self.leaning(y, n)
        r2 = F.try_divide(lean * lean, self.around(y, n) * (n * (n * n - 1) / 12))
        return self.guarded(F.when(r2.isNotNull(), F.least(r2, F.lit(1.0))), y, n, n)

    def ulcer(self, drop: str, n: int) -> Column:
        """Root mean square of drawdowns from the running maximum of the same length."""
        return F.sqrt(self.guarded(self.mean(f"{drop} * {drop}", n), drop, n, n // 2))

    def donchian(self, x: str, low: str, high: str, n: int) -> Column:
        """Place of x between the extremes of its window."""
        return self.guarded(ratio(F.col(x) - F.col(low), F.col(high) - F.col(low)), x, n, n // 3)

    def bollinger(self, x: str, n: int) -> Column:
        return self.guarded(ratio(F.col(x) - self.mean(x, n), self.deviation(x, n)), x, n, n // 2)

    def surge(self, x: str, middle: str, n: int) -> Column:
        """x over the median of its window (see ``with_medians``)."""
        return ratio(F.col(x), self.guarded(F.col(middle), x, n, n // 2))

    def sortino(self, r: str, n: int) -> Column:
        """Mean log return over the root mean square of its losses; sessions without a return are zeros there."""
        loss = f"(case when {r} < 0 then {r} * {r} else 0.0 end)"
        present = F.least(F.col("sess"), F.lit(n))  # sessions of the window, whether or not there is a bar
        down = F.when(present >= n // 2, F.sqrt(self.total(loss, n) / present))
        return ratio(self.guarded(self.mean(r, n), r, n, n // 2) * math.sqrt(252), down)

    def gap_ratio(self, open_: str, close: str, before: str, n: int = 63) -> Column:
        gap, all_ = f"abs(try_divide({open_}, {before}) - 1)", f"abs(try_divide({close}, {before}) - 1)"
        return ratio(self.guarded(self.total(gap, n), gap, n, n // 3), self.guarded(self.total(all_, n), all_, n, n // 3))

    def beta(self, r: str, bench: str, bench_var: str, n: int) -> Column:
        """bench: the benchmark's return on the same row; bench_var: its variance over the window, gaps or not."""
        x, y, both = f"({r} + 0 * {bench})", f"({bench} + 0 * {r})", f"({r} * {bench})"
        m = self.count(both, n)
        together = F.try_divide(self.total(both, n) - F.try_divide(self.total(x, n) * self.total(y, n), m), m - 1)
        return ratio(F.when(m >= n // 2, together), F.col(bench_var))

    def add(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        kept, by = df.columns, "over (partition by symbol order by sess range between unbounded preceding and"
        zero = {name: "coalesce(" if what.startswith("sum") else "(" for name, what in self.running.values()}
        df = df.withColumn("_middle", F.expr("avg(sess) over (partition by symbol)"))
        df = df.select("*", *[F.expr(f"{zero[name]}{what} {by} current row){', 0)' if zero[name] == 'coalesce(' else ')'} as {name}") for name, what in self.running.values()])
        df = df.select("*", *[F.expr(f"last({name}) {by} {n} preceding) as {before}") for before, (name, n) in self.back.items()])
        return df.select(*[c for c in kept if c not in columns], *[c.alias(name) for name, c in columns.items()])


def with_extremes(df: DataFrame, x: str, windows: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds the max or min of x over the last n sessions: windows has name -> ("max" or "min", n).

    Sessions are cut into blocks of n. A window is the end of one block and the beginning of the next: a running extreme up to the present
    session, and one that runs backwards, read where the window begins. Two sorts for each n, whatever its length.
    """
    own, sizes = Window.partitionBy("symbol").orderBy("sess"), sorted({n for _, n in windows.values()})
    kept = df.columns
    agg, pick = {"max": F.max, "min": F.min}, {"max": F.greatest, "min": F.least}
    df = df.withColumns({f"_block_{n}": F.floor(F.col("sess") / n) for n in sizes})
    running = {}
    for name, (kind, n) in windows.items():
        parts = Window.partitionBy("symbol", f"_block_{n}")
        running[f"_rest_{name}"] = agg[kind](x).over(parts.orderBy(F.desc("sess")).rangeBetween(Window.unboundedPreceding, 0))
        running[f"_run_{name}"] = agg[kind](x).over(parts.orderBy("sess").rangeBetween(Window.unboundedPreceding, 0))
    df = df.withColumns(running)
    rests = {n: F.struct(f"_block_{n}", *[f"_rest_{name}" for name, (_, size) in windows.items() if size == n]) for n in sizes}
    df = df.withColumns({f"_next_{n}": F.lead(rests[n]).over(own) for n in sizes} | {f"_here_{n}": rests[n] for n in sizes})
    # The first bar of the window: the one after the last bar before it, else the first of all.
    first = {n: F.when(F.count("sess").over(so_far(n)) > 0, F.last(f"_next_{n}").over(so_far(n))).otherwise(F.first(f"_here_{n}").over(so_far())) for n in sizes}
    df = df.withColumns({f"_first_{n}": c for n, c in first.items()})
    found = [pick[kind](F.col(f"_run_{name}"), F.when(F.col(f"_first_{n}._block_{n}") < F.col(f"_block_{n}"), F.col(f"_first_{n}._rest_{name}"))).alias(name) for name, (kind, n) in windows.items()]
    return df.select(*kept, *found)


def with_medians(df: DataFrame, windows: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds the median of a column over the last n sessions: windows has name -> (column, n); null without a value."""
    tasks = tasks_for(df)
    return joined(dealt(df, tasks, "symbol", "sess"), medians(df, windows, tasks))


def joined(df: DataFrame, found: DataFrame) -> DataFrame:
    """df with the columns of ``found``, which has a row for each _symbol and _sess; where both are dealt by these over as many tasks, no row moves."""
    return df.join(found, (F.col("symbol") == F.col("_symbol")) & (F.col("sess") == F.col("_sess")), "left").drop("_symbol", "_sess")


def medians(df: DataFrame, windows: dict[str, tuple[str, int]], tasks: int) -> DataFrame:
    """_symbol, _sess and the medians, dealt by both over so many tasks.

    A sorted window takes one value in and lets one out for each bar. Only (symbol, sess, value) goes through Arrow; a task
    holds one window at a time. Bars that repeat a symbol and session share the medians of all of them.
    """
    values = sorted({c for c, _ in windows.values()})
    symbol = df.schema["symbol"].dataType.simpleString()
    narrow = df.select("symbol", F.col("sess").cast("long").alias("sess"), *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(values)])
    wanted = [(values.index(c), n) for c, n in windows.values()]

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliding = SlidingMedians(wanted)
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols, sessions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = zip(*(batch.column(k + 2).to_pylist() for k in range(len(values))), strict=True)
            found = [sliding.add(a, b, r) for a, b, r in zip(symbols, sessions, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.float64()) for c in zip(*found, strict=True))], names=["symbol", "sess", *windows])

    schema = f"symbol {symbol}, sess long, " + ", ".join(f"`{name}` double" for name in windows)
    found = dealt(narrow.where("symbol is not null"), tasks, "symbol").sortWithinPartitions("symbol", "sess").mapInArrow(slide, schema)
    found = dealt(found.withColumn("_turn", F.monotonically_increasing_id()).withColumn("sess", F.col("sess").cast(df.schema["sess"].dataType)), tasks, "symbol", "sess")
    last_bar = Window.partitionBy("symbol", "sess").orderBy("_turn")
    found = found.withColumn("_later", F.lead("_turn").over(last_bar)).where("_later is null").drop("_turn", "_later")
    return found.withColumnsRenamed({"symbol": "_symbol", "sess": "_sess"})


class SlidingMedians:
    """Medians over the last n sessions of rows that come by symbol and session; wanted: (place of the value, n)."""

    def __init__(self, wanted: list[tuple[int, int]]):
        self.wanted, self.symbol = wanted, None

    def add(self, symbol: object, sess: int, row: tuple) -> list[float | None]:
        if symbol != self.symbol:
            self.symbol = symbol
            self.held = [(deque(), []) for _ in self.wanted]
        return [self._one(queue, order, sess, row[k], n) for (k, n), (queue, order) in zip(self.wanted, self.held, strict=True)]

    @staticmethod
    def _one(queue: deque, order: list[float], sess: int, value: float | None, n: int) -> float | None:
        while queue and queue[0][0] <= sess - n:
            del order[bisect_left(order, queue.popleft()[1])]
        if value is not None and value == value:  # NaN counts as missing
            queue.append((sess, value))
            insort(order, value)
        m = len(order)
        return None if not m else order[m // 2] if m % 2 else (order[m // 2 - 1] + order[m // 2]) / 2
