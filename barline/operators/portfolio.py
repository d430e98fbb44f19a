"""Cost-aware portfolios: brokers, expected alpha, order planning by sets, and execution as a fold over each book's ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.operators.features import HORIZONS
from barline.sources.shared import dealt, tasks_for

# Scenarios, brokers, thresholds.
CAPITAL = 40_000.0
SCENARIOS = {"short": (15, "week"), "medium": (20, "month"), "long": (20, "quarter"), "combined": (20, "month")}
BROKERS = {
    "trade_republic": {"fee": 1.0, "etf_fee": None, "deposit_fx": 0.0, "spread_bps": {"equity_us": 15, "equity_eu": 10, "etf": 8, "crypto": 100, "commodity": 20, "bond": 12, "index": 20, "fx": 10, "default": 15}},
    "etoro": {"fee": 1.80, "etf_fee": 0.0, "deposit_fx": 0.005, "spread_bps": {"equity_us": 10, "equity_eu": 15, "etf": 10, "crypto": 190, "commodity": 25, "bond": 15, "index": 25, "fx": 15, "default": 15}},
}
SAFETY, MAX_FEE_SHARE, NO_TRADE_BAND = 1.5, 0.001, 0.25
LEAST_WEIGHT, MOST_WEIGHT = 0.5, 2.0
MAX_CORR, CLONE, LIQUIDITY_EDGE = 0.80, 0.97, 3.0


def fee(broker: str, group: Column) -> Column:
    """Commission of an order in euros; some brokers have another one for ETFs."""
    b = BROKERS[broker]
    return F.when(group == "etf", F.lit(b["etf_fee"])).otherwise(F.lit(b["fee"])) if b["etf_fee"] is not None else F.lit(b["fee"])


def half_spread(broker: str, group: Column) -> Column:
    """Half the spread as a fraction of the amount."""
    bps = BROKERS[broker]["spread_bps"]
    known = F.create_map(*[F.lit(x) for k, v in bps.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(known, group), F.lit(float(bps["default"]))) / 2e4


def cost_per_euro(broker: str, group: Column, amount: Column) -> Column:
    return F.when(amount <= 0, F.lit(1.0)).otherwise(F.try_divide(fee(broker, group), amount) + half_spread(broker, group))


def due(last: Column, today: Column, period: str) -> Column:
    """Whether a rebalance is due: never before, or another week, month or quarter."""
    return last.isNull() | (F.date_trunc(period, last) != F.date_trunc(period, today))


def rates_as_of(calendar: DataFrame, rates: DataFrame) -> DataFrame:
    """date, currency, rate: the last rate known on each session, null before the first. rates: date, currency, rate."""
    dates = calendar.select("date").distinct()
    grid = dates.crossJoin(rates.select("currency").distinct())  # sessions by currencies
    both = grid.join(rates, ["date", "currency"], "full_outer")
    w = Window.partitionBy("currency").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("rate", F.last("rate", ignorenulls=True).over(w)).join(dates, "date", "left_semi")


def rates_of(bars: DataFrame) -> DataFrame:
    """date, currency, rate: the closes of the pairs that tell what a euro is worth."""
    pairs = {"EURUSD=X": "USD", "EURGBP=X": "GBP"}
    named = F.create_map(*[F.lit(x) for item in pairs.items() for x in item])
    return bars.where(F.col("symbol").isin(*pairs)).select("date", F.try_element_at(named, F.col("symbol")).alias("currency"), F.col("close").alias("rate")).where("rate is not null")


def to_euros(amount: Column, currency: Column, rate: Column) -> Column:
    """Rates are units of a currency for a euro; without a valid rate an amount stays as it is."""
    return F.when((currency == "EUR") | rate.isNull() | (rate <= 0), amount).otherwise(F.try_divide(amount, rate))


def in_euros(bars: DataFrame, currencies: DataFrame, rates: DataFrame, fields: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """bars with prices in euros, at the rate last known on their date.

    currencies: symbol, currency (without one, dollars); rates: date, currency, rate. Currencies without rates of their own go at the dollar's;
    where no valid rate is known yet, prices stay as they are. Rates are laid on the calendar first, a row for each date and currency, so
    bars meet them in an equi-join.
    """
    daily = rates_as_of(bars, rates).select("date", F.col("currency").alias("quoted"), "rate")
    quoted = rates.select(F.col("currency").alias("quoted")).distinct()
    rows = bars.join(currencies.select("symbol", F.col("currency").alias("_currency")), "symbol", "left")
    rows = rows.withColumn("_currency", F.upper(F.coalesce("_currency", F.lit("USD")))).join(quoted, F.col("_currency") == F.col("quoted"), "left")
    rows = rows.withColumn("quoted", F.coalesce("quoted", F.lit("USD"))).join(daily, ["date", "quoted"], "left")
    return rows.withColumns({f: to_euros(F.col(f), F.col("_currency"), F.col("rate")) for f in fields}).select(*bars.columns)


def median_liquidity(bars: DataFrame, sessions: int = 63) -> DataFrame:
    top = bars.agg(F.max("sess").alias("top"))
    return bars.join(F.broadcast(top), F.col("sess") > F.col("top") - sessions).groupBy("symbol").agg(F.median(F.col("close") * F.col("volume")).alias("liquidity"))


def annual_volatility(bars: DataFrame, sessions: int = 252) -> DataFrame:
    top = bars.agg(F.max("sess").alias("top"))
    before = F.max("close").over(Window.partitionBy("symbol").orderBy("sess").rangeBetween(-1, -1))
    own = dealt(bars.select("symbol", "sess", "close"), tasks_for(bars), "symbol")  # counted, so bars should be a saved table
    rows = own.withColumn("lr", F.ln(F.try_divide("close", before))).join(F.broadcast(top), F.col("sess") > F.col("top") - sessions)
    return rows.groupBy("symbol").agg((F.stddev_samp("lr") * F.sqrt(F.lit(252.0))).alias("vol"))


def expected_alpha(scored: DataFrame, judged: DataFrame, bars: DataFrame, weights: dict[str, float]) -> DataFrame:
    """symbol, alpha: IC (floored at 0) times z times volatility over the horizon, summed over weighted horizons."""
    day = scored.join(F.broadcast(scored.agg(F.max("date").alias("date"))), "date", "left_semi")  # one row
    peers = Window.partitionBy("grp")
    vol = annual_volatility(bars)
    total = F.lit(0.0)
    rows = day.where("grp is not null").join(vol, "symbol", "left")
    ics = judged.groupBy("grp").pivot("horizon", list(weights)).agg(F.first("ic_mean"))
    rows = rows.join(ics, "grp", "left")
    for h, weight in weights.items():
        if weight <= 0 or f"score_{h}" not in scored.columns:
            continue
        s = F.col(f"score_{h}")
        spread = F.stddev_pop(s).over(peers)
        z = (s - F.avg(s).over(peers)) / F.when(F.coalesce(spread, F.lit(0.0)) == 0, 1.0).otherwise(spread)
        ic = F.greatest(F.coalesce(F.col(h), F.lit(0.0)), F.lit(0.0))
        part = ic * z * F.coalesce("vol", F.lit(0.25)) * F.sqrt(F.lit(HORIZONS[h] / 252)) * weight
        total = total + F.coalesce(F.when(F.count(s).over(peers) >= 5, part), F.lit(0.0))
    return rows.select("symbol", total.alias("alpha"))


def target_weights(targets: DataFrame) -> DataFrame:
    """targets (symbol, alpha) with weight: by positive alpha between half and twice an equal share, scaled to 1."""
    every = Window.partitionBy()
    a = F.greatest(F.coalesce("alpha", F.lit(0.0)), F.lit(0.0))
    n, whole = F.count("*").over(every), F.sum(a).over(every)
    rows = targets.withColumn("raw", F.when(whole > 0, F.least(F.greatest(F.try_divide(a, whole), LEAST_WEIGHT / n), MOST_WEIGHT / n)).otherwise(1 / n))
    return rows.withColumn("weight", F.col("raw") / F.sum("raw").over(every)).drop("raw")


def plan_orders(positions: DataFrame, targets: DataFrame, alphas: DataFrame, groups: DataFrame, value: float, broker: str) -> DataFrame:
    """symbol, side, amount, decision (order or why not), avoided: what is worth trading.

    positions: symbol, cost (held at cost); targets: symbol; alphas: symbol, alpha; groups: symbol, grp. A sale must
    gain SAFETY times the cost of the change, a purchase that of its entry unless nothing is held; adjustments stay
    inside a band; amounts must bear the commission; reductions are not carried out. Targets and alphas are read several times, so they should be saved tables.
    """
    alpha = F.coalesce("alpha", F.lit(0.0))
    wanted = target_weights(targets.select("symbol").join(alphas, "symbol", "left"))
    best = wanted.join(groups, "symbol", "left").select(F.struct(F.greatest(alpha, F.lit(0.0)).alias("a"), F.coalesce("grp", F.lit("default")).alias("g"), "symbol").alias("b"))
    best = best.agg(F.min_by("b", F.struct(-F.col("b.a"), F.col("b.symbol"))).alias("best"))
    held = positions.agg(F.count("*").alias("held"))
    rows = positions.join(wanted.select("symbol", "weight"), "symbol", "full_outer").join(alphas, "symbol", "left").join(groups, "symbol", "left")
    rows = rows.join(F.broadcast(best)).join(F.broadcast(held))  # one row each
    group, now = F.coalesce("grp", F.lit("default")), F.coalesce("cost", F.lit(0.0))
    aim = F.col("weight") * value
    delta = aim - now
    least = BROKERS[broker]["fee"] / MAX_FEE_SHARE
    leave = cost_per_euro(broker, group, now) + cost_per_euro(broker, F.coalesce("best.g", F.lit("default")), now)
    enter = cost_per_euro(broker, group, aim)
    sale, owned = F.col("weight").isNull(), F.coalesce(F.col("cost") > 0, F.lit(False))
    decision = (
        F.when(sale & (F.coalesce("best.a", F.lit(0.0)) - alpha < SAFETY * leave), "the candidate does not beat the cost of the change")
        .when(sale, "order")
        .when(owned & (F.abs(delta) < NO_TRADE_BAND * F.greatest(now, F.lit(1.0))), "inside the band")
        .when(owned & (F.abs(delta) < least), "adjustment below the least amount")
        .when(owned & (delta < 0), "reductions run on")
        .when(owned, "order")
        .when(aim < least, "too small for its commission")
        .when((F.col("held") > 0) & (alpha < SAFETY * enter), "alpha below the cost of entry")
        .otherwise("order")
    )
    amount = F.when(sale, now).when(owned, F.abs(delta)).otherwise(aim)
    avoided = (
        F.when(F.col("decision") == "the candidate does not beat the cost of the change", leave * now)
        .when(F.col("decision").isin("adjustment below the least amount", "too small for its commission"), fee(broker, group))
        .when(F.col("decision") == "alpha below the cost of entry", enter * aim)
    )
    return rows.withColumn("decision", decision).select("symbol", F.when(sale, "sale").otherwise("purchase").alias("side"), F.round(amount, 2).alias("amount"), "decision", F.round(avoided, 2).alias("avoided"))


FILL_SCHEMA = "scenario string, broker string, symbol string, side string, amount double, fee double, units double, net double, cash_after double, place int"


def execute(orders: DataFrame, cash: DataFrame) -> DataFrame:
    """Fills of the orders of each (scenario, broker): sales first, then purchases while cash lasts, fractions of units.

    net: what a purchase puts into the position, or a sale brings, after the fee; cash_after: the cash of the book then; place: from 0.

    orders: scenario, broker, symbol, side, amount, units_held, price (in euros; null or not positive: no fill),
    fee, half_spread, turn (the place in the plan; equal ones go by symbol); cash: scenario, broker, cash. A book's orders stream through one task in
    their order, of which only its cash and place are held; the books are dealt over the tasks.
    """
    columns = [c.split()[0] for c in FILL_SCHEMA.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, money, place = None, 0.0, 0
        for rows in batches:
            out = []
            for o in rows.itertuples():
                if (o.scenario, o.broker) != book:
                    book, money, place = (o.scenario, o.broker), float(o.cash), 0
                if not o.price > 0:
                    continue
                if o.side == "sale":
                    if not o.units_held > 0:
                        continue
                    amount, units = o.units_held * o.price * (1 - o.half_spread), -o.units_held
                    money += amount - o.fee
                else:
                    amount = min(o.amount, money)
                    if amount <= o.fee:
                        continue
                    units = (amount - o.fee) / (o.price * (1 + o.half_spread))
                    money -= amount
                out.append((o.scenario, o.broker, o.symbol, o.side, round(amount, 2), round(o.fee, 2), units, amount - o.fee, money, place))
                place += 1
            yield pd.DataFrame(out, columns=columns)

    numbers = [F.col(c).cast("double").alias(c) for c in ("amount", "units_held", "price", "fee", "half_spread", "cash")]
    late = (~F.col("side").eqNullSafe("sale")).alias("late")
    rows = orders.withColumn("symbol", F.col("symbol").cast("string")).join(F.broadcast(cash), ["scenario", "broker"])  # a row for each book
    rows = rows.select("scenario", "broker", "symbol", "side", "turn", late, *numbers)
    turns = ["scenario", "broker", "late", F.asc_nulls_last("turn"), F.asc_nulls_last("symbol")]
    return rows.repartition("scenario", "broker").sortWithinPartitions(*turns).mapInPandas(fold, FILL_SCHEMA)


def value_of(positions: DataFrame, closes: DataFrame, cash: DataFrame) -> DataFrame:
    """scenario, broker, value: cash and units at the close in euros, at cost where there is no close."""
    held = positions.join(closes.select("symbol", "close"), "symbol", "left").groupBy("scenario", "broker").agg(F.sum(F.coalesce(F.col("units") * F.col("close"), F.col("cost"))).alias("held"))
    return cash.join(held, ["scenario", "broker"], "left").select("scenario", "broker", (F.col("cash") + F.coalesce("held", F.lit(0.0))).alias("value"))


def books(spark: SparkSession) -> DataFrame:
    """scenario, broker: every scenario is run with every broker."""
    s = spark.createDataFrame([(k,) for k in SCENARIOS], "scenario string")
    return s.crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in BROKERS], "broker string")))


def choose(ranked: list[tuple], correlation: dict, liquidity: dict, n: int, taken: list | None = None) -> list:
    """The first n symbols of a short ranked list that are no bet twice; a far more liquid clone takes its rival's place."""
    before = list(taken or [])
    mine: list = []
    for s in ranked:
        if len(mine) >= n:
            break
        near = {k: abs(c) for k in before + mine if (c := correlation.get((s, k), correlation.get((k, s)))) is not None}
        close = [k for k, c in near.items() if c >= MAX_CORR]
        if not close:
            mine.append(s)
            continue
        rival = max(close, key=lambda k: near[k])
        if near[rival] >= CLONE and rival in mine and liquidity.get(s, 0.0) > LIQUIDITY_EDGE * liquidity.get(rival, 0.0):
            mine[mine.index(rival)] = s
    return mine
