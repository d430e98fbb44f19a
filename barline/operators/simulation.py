"""The daily step of simulated portfolios, as tables: fill what was decided, decide what is due, value, record.

The state of a day is a folder of tables under ``day=<date>``: books, positions, pending, dropped; curve and fills are
ledgers with a folder for each day. A day that is done is not done again, and none before it can follow.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators import portfolio
from barline.operators.calendar import next_session
from barline.operators.scoring import MIN_PEERS, correlations
from barline.sources.state import read_json, write_json

BOOKS = "scenario string, broker string, cash double, costs double, saved double, last_rebalance date"
POSITIONS = "scenario string, broker string, symbol string, units double, cost double"
PENDING = "scenario string, broker string, symbol string, side string, amount double, decided_on date, turn int"
DROPPED = "scenario string, broker string, symbol string, side string, decision string, avoided double"
TABLES = {"books": BOOKS, "positions": POSITIONS, "pending": PENDING, "dropped": DROPPED}
CURVE_KEYS = ("date", "scenario", "broker")
PERIODS = {scenario: period for scenario, (_, period) in portfolio.SCENARIOS.items()}


@dataclass
class State:
    books: DataFrame
    positions: DataFrame
    pending: DataFrame
    dropped: DataFrame


def start(spark: SparkSession) -> State:
    """Every book with the capital, less what some brokers take for changing it."""
    paid = F.lit(0.0)
    for broker, b in portfolio.BROKERS.items():
        paid = F.when(F.col("broker") == broker, b["deposit_fx"]).otherwise(paid)
    books = portfolio.books(spark).select("scenario", "broker", (portfolio.CAPITAL * (1 - paid)).alias("cash"), (portfolio.CAPITAL * paid).alias("costs"), F.lit(0.0).alias("saved"), F.lit(None).cast("date").alias("last_rebalance"))
    return State(books, *[spark.createDataFrame([], TABLES[t]) for t in ("positions", "pending", "dropped")])


def days(spark: SparkSession, folder: str) -> list[str]:
    """Dates that are done, in order; the books are written last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/day=*/books/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(f.getPath().getParent().getParent().getName().removeprefix("day=") for f in found)


def load(spark: SparkSession, folder: str, day: str | None) -> State:
    """The state of a day as JSON tables; that of the start if there is none. A table with a broken line is empty."""
    if day is None:
        return start(spark)
    return State(*[read_json(spark, f"{folder}/state/day={day}/{name}", schema) for name, schema in TABLES.items()])


def save(state: State, folder: str, day: str) -> None:
    for name in ("positions", "pending", "dropped", "books"):
        write_json(getattr(state, name), f"{folder}/state/day={day}/{name}")


def fill(state: State, prices: DataFrame, groups: DataFrame, today: str) -> tuple[State, DataFrame]:
    """The state after the orders of the session after their decision, and the fills: date, scenario, broker, symbol, side, amount, fee.

    prices: symbol, date, open, close (euros). An open that lacks is replaced by the close; what still has no price is not filled,
    and no order is tried twice. Orders whose session is after today stay.
    """
    pending = state.pending
    ahead = next_session(prices).select(F.col("date").alias("decided_on"), F.col("next_date").alias("session"))
    due = pending.join(F.broadcast(ahead), "decided_on").where(F.col("session") <= F.lit(today))  # a row for each session
    quote = prices.select("symbol", F.col("date").alias("session"), F.coalesce("open", "close").alias("price"))
    held = state.positions.select("scenario", "broker", "symbol", F.col("units").alias("units_held"))
    orders = due.join(quote, ["symbol", "session"], "left").join(held, ["scenario", "broker", "symbol"], "left").join(groups.select("symbol", "grp"), "symbol", "left")
    group = F.coalesce("grp", F.lit("default"))
    cost = lambda f: reduce(lambda c, b: F.when(F.col("broker") == b, f(b, group)).otherwise(c), portfolio.BROKERS, F.lit(0.0))
    orders = orders.withColumns({"units_held": F.coalesce("units_held", F.lit(0.0)), "fee": cost(portfolio.fee), "half_spread": cost(portfolio.half_spread), "turn": F.coalesce("turn", F.lit(2**31 - 1))})
    fills = portfolio.execute(orders, state.books.select("scenario", "broker", "cash")).join(orders.select("scenario", "broker", "symbol", "session", F.col("price").alias("paid"), "half_spread").distinct(), ["scenario", "broker", "symbol"])
    sign = F.when(F.col("side") == "sale", 1.0).otherwise(-1.0)
    fills = fills.withColumn("spread", F.abs("units") * F.col("paid") * F.col("half_spread"))
    after = fills.groupBy("scenario", "broker").agg(F.max_by("cash_after", F.struct(F.col("side") != "sale", "place")).alias("left"), F.sum(F.col("fee") + F.col("spread")).alias("paid"))
    books = state.books.join(after, ["scenario", "broker"], "left").withColumns({"cash": F.coalesce("left", "cash"), "costs": F.col("costs") + F.coalesce("paid", F.lit(0.0))}).drop("left", "paid")
    change = fills.select("scenario", "broker", "symbol", "units", F.when(F.col("side") == "sale", 0.0).otherwise(F.col("net")).alias("cost"))
    gone = fills.where("side = 'sale'").select("scenario", "broker", "symbol")
    positions = state.positions.join(gone, ["scenario", "broker", "symbol"], "left_anti").unionByName(change.where("units > 0")).groupBy("scenario", "broker", "symbol").agg(F.sum("units").alias("units"), F.sum("cost").alias("cost"))
    waiting = pending.join(due.select("scenario", "broker", "symbol").distinct(), ["scenario", "broker", "symbol"], "left_anti")
    told = fills.select(F.col("session").alias("date"), "scenario", "broker", "symbol", "side", "amount", "fee", (sign * F.col("amount")).alias("flow"))
    return State(books.select(*_names(BOOKS)), positions, waiting.select(*_names(PENDING)), state.dropped), told


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def select(scored: DataFrame, quarantined: DataFrame, bars: DataFrame, n: int, weights: dict[str, float], window: int = 126) -> list:
    """Up to n symbols by quotas of the horizons, no bet twice; what is short is filled up from the heaviest horizon.

    Rankings come from Spark, cut to five candidates for each place (40 or 60 at least); only these few reach the driver.
    """
    day = scored.join(F.broadcast(scored.agg(F.max("date").alias("date"))), "date", "left_semi").join(quarantined.select("symbol"), "symbol", "left_anti")  # one row
    big = day.groupBy("grp").agg(F.count("*").alias("peers")).where(F.col("peers") >= MIN_PEERS).select("grp")
    day = day.join(big, "grp", "left_semi")
    order = sorted(weights.items(), key=lambda x: -x[1])
    quotas = {h: round(n * w) for h, w in order}
    ranked: dict[str, list] = {}
    for h, _ in order:
        if f"score_{h}" in day.columns and (quotas[h] > 0 or h == order[0][0]):
            top = day.where(F.col(f"score_{h}").isNotNull()).orderBy(F.desc_nulls_last(f"pct_{h}"), F.desc(f"score_{h}"), "symbol")
            ranked[h] = [r.symbol for r in top.limit(max(5 * quotas[h], 5 * n, 60)).select("symbol").collect()]
    names = sorted({s for r in ranked.values() for s in r})
    near = {(r.a, r.b): r.corr for r in correlations(bars, names, window).collect()} if names else {}
    liquid = {r.symbol: r.liquidity or 0.0 for r in portfolio.median_liquidity(bars.where(F.col("symbol").isin(names))).collect()} if names else {}
    chosen: list = []
    for h, _ in order:
        if quotas[h] > 0 and h in ranked:
            chosen += portfolio.choose(ranked[h][: max(5 * quotas[h], 40)], near, liquid, quotas[h], chosen)
    if len(chosen) < n and ranked.get(order[0][0]):
        chosen += portfolio.choose([s for s in ranked[order[0][0]][: max(5 * n, 60)] if s not in chosen], near, liquid, n - len(chosen), chosen)
    return chosen[:n]


def decide(state: State, prices: DataFrame, groups: DataFrame, today: str, targets: dict[str, list], alphas: dict[str, DataFrame]) -> State:
    """Orders of the scenarios that are due and have targets; they wait for the next session."""
    spark = state.books.sparkSession
    now = F.to_date(F.lit(today))
    values = {(r.scenario, r.broker): r.value for r in valued(state, prices, today).collect()}  # scenarios by brokers
    last = {r.scenario: r.due for r in state.books.groupBy("scenario").agg(F.max("last_rebalance").alias("last")).select("scenario", reduce(lambda c, s: F.when(F.col("scenario") == s, portfolio.due(F.col("last"), now, PERIODS[s])).otherwise(c), PERIODS, F.lit(False)).alias("due")).collect()}
    plans = []
    for scenario, chosen in targets.items():
        if not chosen or not last.get(scenario):
            continue
        wanted = spark.createDataFrame([(s,) for s in chosen], "symbol string")
        place = spark.createDataFrame([(str(s), k) for k, s in enumerate(chosen)], "symbol string, turn int")  # purchases go by rank while cash lasts
        for broker in portfolio.BROKERS:
            own = state.positions.where((F.col("scenario") == scenario) & (F.col("broker") == broker)).select("symbol", "cost")
            plan = portfolio.plan_orders(own, wanted, alphas[scenario], groups, values[scenario, broker], broker)
            plans.append(plan.select(F.lit(scenario).alias("scenario"), F.lit(broker).alias("broker"), F.col("symbol").cast("string").alias("symbol"), "side", "amount", "decision", "avoided").join(F.broadcast(place), "symbol", "left"))
    if not plans:
        return state
    every = reduce(DataFrame.unionByName, plans)
    decided = [s for s, chosen in targets.items() if chosen and last.get(s)]
    new = every.where("decision = 'order'").select("scenario", "broker", "symbol", "side", "amount", now.alias("decided_on"), "turn")
    dropped = every.where("decision <> 'order' and decision not in ('inside the band', 'reductions run on')").select(*_names(DROPPED))
    saved = dropped.groupBy("scenario", "broker").agg(F.sum(F.coalesce("avoided", F.lit(0.0))).alias("more"))
    is_due = F.col("scenario").isin(decided)
    books = state.books.join(saved, ["scenario", "broker"], "left").withColumns({"saved": F.round(F.col("saved") + F.coalesce("more", F.lit(0.0)), 2), "last_rebalance": F.when(is_due, now).otherwise(F.col("last_rebalance"))}).select(*_names(BOOKS))
    return State(books, state.positions, state.pending.where(~is_due).unionByName(new), state.dropped.where(~is_due).unionByName(dropped))


def valued(state: State, prices: DataFrame, today: str) -> DataFrame:
    """scenario, broker, value at the closes of today, at cost where there is none."""
    closes = prices.where(F.col("date") == F.lit(today)).select("symbol", "close")
    return portfolio.value_of(state.positions, closes, state.books.select("scenario", "broker", "cash"))


def curve(state: State, prices: DataFrame, today: str) -> DataFrame:
    """date, scenario, broker, value, cash, positions, costs, return_pct of a day."""
    held = state.positions.groupBy("scenario", "broker").agg(F.count("*").alias("positions"))
    rows = state.books.join(valued(state, prices, today), ["scenario", "broker"]).join(held, ["scenario", "broker"], "left")
    return rows.select(F.to_date(F.lit(today)).alias("date"), "scenario", "broker", F.round("value", 2).alias("value"), F.round("cash", 2).alias("cash"), F.coalesce("positions", F.lit(0)).alias("positions"), F.round("costs", 2).alias("costs"), F.round((F.col("value") / portfolio.CAPITAL - 1) * 100, 3).alias("return_pct"))


def benchmark(prices: DataFrame, start_date: str, symbol: str, broker: str = "trade_republic") -> DataFrame:
    """date, value, return_pct of a book that buys one fund at the first open after the start and keeps it; no row without that open.

    A session without a close counts as the capital.
    """
    own = prices.where(F.col("symbol") == symbol)
    first = prices.where(F.col("date") > F.lit(start_date)).agg(F.min("date").alias("date"))
    bought = own.join(F.broadcast(first), "date").where("open > 0").select(F.col("date").alias("bought"), F.col("open").alias("paid"))  # one row each
    half = portfolio.half_spread(broker, F.lit("etf"))
    units = F.try_divide(F.lit(portfolio.CAPITAL) - portfolio.fee(broker, F.lit("etf")), F.col("paid") * (1 + half))
    dates = prices.select("date").distinct().join(F.broadcast(bought), F.col("date") >= F.col("bought"))
    rows = dates.join(own.select("date", "close"), "date", "left").withColumn("value", F.coalesce(units * F.col("close"), F.lit(portfolio.CAPITAL)))
    return rows.select("date", F.round("value", 2).alias("value"), F.round((F.col("value") / portfolio.CAPITAL - 1) * 100, 3).alias("return_pct"))


def step(spark: SparkSession, folder: str, today: str, prices: DataFrame, groups: DataFrame, targets: dict[str, list], alphas: dict[str, DataFrame]) -> State:
    """One day: fills, decisions, valuation, ledgers, state. Nothing happens on a day that is done; an earlier day is an error."""
    done = days(spark, folder)
    if done and done[-1] == today:
        return load(spark, folder, today)
    if done and done[-1] > today:
        raise ValueError(f"{today} is before {done[-1]}, which is done")
    state, fills = fill(load(spark, folder, done[-1] if done else None), prices, groups, today)
    fills.coalesce(1).write.mode("overwrite").json(f"{folder}/fills/day={today}")
    # The state is written twice, so that decisions read the fills and do not make them again.
    save(state, f"{folder}/filled", today)
    state = decide(load(spark, f"{folder}/filled", today), prices, groups, today, targets, alphas)
    curve(state, prices, today).coalesce(1).write.mode("overwrite").json(f"{folder}/curve/day={today}")
    save(state, folder, today)
    return load(spark, folder, today)


def ledger(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All days of a ledger: curve or fills."""
    schema = {"curve": "date date, scenario string, broker string, value double, cash double, positions long, costs double, return_pct double", "fills": "date date, scenario string, broker string, symbol string, side string, amount double, fee double, flow double"}[name]
    return spark.read.schema(schema).json(f"{folder}/{name}/day=*")
