"""Registered queries about the universe, ledgers, money and the report, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.operators import ingest, portfolio, report, scoring
from barline.plans import catalog, sql
from barline.plans.catalog import query, rounded
from barline.sources import bars, feeds, html_tables, store, universe

# ---- universe -------------------------------------------------------------------------------------

# Names that the patterns must tell apart, by size of the part.
_NAMES = ("", " 2x long", " -1x Short", " 1.5 x Bull", " UltraShort", " UltraPro", " 10x Genomics", " 3xl shirt", " 2x", " VIX", " volatility  index", " Daily Income", " inverse", " x2 Long", " A3x bear", " leveraged")
_OUT = r"(?i)\bultra(short|pro)?\b|\binverse\b|\bleveraged\b|\bvix\b|volatility\s+index"
_TIMES, _SIDE = r"(?i)(^|[^A-Za-z0-9])[-+]?[1-3](\.[0-9]+)?\s*x([^A-Za-z]|$)", r"(?i)\b(bull|bear|long|short|ultra\w*|inverse|leveraged|daily|apalancad\w+)\b"
_TICKERS = "'SH', 'PSQ', 'DOG', 'RWM', 'EUM', 'EFZ', 'SEF', 'SBB', 'MYY', 'MZZ', 'DDG', 'SJB', 'TBF', 'TBX', 'IGBH', 'BITI', 'ETHD', 'REK', 'SDP', 'SZK'"


@query(
    f"""WITH n AS (SELECT p_partkey AS id, p_name || [{', '.join(f"'{n}'" for n in _NAMES)}][p_size % {len(_NAMES)} + 1] AS name, CASE WHEN p_partkey % 3 = 0 THEN [{_TICKERS.lower()}, 'spy', 'qqq'][p_partkey % 22 + 1] ELSE p_brand END AS symbol FROM part)
SELECT id, upper(symbol) IN ({_TICKERS}) OR regexp_matches(name, '{_OUT}') OR (regexp_matches(name, '{_TIMES}') AND regexp_matches(name, '{_SIDE}')) AS wrapper FROM n"""
)
def wrapper_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Every pattern and every listed ticker, among names that only look alike."""
    tickers = F.array(*[F.lit(s) for s in (*[t.strip("' ").lower() for t in _TICKERS.split(",")], "spy", "qqq")])
    name = F.concat("p_name", F.get(F.array(*[F.lit(n) for n in _NAMES]), F.col("p_size") % len(_NAMES)))
    symbol = F.when(F.col("p_partkey") % 3 == 0, F.get(tickers, (F.col("p_partkey") % 22).cast("int"))).otherwise(F.col("p_brand"))
    return bars.table(spark, d, "part").select(F.col("p_partkey").alias("id"), universe.is_wrapper(name, symbol).alias("wrapper"))


@query("SELECT event_id AS id, lower('HTTP ' || event_id % 600 || CASE WHEN user_id % 3 = 0 THEN ' Too Many Requests' WHEN user_id % 7 = 0 THEN ' RATE LIMIT of ' ELSE ' ' || event_type END) SIMILAR TO '.*(rate limit|too many requests|429).*' AS limited FROM events")
def rate_limits(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("user_id") % 3 == 0, " Too Many Requests").when(F.col("user_id") % 7 == 0, " RATE LIMIT of ").otherwise(F.concat(F.lit(" "), "event_type"))
    message = F.concat(F.lit("HTTP "), (F.col("event_id") % 600).cast("string"), said)
    return bars.table(spark, d, "events").select(F.col("event_id").alias("id"), universe.is_rate_limit(message).alias("limited"))


def _markets(spark: SparkSession, d: str) -> DataFrame:
    """Customers as trading pairs: base, quote, kind and state of each, and what was ordered as its volume."""
    volume = bars.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("quote_volume"))
    k = F.col("c_custkey")
    rows = bars.table(spark, d, "customer").join(volume, "c_custkey", "left")
    return rows.select(F.concat("c_name", F.lit("/"), F.when(k % 4 == 0, "EUR").otherwise("USDT")).alias("symbol"), F.col("c_name").alias("base"), F.when(k % 4 == 0, "EUR").otherwise("USDT").alias("quote"), (F.col("c_mktsegment") != "MACHINERY").alias("spot"), (F.col("c_acctbal") > 0).alias("active"), "quote_volume")


_COINS = """mk AS (SELECT c_name || '/USDT' AS symbol, c_name AS name, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS volume FROM customer WHERE c_custkey % 4 <> 0 AND c_mktsegment <> 'MACHINERY' AND c_acctbal > 0),
coins AS (SELECT symbol, name FROM mk ORDER BY volume DESC NULLS LAST, symbol LIMIT 300)"""


@query(f"WITH {_COINS} SELECT symbol, name, 'crypto' AS grp, '' AS exchange, 'USD' AS currency FROM coins")
def crypto_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The report's limit of 300 pairs is a feature of the source."""
    return universe.crypto(_markets(spark, d))


_MACRO_ROWS = ", ".join(f"('{x}', '{g}')" for g, names in feeds.MACRO.items() for x in names.split())


@query(
    f"""WITH {_COINS}, al AS (SELECT symbol, symbol AS name, grp, 0 AS pr FROM (VALUES {_MACRO_ROWS}) AS t(symbol, grp) UNION ALL SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'TLT' ELSE 'S' || s_suppkey END, s_name, 'equity_us', 1 FROM supplier
UNION ALL SELECT 'S' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '.L' WHEN s_suppkey % 3 = 1 THEN '.PA' ELSE '' END, 'S' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '.L' WHEN s_suppkey % 3 = 1 THEN '.PA' ELSE '' END, 'equity_eu', 2 FROM supplier
UNION ALL SELECT symbol, name, 'crypto', 3 FROM coins)
SELECT symbol, arg_min(name, ROW(pr, name)) AS name, arg_min(grp, ROW(pr, name)) AS grp FROM al GROUP BY symbol"""
)
def universe_of_four(spark: SparkSession, d: str) -> DataFrame:
    """Macro series, a listing, tickers out of pages, pairs: a symbol of several sources is that of the first."""
    k = F.col("s_suppkey")
    told = lambda symbol, name, grp: [symbol.alias("symbol"), name.alias("name"), F.lit(grp).alias("grp")]
    us = bars.table(spark, d, "supplier").select(*told(F.when(k % 10 == 0, "TLT").otherwise(F.concat(F.lit("S"), k.cast("string"))), F.col("s_name"), "equity_us"))
    mark = F.concat(F.lit("s "), k.cast("string"), F.when(k % 3 == 0, ".l").when(k % 3 == 1, ".pa").otherwise(""))
    cells = bars.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<tr><td>x</td><td>"), mark, F.lit("</td></tr>")))).alias("rows"))  # suppliers of a nation
    pages = cells.select(F.col("s_nationkey").alias("page_id"), F.concat(F.lit("<table><tr><th>Name</th><th>Symbol</th></tr>"), "rows", F.lit("</table>")).alias("html"))
    eu = html_tables.ticker_rows(pages, least_rows=1)
    sources = {"macro": feeds.macro(spark).select("symbol", "name", "grp"), "us": us, "eu": eu.select(*told(F.col("symbol"), F.col("symbol"), "equity_eu")), "crypto": universe.crypto(_markets(spark, d)).select("symbol", "name", "grp")}
    return universe.build(sources)[0].select("symbol", "name", "grp")


# ---- the store and ledgers ------------------------------------------------------------------------

_URGENCIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2 HAVING close IS NOT NULL")
def long_bars(spark: SparkSession, d: str) -> DataFrame:
    """A wide table, two fields of each priority, back to rows."""
    wide = bars.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).pivot("o_orderpriority", list(_URGENCIES)).agg(F.max("o_totalprice").alias("close"), F.count(F.lit(1)).alias("volume"))
    wide = wide.select("day", *[F.col(f"`{u}_{f}`").alias(f"{f}_{u}") for u in _URGENCIES for f in ("close", "volume")])
    return store.to_long(wide, "day", ["close", "volume"], list(_URGENCIES))


def _spent(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("o_custkey").alias("customer")).agg(F.max("o_totalprice").alias("most"), F.count("*").alias("orders"))


_SPLIT = "old AS (SELECT o_custkey AS customer, max(o_totalprice) AS most, count(*) AS orders FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), new AS (SELECT o_custkey AS customer, max(o_totalprice) AS most, count(*) AS orders FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)"


@query(f"WITH {_SPLIT} SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (customer)")
def appended_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = bars.table(spark, d, "orders")
    return store.append_keyed(_spent(rows.where("o_orderdate < '1997-01-01'")), _spent(rows.where("o_orderdate >= '1997-01-01'")), ["customer"])


@query("SELECT DISTINCT o_custkey, o_orderpriority, o_orderstatus FROM orders")
def appended_rows(spark: SparkSession, d: str) -> DataFrame:
    """Without a key rows are told apart by all their columns."""
    rows = bars.table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    return store.append_keyed(rows.where("o_orderdate < '1997-01-01'").drop("o_orderdate"), rows.where("o_orderdate >= '1997-01-01'").drop("o_orderdate"))


@query("SELECT o_custkey AS customer, min(o_orderkey) AS first_order, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def first_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = bars.table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("first_order"), F.col("o_totalprice").alias("price"))
    return ingest.keep_first(rows, ["customer"], "first_order")


# ---- money ----------------------------------------------------------------------------------------


@query(
    f"""{sql.WEEK}, {catalog._FX}, dd AS (SELECT DISTINCT date FROM w), g AS (SELECT dd.date, c.currency, fx.rate FROM dd CROSS JOIN (SELECT DISTINCT currency FROM fx) c ASOF LEFT JOIN fx ON c.currency = fx.currency AND dd.date >= fx.date),
cu AS (SELECT s_suppkey AS symbol, ['EUR', 'GBP', 'USD', 'SEK'][s_nationkey % 4 + 1] AS currency FROM supplier)
SELECT symbol, w.date, round(ln(CASE WHEN cu.currency = 'EUR' OR rate IS NULL OR rate <= 0 THEN close ELSE close / rate END), 6) + 0.0 AS log_close FROM w JOIN cu USING (symbol) LEFT JOIN g ON g.date = w.date AND g.currency = CASE WHEN cu.currency = 'GBP' THEN 'GBP' ELSE 'USD' END"""
)
def bars_in_euros(spark: SparkSession, d: str) -> DataFrame:
    orders = bars.table(spark, d, "orders").where(F.month("o_orderdate") % 3 == 0).join(bars.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rates = orders.groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"), F.when(F.col("c_nationkey") % 2 == 0, "USD").otherwise("GBP").alias("currency")).agg((F.avg("o_totalprice") / 1e5).alias("rate"))
    money = bars.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.get(F.array(*[F.lit(c) for c in ("EUR", "GBP", "USD", "SEK")]), F.col("s_nationkey") % 4).alias("currency"))
    # Prices are quotients that may stand exactly between two roundings; their logarithms do not.
    return rounded(portfolio.in_euros(catalog.week(spark, d), money, rates).withColumn("log_close", F.ln("close")), {"log_close": 6}, "symbol", "date")


# ---- report ---------------------------------------------------------------------------------------

_LISTED = 40

#: Every series, a noisy copy and a mirror of it; the most liquid of them are the list.
_ECHOES = f"""w3 AS (SELECT symbol, sess, close, volume FROM w UNION ALL SELECT symbol + 1000000, sess, close * (1 + sess % 3 / 32.0::DOUBLE), volume FROM w UNION ALL SELECT symbol + 2000000, sess, 1048576.0::DOUBLE / close, volume FROM w),
li AS (SELECT symbol, CAST(row_number() OVER (ORDER BY liquidity DESC, symbol) AS INTEGER) AS place FROM (SELECT symbol, median(close * volume) AS liquidity FROM w3 WHERE sess > (SELECT max(sess) FROM w3) - 63 GROUP BY symbol) ORDER BY place LIMIT {_LISTED}),
lr AS (SELECT * FROM (SELECT symbol, place, sess, ln(close / {sql.at('close', -1)}) AS x FROM w3 JOIN li USING (symbol) WHERE sess >= (SELECT max(sess) FROM w3) - 126) WHERE x IS NOT NULL),
co AS (SELECT a.place AS twin, b.place AS place, abs(covar_pop(a.x, b.x) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0)) AS corr FROM lr a JOIN lr b ON a.sess = b.sess AND a.place < b.place GROUP BY 1, 2),
nr AS (SELECT li.place, coalesce(list(co.twin) FILTER (co.corr >= 0.8), []) AS near FROM li LEFT JOIN co USING (place) GROUP BY li.place),
fo AS (SELECT CAST(0 AS INTEGER) AS place, CAST([] AS INTEGER[]) AS kept UNION ALL SELECT nr.place, CASE WHEN len(list_intersect(kept, near)) > 0 THEN kept ELSE list_append(kept, nr.place) END FROM fo JOIN nr ON nr.place = fo.place + 1),
tw AS (SELECT co.place, arg_max(co.twin, ROW(co.corr, -co.twin)) AS twin, max(co.corr) AS corr FROM co JOIN fo ON fo.place = co.place WHERE co.corr >= 0.8 AND list_contains(kept, co.twin) AND NOT list_contains(kept, co.place) GROUP BY 1)"""


def _echoes(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.week(spark, d).select("symbol", "sess", "close", "volume")
    noisy = rows.withColumns({"symbol": F.col("symbol") + 1000000, "close": F.col("close") * (1 + F.col("sess") % 3 / 32.0)})
    return rows.unionByName(noisy).unionByName(rows.withColumns({"symbol": F.col("symbol") + 2000000, "close": 1048576.0 / F.col("close")}))


@query(f"{sql.WEEK.replace('WITH', 'WITH RECURSIVE', 1)}, {_ECHOES} SELECT a.symbol, b.symbol AS twin, round(corr, 6) + 0.0 AS corr FROM tw JOIN li a USING (place) JOIN li b ON b.place = twin")
def redundant_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Of the 40 most liquid series those that move with a better placed one."""
    rows = _echoes(spark, d)
    best = portfolio.median_liquidity(rows).orderBy(F.desc("liquidity"), "symbol").limit(_LISTED)
    ranked = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("liquidity"), "symbol")))  # the list only
    return rounded(scoring.redundant(rows, ranked), {"corr": 6}, "symbol", "twin")


_HELD = "po AS (SELECT r_name AS scenario, s_suppkey AS symbol, abs(s_acctbal) + 1 AS cost, (abs(s_acctbal) + 1) / 1024 AS units FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey), ca AS (SELECT r_name AS scenario, CAST(count(*) - 5 AS DOUBLE) AS cash FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey > 4 GROUP BY 1 UNION ALL SELECT 'IDLE', 0.5)"


@query(
    f"""{sql.WEEK}, {_HELD}, cl AS (SELECT symbol, close FROM w WHERE date = (SELECT max(date) FROM w)), he AS (SELECT scenario, CAST(symbol AS VARCHAR) AS symbol, coalesce(units * close, cost) AS value, cost FROM po LEFT JOIN cl USING (symbol) UNION ALL SELECT scenario, 'CASH', cash, NULL FROM ca WHERE cash > 1)
SELECT scenario, symbol, round(value, 2) + 0.0 AS value, round(value / sum(value) OVER (PARTITION BY scenario) * 100, 2) + 0.0 AS weight_pct, round(value - cost, 2) + 0.0 AS gain, round((value - cost) / cost * 100, 2) + 0.0 AS gain_pct FROM he"""
)
def composition(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.week(spark, d)
    top = rows.agg(F.max("date").alias("date"))
    closes = rows.join(F.broadcast(top), "date", "left_semi").select(F.col("symbol").cast("string").alias("symbol"), "close")  # one row
    paid = F.abs("s_acctbal") + 1
    regions = bars.supplier_region(spark, d)
    held = regions.join(bars.table(spark, d, "supplier"), F.col("symbol") == F.col("s_suppkey")).select(F.col("grp").alias("scenario"), F.col("symbol").cast("string").alias("symbol"), (paid / 1024).alias("units"), paid.alias("cost"))
    nation = bars.table(spark, d, "nation").where("n_nationkey > 4").join(bars.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cash = nation.groupBy(F.col("r_name").alias("scenario")).agg((F.count("*") - 5).cast("double").alias("cash")).unionByName(spark.createDataFrame([("IDLE", 0.5)], "scenario string, cash double"))
    out = report.composition(held, closes, cash)
    return out.select("scenario", "symbol", *[(F.col(c) + 0.0).alias(c) for c in ("value", "weight_pct", "gain", "gain_pct")])


@query(
    f"""{sql.WEEK}, cv AS (SELECT date, grp AS scenario, CASE WHEN symbol % 2 = 0 THEN 'a' ELSE 'b' END AS broker, max(close) AS value, CAST(max(sess) AS DOUBLE) AS costs FROM w GROUP BY ALL), t AS (SELECT max(date) AS top FROM cv),
be AS (SELECT arg_max(value, date) / arg_min(value, date) * 100 - 100 AS pct FROM (SELECT date, min(close) AS value FROM w GROUP BY date), t WHERE date >= top - 90)
SELECT scenario, broker, round(arg_max(value, date) / arg_min(value, date) * 100 - 100, 5) + 0.0 AS pct, arg_max(costs, date) - arg_min(costs, date) AS cost, round(arg_max(value, date) / arg_min(value, date) * 100 - 100 - (SELECT pct FROM be), 5) + 0.0 AS excess FROM cv, t WHERE date >= top - 90 GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def period_of_books(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.week(spark, d)
    curve = rows.groupBy("date", F.col("grp").alias("scenario"), F.when(F.col("symbol") % 2 == 0, "a").otherwise("b").alias("broker")).agg(F.max("close").alias("value"), F.max("sess").cast("double").alias("costs"))
    bench = rows.groupBy("date").agg(F.min("close").alias("value"))
    return rounded(report.period_of_books(curve, bench, 90), {"pct": 5, "excess": 5}, "scenario", "broker", "cost")
