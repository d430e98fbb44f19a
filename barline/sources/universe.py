"""The universe of symbols: listings, mappings between sources, and their union by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns and symbols of wrappers whose price cannot be read as that of an asset; groups.
MULTIPLIER = r"(?i)(?<![A-Za-z0-9])[-+]?[1-3](?:\.\d)?\s*x(?![A-Za-z])"
DIRECTION = r"(?i)\b(bull|bear|long|short|ultra\w*|inverse|leveraged|daily|apalancad\w+)\b"
ALWAYS_OUT = r"(?i)\bultra(short|pro)?\b|\binverse\b|\bleveraged\b|\bvix\b|volatility\s+index"
PLAIN_INVERSE = "SH PSQ DOG RWM EUM EFZ SEF SBB MYY MZZ DDG SJB TBF TBX IGBH BITI ETHD REK SDP SZK".split()
GROUPS = "equity_us equity_eu etf crypto commodity fx index bond".split()
PRIORITY = {"macro": 0, "us": 1, "eu": 2, "crypto": 3}


def is_wrapper(name: Column, symbol: Column) -> Column:
    """Leveraged, inverse and volatility products; meant for ETFs only."""
    name = F.coalesce(name, F.lit(""))
    return F.upper(symbol).isin(PLAIN_INVERSE) | name.rlike(ALWAYS_OUT) | (name.rlike(MULTIPLIER) & name.rlike(DIRECTION))


def reserve_symbol(symbol: Column) -> Column:
    """The symbol at the reserve source; null for symbols that it does not carry."""
    s = F.coalesce(symbol, F.lit(""))
    return F.when((s == "") | s.rlike(r"[\^=/.]") | (F.length(s) > 6), F.lit(None)).otherwise(F.concat(F.lower(F.translate(s, "-", ".")), F.lit(".us")))


def is_rate_limit(message: Column) -> Column:
    low = F.lower(message)
    return low.contains("rate limit") | low.contains("too many requests") | low.contains("429")


def listed(spark: SparkSession, path: str, exchange: str) -> DataFrame:
    """symbol, name, grp, exchange, currency of a pipe-separated listing; its trailer, tests and wrappers go."""
    rows = spark.read.option("sep", "|").option("header", True).csv(path)
    first = "Symbol" if "Symbol" in rows.columns else "ACT Symbol"
    rows = rows.withColumn("symbol", F.trim(F.col(first))).where(F.col("symbol").isNotNull() & ~F.col("symbol").startswith("File Creation"))
    if "Test Issue" in rows.columns:
        rows = rows.where(F.coalesce("Test Issue", F.lit("")) != "Y")
    if "Financial Status" in rows.columns:
        rows = rows.where(F.col("Financial Status").isNull() | F.col("Financial Status").isin("N", "Normal"))
    etf = F.coalesce(F.col("ETF") == "Y", F.lit(False)) if "ETF" in rows.columns else F.lit(False)
    rows = rows.where((F.col("symbol") != "") & ~F.col("symbol").rlike(r"[$ ]")).withColumn("symbol", F.translate("symbol", ".", "-"))
    name = F.col("Security Name") if "Security Name" in rows.columns else F.lit("")
    rows = rows.where(~(etf & is_wrapper(name, F.col("symbol"))))
    return rows.select("symbol", F.substring(F.coalesce(name, F.lit("")), 1, 120).alias("name"), F.when(etf, "etf").otherwise("equity_us").alias("grp"), F.lit(exchange).alias("exchange"), F.lit("USD").alias("currency"))


def crypto(markets: DataFrame, quote: str = "USDT", most: int = 300) -> DataFrame:
    """The most traded active spot pairs; markets: symbol, base, quote, spot, active, quote_volume."""
    rows = markets.where(F.col("spot") & F.col("active") & (F.col("quote") == quote)).orderBy(F.desc("quote_volume"), "symbol").limit(most)
    return rows.select("symbol", F.col("base").alias("name"), F.lit("crypto").alias("grp"), F.lit("").alias("exchange"), F.lit("USD").alias("currency"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The markets of a venue out of a CSV file: symbol, base, quote, spot, active, quote_volume; what is no number or truth value is null."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select("symbol", "base", "quote", *[F.expr(f"coalesce(try_cast({c} AS boolean), false)").alias(c) for c in ("spot", "active")], F.expr("try_cast(quote_volume AS double)").alias("quote_volume"))


def build(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The union by priority of the source, one row for each symbol, and the groups that have none."""
    both = None
    for name, rows in sources.items():
        rows = rows.withColumn("_rank", F.lit(PRIORITY[name]))
        both = rows if both is None else both.unionByName(rows)
    first = Window.partitionBy("symbol").orderBy("_rank", "name")
    universe = both.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place", "_rank")
    wanted = both.sparkSession.createDataFrame([(g,) for g in GROUPS], "grp string")
    return universe, wanted.join(universe.select("grp").distinct(), "grp", "left_anti")
