"""The bar store: Parquet by group, sinks of the stages, and reshaping of wide tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators.ingest import keep_last

BAR_SCHEMA = "symbol string, grp string, date date, open float, high float, low float, close float, volume float"


def load(spark: SparkSession, path: str, schema: str = BAR_SCHEMA) -> DataFrame:
    """The stored bars; an empty table of the schema where there are none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def clean(bars: DataFrame, sequence: str) -> DataFrame:
    """Bars with a close, the last of each (symbol, date)."""
    return keep_last(bars.where("close is not null"), ["symbol", "date"], sequence)


def save(bars: DataFrame, path: str, sequence: str) -> None:
    """Cleaned bars in one folder for each group, sorted within files, so that filters on group, symbol and date prune."""
    rows = clean(bars, sequence).drop(sequence)
    rows.repartition("grp", "symbol").sortWithinPartitions("grp", "symbol", "date").write.mode("overwrite").partitionBy("grp").option("compression", "zstd").parquet(path)


def to_long(wide: DataFrame, key: str, fields: list[str], symbols: list[str]) -> DataFrame:
    """Columns <field>_<symbol> as rows (symbol, date, fields...); rows without a close go."""
    each = [F.struct(F.lit(s).alias("symbol"), *[F.col(f"`{f}_{s}`").cast("double").alias(f) for f in fields]) for s in symbols]
    rows = wide.select(F.to_date(key).alias("date"), F.explode(F.array(*each)).alias("x")).select("x.symbol", "date", *[f"x.{f}" for f in fields])
    return rows.where("close is not null and not isnan(close)")


def coerce(rows: DataFrame, fields: tuple[str, ...] = ("open", "high", "low", "close", "volume"), date: str = "date") -> DataFrame:
    """Numbers and dates out of whatever a download holds; what is none is null, as are NaN and infinities."""
    number = {f: F.expr(f"try_cast(`{f}` AS float)") for f in fields if f in rows.columns}
    sound = {f: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) for f, v in number.items()}
    return rows.withColumns(sound | {date: F.expr(f"try_cast(`{date}` AS date)")})


def append_keyed(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A ledger with new rows: the last row of each key, or distinct rows where it has no key."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, "_turn").drop("_turn") if keys else both.drop("_turn").distinct()
