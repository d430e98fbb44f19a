"""Small state beside the store: request marks, failure lists, universe snapshots, and the tables of each stage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructField, StructType, StringType

MARKS = "symbol string, asked_on date"
FAILED = "symbol string, since date, failures int"


def _csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of strings with a header; None where there is none."""
    try:
        rows = spark.read.option("header", True).csv(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return rows


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """symbol, asked_on: when a symbol's whole history was asked for last. Empty without a readable file; bad dates are left out."""
    rows = _csv(spark, path)
    if rows is None or not {"symbol", "asked_on"} <= set(rows.columns):
        return spark.createDataFrame([], MARKS)
    return rows.select("symbol", F.expr("try_cast(asked_on AS date)").alias("asked_on")).where("symbol is not null and asked_on is not null")


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    """symbol, since, failures of symbols that did not answer. Without the column one failure is meant; bad rows are left out."""
    rows = _csv(spark, path)
    if rows is None or not {"symbol", "since"} <= set(rows.columns):
        return spark.createDataFrame([], FAILED)
    n = F.coalesce(F.expr("try_cast(failures AS int)"), F.lit(1)) if "failures" in rows.columns else F.lit(1)
    return rows.select("symbol", F.expr("try_cast(since AS date)").alias("since"), n.alias("failures")).where("symbol is not null and since is not null")


def write_state(rows: DataFrame, path: str) -> None:
    """One small CSV file with a header, also where there are no rows."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def still_asked(marks: DataFrame, today: str, days: int = 30) -> DataFrame:
    """symbol: asked for in the last days, so not asked again."""
    return marks.where(F.datediff(F.to_date(F.lit(today)), F.col("asked_on")) < days).select("symbol")


def reload_due(stamp: str | None, today: str, every_days: int = 30) -> bool:
    """Whether the whole history is to be loaded again: never before, an unreadable stamp, or so many days ago."""
    import datetime

    try:
        last = datetime.date.fromisoformat((stamp or "").strip())
    except ValueError:
        return True
    return (datetime.date.fromisoformat(today) - last).days >= every_days


def save_universe(universe: DataFrame, folder: str, date: str) -> None:
    """The universe of a date as a partition of its own: what was listed on a day can be read back later. A repeated day replaces itself."""
    universe.coalesce(1).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{folder}/snapshot_date={date}")


def universe_on(spark: SparkSession, folder: str, date: str) -> DataFrame:
    """The newest snapshot up to a date."""
    schema = "symbol string, name string, grp string, exchange string, currency string, snapshot_date date"
    rows = spark.read.schema(schema).option("header", True).csv(folder).where(F.col("snapshot_date") <= F.lit(date))
    newest = rows.agg(F.max("snapshot_date").alias("snapshot_date"))
    return rows.join(F.broadcast(newest), "snapshot_date", "left_semi").drop("snapshot_date")  # one row


def save_stage(tables: dict[str, DataFrame], folder: str) -> None:
    """The tables that a stage hands on: Parquet, or CSV where the name ends so."""
    for name, rows in tables.items():
        if name.endswith(".csv"):
            write_state(rows, f"{folder}/{name}")
        else:
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def finite(value: Column, kind: DataType) -> Column:
    """The value with null for each NaN and infinity at any depth of structs, arrays and maps' values; keys of maps stay."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[finite(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: finite(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, x: finite(x, kind.valueType))
    return value


def write_json(rows: DataFrame, path: str) -> None:
    """One small JSON file, without NaN or infinities."""
    rows.select(*[finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields]).coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small JSON table; empty where there is none, or where any of its lines is broken: half a state is none."""
    wanted = spark.createDataFrame([], schema)
    told = StructType([*wanted.schema.fields, StructField("_corrupt", StringType())])
    try:
        lines = spark.read.text(path).where("trim(value) <> ''")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return wanted
    rows = lines.select(F.from_json("value", told, {"columnNameOfCorruptRecord": "_corrupt"}).alias("x")).select("x.*")
    broken = rows.agg(F.count_if(F.col("_corrupt").isNotNull()).alias("broken"))
    return rows.join(F.broadcast(broken)).where("broken = 0").select(*wanted.columns)  # one row
