"""The folder that driver and executors share: tables that are used several times, and state of streams."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_on_this_machine: dict[str, str] = {}


class NoSharedFolder(RuntimeError):
    """A cluster needs spark.checkpoint.dir."""


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one if all tasks run on this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _on_this_machine:
        _on_this_machine[app] = tempfile.mkdtemp(prefix="barline-")
        atexit.register(shutil.rmtree, _on_this_machine[app], ignore_errors=True)
    return f"file://{_on_this_machine[app]}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written or collected inside go when it ends; otherwise they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def saved(rows: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """rows as a table of the shared folder, made once for all its uses and read again where an executor is lost; by: rows of a key stand together."""
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, name)
    with shuffles_deleted(spark):
        (rows.repartition(by) if by else rows).write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: Rows of histories that a task holds, on average; it sorts them for several windows, with all their columns. Fewer cost time: each task of a stage with
#: many windows compiles some of their code anew. Of a panel fewer, as quantiles keep each value of each feature.
ROWS_A_TASK, PANEL_ROWS_A_TASK = 150_000, 30_000


def tasks_for(rows: DataFrame) -> int:
    """Over how many tasks histories are dealt, so that one holds as many rows however large the table is. Counts them, so rows should be a saved table."""
    return max(-(-rows.count() // ROWS_A_TASK), 1)


def panel_tasks_for(rows: DataFrame) -> int:
    """The same for the rows of a panel."""
    return max(-(-rows.count() // PANEL_ROWS_A_TASK), 1)


#: Sides of joins are broadcast up to this size.
BROADCAST_BYTES = 64 << 20


def beside(rows: DataFrame, side: DataFrame, row_bytes: int, tasks: int, *keys: str) -> DataFrame:
    """rows joined with side, which has a row for each of the keys and is counted, so it should be a saved table.

    Its size on disk says little, as each file has a footer of all columns. A side of few bytes is broadcast, so that rows need no sort;
    beyond that both are dealt over so many tasks, whatever the session's settings.
    """
    if side.count() * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side), [*keys])
    return dealt(rows, tasks, *keys).join(dealt(side, tasks, *keys), [*keys])


def unheld(spark: SparkSession) -> int:
    """Over how many tasks rows are dealt without being held: Spark writes a file for each, and beyond so many keeps all rows of a file split in memory."""
    return max(int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200")), 200)  # fewer would make large parts


def spread(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """rows of files, before they are dealt over so many tasks by keys of their own.

    How many rows one task reads is up to the files: a row group is never cut. Where they are dealt over more than ``unheld`` tasks they are first spread over so
    many, by keys that tell rows apart, so that none holds more than that part of them. The caller should add a column in between, else Spark takes the first step away.
    """
    most = unheld(rows.sparkSession)
    return dealt(rows, most, *keys) if tasks > most else rows


def dealt(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """rows by the hash of keys over so many tasks: unlike partitions that Spark makes itself, a given number is not merged again."""
    return rows.repartition(tasks, *keys)
