"""Tables written in the folder that all executors share, to cut lineage and to reuse results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from barline.sources.shared import shuffles_deleted


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        here = tempfile.mkdtemp(prefix="barline-")
        atexit.register(shutil.rmtree, here, ignore_errors=True)
        folder = f"file://{here}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows than Spark's own: texts are long, and a batch is held by the JVM and by Python in each task."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


class Scratch:
    """A folder of its own for one run of an operator.

    ``save`` writes a DataFrame as Parquet and returns it as read back: lost executors then cost a
    read, not a recomputation; shuffle files go with each write. ``drop`` deletes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        short_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        with shuffles_deleted(self.spark):
            df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names, with a number after it or not; a name with its number is that table alone."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for held in store.listStatus(root):
            if (name := held.getPath().getName()) in names or name.rstrip("0123456789") in names:
                store.delete(held.getPath(), True)
