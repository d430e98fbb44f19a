"""Streams: bars from ticks, upserts with a late-data bound, failure counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.sources.shared import new_folder
from barline.sources.versions import VersionedStore

FAILURES = "symbol long, failures int, since timestamp_ntz"


def work_dir(spark: SparkSession) -> str:
    """A folder of its own under the shared one."""
    return new_folder(spark, "stream")


def ticks(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A stream of the events file of a folder; event times are read in the session's time zone (UTC)."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tick_bars(stream: DataFrame, symbol: str = "user_id", price: str = "value", length: str = "1 day", slide: str | None = None, late: str = "1 hour", order: str = "event_id") -> DataFrame:
    """Bars of event time; in append mode a bar comes out when no tick of it can come any more."""
    turn = F.struct("ts", order)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    bars = stream.withWatermark("ts", late).groupBy(window, F.col(symbol).alias("symbol")).agg(
        F.min_by(price, turn).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, turn).alias("close"), F.count("*").alias("volume")
    )
    return bars.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), "open", "high", "low", "close", "volume")


def session_activity(stream: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Runs of events of a user without a pause longer than the gap."""
    runs = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("run"), F.col("user_id").alias("symbol")).agg(F.count("*").alias("events"))
    return runs.select("symbol", F.col("run.start").cast("timestamp_ntz").alias("start"), F.col("run.end").cast("timestamp_ntz").alias("end"), "events")


def run_to_table(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs what is available now into Parquet files, and returns them. With a folder given, the next call goes on from there."""
    spark = stream.sparkSession
    folder = folder or work_dir(spark)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_counters(stream: DataFrame, failed: str = "event_type = 'error'", folder: str | None = None) -> DataFrame:
    """symbol, failures, since: of each symbol the failures in a row, by event time within a batch; a success clears them.

    Each batch is reduced by Spark to the failures after the last success of each symbol, however many events that has; only
    these sums meet the state, a table for each batch, of which a repeated batch rewrites its own. Tables of batches before the last
    two are deleted. With a folder given, the next call goes on from there.
    """
    folder = folder or work_dir(stream.sparkSession)

    def count(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.struct("ts", "event_id").alias("turn"), F.coalesce(F.expr(failed), F.lit(False)).alias("failed"))
        sound = rows.groupBy("symbol").agg(F.max(F.when(~F.col("failed"), F.col("turn"))).alias("sound"))
        after = rows.join(sound, "symbol").where(F.col("failed") & (F.col("sound").isNull() | (F.col("turn") > F.col("sound")))).groupBy("symbol").agg(F.count("*").alias("more"), F.min("ts").alias("first"))
        new = sound.join(after, "symbol", "left")
        before = batch.sparkSession.read.schema(FAILURES).parquet(f"{folder}/out/batch={number - 1}") if number else batch.sparkSession.createDataFrame([], FAILURES)
        kept = F.when(F.col("sound").isNull(), F.coalesce("failures", F.lit(0))).otherwise(0)
        both = before.join(new, "symbol", "full_outer").select("symbol", (kept + F.coalesce("more", F.lit(0))).cast("int").alias("failures"), F.when(kept > 0, F.col("since")).otherwise(F.col("first")).alias("since"))
        both.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        old = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{folder}/out/batch={number - 2}")
        old.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(old, True)

    stream.writeStream.foreachBatch(count).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    states = stream.sparkSession.read.schema(FAILURES + ", batch int").parquet(f"{folder}/out")
    return states.join(F.broadcast(states.agg(F.max("batch").alias("batch"))), "batch", "left_semi").drop("batch")  # one row


def merge_stream(stream: DataFrame, store: VersionedStore, state: str, keys: tuple[str, ...] = ("symbol", "date"), late_days: int = 7) -> None:
    """Upserts what is available now into a store. ``state`` is the stream's checkpoint: with the same one the next call goes on where this one ended.

    A row more than ``late_days`` days before the newest date of the batches before it is too late: it is counted and left out. Each version notes
    the stream, its batch and its newest date, so a batch that comes again after a stop is passed over.
    """

    def merge(batch: DataFrame, number: int) -> None:
        notes = store.notes()
        mine = notes.get("streams", {}).get(state, {"batch": -1, "newest": None})
        if number <= mine["batch"]:
            return
        bound = F.date_sub(F.lit(mine["newest"]).cast("date"), late_days)
        told = batch.agg(F.max("date").cast("string").alias("newest"), F.count_if(F.col("date") < bound).alias("late")).first()
        newest = max(filter(None, (mine["newest"], told.newest)), default=None)
        streams = notes.get("streams", {}) | {state: {"batch": number, "newest": newest}}
        store.merge(batch.where((F.col("date") >= bound) | bound.isNull()), keys, {"streams": streams, "late": notes.get("late", 0) + told.late})

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
