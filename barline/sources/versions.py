"""A table of bars in versions: partitions by group and period, of which a change rewrites only those it touches.

    <path>/data/v=<version>/grp=<group>/period=<year>/part-...parquet
    <path>/log/<version>.json        which folders make up the table, and what the writer wants to know again

A version exists once its log file does, which takes its name in one step and never replaces another. Readers take the newest one, so they
see the old table or the new one at any time, whatever stops a writer; what it left behind is found by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators.ingest import keep_last, upsert

PERIOD = "yyyy"


class Conflict(RuntimeError):
    """Another writer has made this version."""


class VersionedStore:
    """schema: the bars' columns, among them symbol, grp and date."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.root, self.schema = spark, path.rstrip("/"), schema
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- the log --------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        """Numbers of all versions, ascending."""
        folder = self.path(f"{self.root}/log")
        if not self.files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def entry(self, version: int | None = None) -> dict:
        """folders and notes of a version, the newest by default; of a table that was never written, none."""
        known = self.versions()
        if not known:
            return {"version": 0, "folders": [], "notes": {}}
        version = known[-1] if version is None else version
        stream = self.files.open(self.path(f"{self.root}/log/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, folders: list[str], notes: dict) -> None:
        """The one step that makes a version: a file written aside takes its name, if nobody has it."""
        aside, name = self.path(f"{self.root}/log/.{uuid.uuid4().hex}"), self.path(f"{self.root}/log/{version:012d}.json")
        out = self.files.create(aside, False)
        out.write(bytearray(json.dumps({"version": version, "folders": sorted(folders), "notes": notes}).encode()))
        out.close()
        if self.files.exists(name) or not self.files.rename(aside, name):
            self.files.delete(aside, False)
            raise Conflict(f"version {version} of {self.root} is there already")

    # ---- reading --------------------------------------------------------------------------------

    def _of(self, folders: list[str]) -> DataFrame:
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, period string, v string").option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/{f}" for f in folders])
        return rows.select(*columns)

    def read(self, version: int | None = None) -> DataFrame:
        return self._of(self.entry(version)["folders"])

    def notes(self) -> dict:
        return self.entry()["notes"]

    # ---- writing --------------------------------------------------------------------------------

    def write_folders(self, rows: DataFrame) -> list[str]:
        """Writes rows under a new name; returns its folders, which no version knows yet."""
        name = f"v={uuid.uuid4().hex}"
        out = rows.withColumn("period", F.date_format("date", PERIOD)).repartition("grp", "period", "symbol").sortWithinPartitions("grp", "period", "symbol", "date")
        out.write.partitionBy("grp", "period").option("compression", "zstd").parquet(f"{self.root}/data/{name}")
        here = self.path(f"{self.root}/data/{name}")
        return [f"{name}/{g.getPath().getName()}/{p.getPath().getName()}" for g in self.files.listStatus(here) if g.isDirectory() for p in self.files.listStatus(g.getPath())]

    @staticmethod
    def _part(folder: str) -> str:
        return folder.split("/", 1)[1]

    def replace(self, rows: DataFrame, notes: dict | None = None, gate: Callable[[DataFrame], object] | None = None) -> int:
        """A new version of these rows alone. gate: sees the whole table before it becomes a version; if it raises, there is none."""
        was = self.entry()
        folders = self.write_folders(rows)
        if gate:
            gate(self._of(folders))
        self.commit(was["version"] + 1, folders, was["notes"] | (notes or {}))
        return was["version"] + 1

    def merge(self, rows: DataFrame, keys: tuple[str, ...] = ("symbol", "date"), notes: dict | None = None, gate: Callable[[DataFrame], object] | None = None) -> int:
        """Upserts rows (the last of equal keys is any one of them, by its hash).

        Folders of other groups and periods stay as they are. A symbol that comes with another group takes its old rows there.
        """
        was = self.entry()
        rows = keep_last(rows.withColumn("_one", F.lit(0)), list(keys), "_one").drop("_one")
        groups = rows.groupBy("symbol").agg(F.max("grp").alias("new_grp"))
        moved = self._of(was["folders"]).select("symbol", "grp").distinct().join(groups, "symbol").where(~F.col("grp").eqNullSafe(F.col("new_grp")))
        left = {self._named(r.grp, None) for r in moved.select("grp").distinct().collect()}  # names of groups
        touched = {self._named(r.grp, r.period) for r in rows.select("grp", F.date_format("date", PERIOD).alias("period")).distinct().collect()}  # names of folders
        gained = {self._named(r.new_grp, None) for r in moved.select("new_grp").distinct().collect()}
        old = [f for f in was["folders"] if self._part(f) in touched or self._part(f).split("/")[0] in left | gained]
        before = self._of(old).join(groups, "symbol", "left")
        before = before.withColumn("grp", F.coalesce("new_grp", "grp")).drop("new_grp")
        folders = self.write_folders(upsert(before, rows.select(*before.columns), list(keys)))
        folders += [f for f in was["folders"] if f not in set(old)]
        if gate:
            gate(self._of(folders))
        self.commit(was["version"] + 1, folders, was["notes"] | (notes or {}))
        return was["version"] + 1

    def _named(self, grp: str | None, period: str | None) -> str:
        """The folder that Spark gives a group and a period."""
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return f"{name('grp', grp)}/{name('period', period)}" if period is not None else name("grp", grp)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the folders that none of the last ``keep`` versions has, and older log files; returns the folders' names."""
        known = self.versions()
        for old in known[:-keep]:
            self.files.delete(self.path(f"{self.root}/log/{old:012d}.json"), False)
        used = {f.split("/")[0] for v in known[-keep:] for f in self.entry(v)["folders"]}
        data = self.path(f"{self.root}/data")
        gone = [s.getPath() for s in self.files.listStatus(data) if s.getPath().getName() not in used] if self.files.exists(data) else []
        for p in gone:
            self.files.delete(p, True)
        return [p.getName() for p in gone]
