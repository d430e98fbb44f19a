"""A batch data source: bars of symbols from files, read in parallel; filters on symbol and date reach the reader."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition


class Piece(InputPartition):
    """The files whose name hashes to this piece."""

    def __init__(self, piece: int):
        self.piece = piece


class Narrowed(DataSourceReader):
    """A reader that keeps to ``symbols`` (None: all) and to dates from ``start`` on (ISO; empty: all)."""

    symbols: set[str] | None = None
    start = ""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on the symbol and on the earliest date; gives the others back."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = named if self.symbols is None else self.symbols & named
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("date",):
                self.start = max(self.start, f.value.isoformat())
                if isinstance(f, GreaterThan):
                    yield f  # the day itself goes later
            else:
                yield f


class _Reader(Narrowed):
    def __init__(self, options: dict):
        self.folder, self.pieces = options["path"], int(options.get("pieces", "16"))

    def partitions(self) -> list[Piece]:
        return [Piece(k) for k in range(self.pieces)]

    def read(self, partition: Piece):
        import csv
        import datetime

        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        for found in files.get_file_info(fs.FileSelector(root)):
            symbol = found.base_name.removesuffix(".csv")
            mine = found.type == fs.FileType.File and found.base_name.endswith(".csv") and zlib.crc32(symbol.encode()) % self.pieces == partition.piece
            if not mine or (self.symbols is not None and symbol not in self.symbols):
                continue
            try:
                with files.open_input_stream(found.path) as raw:
                    rows = [
                        (symbol, datetime.date.fromisoformat(row["date"]), *(float(row[c]) if row.get(c) else None for c in ("open", "high", "low", "close", "volume")))
                        for row in csv.DictReader(raw.read().decode().splitlines())
                        if row["date"] >= self.start and row["close"]
                    ]
            except (OSError, KeyError, TypeError, ValueError):
                continue  # a symbol that does not answer; the others do
            yield from rows


class BarFiles(DataSource):
    """Options: path (folder of <symbol>.csv), pieces (tasks). A symbol whose file is broken has no rows.

    Load it anew for each query: Spark keeps what one query pushed into a DataFrame for a next one without filters.
    """

    @classmethod
    def name(cls) -> str:
        return "bar_files"

    def schema(self) -> str:
        return "symbol string, date date, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(BarFiles)
