"""Feeds over files that keep the contracts of downloads: pages by cursor, a reserve source with counted reasons, a fixed list of macro series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from barline.sources.batches import Narrowed
from barline.sources.universe import reserve_symbol

# The macro series of each group.
MACRO = {
    "commodity": (
        "GC=F SI=F HG=F CL=F BZ=F NG=F ZC=F ZW=F ZS=F KC=F SB=F CT=F PL=F PA=F LE=F HO=F RB=F OJ=F "
        "GLD SLV IAU USO BNO UNG DBC DBA CORN WEAT SOYB CANE PALL PPLT CPER URA GSG PDBC"
    ),
    "fx": (
        "EURUSD=X GBPUSD=X USDJPY=X USDCHF=X AUDUSD=X USDCAD=X NZDUSD=X USDCNY=X USDMXN=X USDBRL=X EURGBP=X EURJPY=X "
        "EURCHF=X EURSEK=X EURNOK=X USDSEK=X USDNOK=X USDPLN=X USDTRY=X USDZAR=X USDINR=X USDKRW=X USDSGD=X USDHKD=X "
        "AUDJPY=X GBPJPY=X CADJPY=X NZDJPY=X EURAUD=X DX-Y.NYB"
    ),
    "index": (
        "^GSPC ^NDX ^DJI ^RUT ^VIX ^IXIC ^NYA ^MID ^SML ^STOXX50E ^STOXX ^GDAXI ^FCHI ^IBEX ^FTSE ^AEX "
        "^SSMI ^OMX ^BFX ^ATX ^N225 ^HSI ^KS11 ^TWII ^AXJO ^GSPTSE ^MXX ^BVSP ^BSESN ^JKSE"
    ),
    "bond": (
        "^TNX ^TYX ^FVX ^IRX TLT IEF SHY LQD HYG EMB TIP BND AGG GOVT VGIT VGLT VCIT VCSH MBB BIL SHV IGSB SPTL SCHO BWX IGOV PCY "
        "FLOT SJNK ANGL JNK BSV"
    ),
}


def macro(spark: SparkSession) -> DataFrame:
    """symbol, name, grp, exchange, currency of the macro series."""
    rows = [(s, s, g, "", "USD") for g, names in MACRO.items() for s in names.split()]
    return spark.createDataFrame(rows, "symbol string, name string, grp string, exchange string, currency string")


def first_venue(venues: DataFrame) -> DataFrame:
    """venue, quote: the first in order of preference that can be reached; no row if none can. venues: place, venue, quote, reachable."""
    return venues.where("reachable").orderBy("place", "venue").limit(1).select("venue", "quote")


class Span(InputPartition):
    """Of a symbol the rows after the first ``skip`` bytes of page ``first``, up to ``stop`` bytes of page ``last``."""

    def __init__(self, symbol: str, first: int = 0, skip: int = 0, last: int | None = None, stop: int | None = None):
        self.symbol, self.first, self.skip, self.last, self.stop = symbol, first, skip, last, stop


class _Folder:
    """Folders of pages: <symbol>/page-<number>.csv, in which rows are only ever added at the end."""

    def __init__(self, options: dict):
        from pyarrow import fs

        uri = options["path"]
        self.store, self.root = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)

    def symbols(self) -> list[str]:
        from pyarrow import fs

        return sorted(f.base_name for f in self.store.get_file_info(fs.FileSelector(self.root)) if f.type == fs.FileType.Directory)

    def ends(self) -> dict[str, list[int]]:
        """Of each symbol the last page and its bytes, from names and sizes alone."""
        from pyarrow import fs

        out: dict[str, list[int]] = {}
        for f in self.store.get_file_info(fs.FileSelector(self.root, recursive=True)):
            if f.type == fs.FileType.File and f.base_name.startswith("page-"):
                symbol, number = f.path.rsplit("/", 2)[1], int(f.base_name[5:10])
                out[symbol] = max(out.get(symbol, [-1, 0]), [number, f.size])
        return out

    def page(self, symbol: str, number: int, stop: int | None = None) -> list[tuple[int, bool, dict]] | None:
        """The rows of a page, each with the byte it ends at and whether its line has its end. None where there is no page."""
        from pyarrow import fs

        path = f"{self.root}/{symbol}/page-{number:05d}.csv"
        if number < 0 or self.store.get_file_info(path).type != fs.FileType.File:
            return None
        with self.store.open_input_stream(path) as raw:
            text = raw.read()[:stop]
        out, head, at = [], None, 0
        for line in text.splitlines(keepends=True):
            at += len(line)
            cells = line.decode().strip().split(",")
            if head is None:
                head = cells
            elif len(cells) == len(head):
                out.append((at, line.endswith(b"\n"), dict(zip(head, cells, strict=True))))
        return out


def _bar(symbol: str, row: dict) -> tuple:
    import datetime

    date = datetime.datetime.fromtimestamp(int(row["ts"]) / 1000, datetime.UTC).date()
    return symbol, date, *[float(row[c]) if row.get(c) else None for c in ("open", "high", "low", "close", "volume")]


class _Pages(Narrowed):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.symbols = {s for s in options.get("symbols", "").split(",") if s} or None
        self.from_ms, self.size = int(options.get("start_ms", "0")), int(options.get("page", "1000"))

    def partitions(self) -> list[Span]:
        return [Span(s) for s in _Folder(self.options).symbols() if self.symbols is None or s in self.symbols]

    def read(self, partition: Span):
        folder, cursor, number = _Folder(self.options), self.from_ms, 0
        # A page holds the rows from the cursor on; a short one is the last.
        while (rows := folder.page(partition.symbol, number)) is not None:
            for _, _, row in rows:
                if int(row["ts"]) >= cursor:
                    cursor = int(row["ts"]) + 1
                    bar = _bar(partition.symbol, row)
                    if bar[1].isoformat() >= self.start:
                        yield bar
            number += 1
            if len(rows) < self.size:
                return


class _PageStream(DataSourceStreamReader):
    """An offset is the last page of each symbol and its bytes; what is between two offsets never changes, so a batch can be read again."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.from_ms = int(options.get("start_ms", "0"))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _Folder(self.options).ends()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(s, *start.get(s, [0, 0]), *at) for s, at in end.items() if start.get(s) != at]

    def read(self, partition: Span):
        folder, cursor = _Folder(self.options), self.from_ms
        # Where the rows before the span ended: in its first page or, if that had none then, in the page before.
        for number, stop in ((partition.first - 1, None), (partition.first, partition.skip)):
            for _, whole, row in folder.page(partition.symbol, number, stop) or ():
                if whole or number < partition.first:
                    cursor = max(cursor, int(row["ts"]) + 1)
        for number in range(partition.first, partition.last + 1):
            newest = number == partition.last
            for at, whole, row in folder.page(partition.symbol, number, partition.stop if newest else None) or ():
                before = number == partition.first and whole and at <= partition.skip
                coming = newest and not whole  # a line of the newest page is there once it has its end
                if not before and not coming and int(row["ts"]) >= cursor:
                    cursor = int(row["ts"]) + 1
                    yield _bar(partition.symbol, row)


class PagedCandles(DataSource):
    """Options: path (folder of <symbol>/page-<number>.csv with ts in milliseconds), symbols, start_ms, page (rows of a full page; batches only).

    A row comes once: pages may overlap, and the cursor goes on from the last time read. A symbol without a page has no row. Filters on the
    symbol and the earliest date reach the reader. As a stream it goes on where its checkpoint ends, also within a page that has grown since. A
    symbol is one task: its pages follow each other. Load it anew for each query: Spark keeps what one query pushed into a DataFrame for
    a next one without filters. ``register`` it, which also allows filters to be pushed.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_candles"

    def schema(self) -> str:
        return "symbol string, date date, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PageStream(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(PagedCandles)


RESERVE_SCHEMA = "Date string, Open string, High string, Low string, Close string, Volume string"


def reserve(spark: SparkSession, folder: str, symbols: DataFrame, start: str) -> tuple[DataFrame, DataFrame]:
    """Bars of the reserve source from ``start`` on, and why symbols have none: reason, symbols.

    The folder holds a file <reserve symbol>.csv for each symbol that it carries. Reasons: ``not carried`` (no reserve symbol), ``no file``,
    ``no rows`` (none that has a date and a close), ``too old`` (none from the start on), ``ok``.
    """
    wanted = symbols.select("symbol").distinct().withColumn("there", reserve_symbol(F.col("symbol")))
    raw = spark.read.schema(RESERVE_SCHEMA).option("header", True).csv(folder).withColumn("there", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    number = {c.lower(): F.expr(f"try_cast({c} AS double)") for c in ("Open", "High", "Low", "Close", "Volume")}
    rows = raw.select("there", F.expr("try_cast(Date AS date)").alias("date"), *[v.alias(k) for k, v in number.items()])
    sound = rows.where("date is not null and close is not null")
    bars = wanted.join(sound, "there").where(F.col("date") >= F.lit(start)).select("symbol", "date", "open", "high", "low", "close", "volume")
    files = rows.groupBy("there").agg(F.count_if(F.col("date").isNotNull() & F.col("close").isNotNull()).alias("sound"), F.count_if(F.col("close").isNotNull() & (F.col("date") >= F.lit(start))).alias("new"))
    told = wanted.join(files, "there", "left").select(
        F.when(F.col("there").isNull(), "not carried").when(F.col("sound").isNull(), "no file").when(F.col("sound") == 0, "no rows").when(F.col("new") == 0, "too old").otherwise("ok").alias("reason")
    )
    return bars, told.groupBy("reason").agg(F.count("*").alias("symbols"))
