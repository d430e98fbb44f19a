"""Tickers in the tables of HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADS = ("ticker", "symbol", "epic")


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append("".join(self.cell).strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def tickers(html: str | None, suffix: str = "", least_rows: int = 15) -> list[str]:
    """Of the first table with enough rows and a ticker column: cleaned symbols, with the suffix unless they have a dot."""
    reader = _Tables()
    reader.feed(html or "")
    for head, *rows in (t for t in reader.tables if t):
        at = next((k for k, c in enumerate(head) if any(h in c.lower() for h in HEADS)), None)
        if at is None or len(rows) < least_rows:
            continue
        raw = [r[at].upper().replace(" ", "") for r in rows if len(r) > at]
        return [s if "." in s else s + suffix for s in raw if 0 < len(s) <= 8]
    return []


def ticker_rows(pages: DataFrame, id_col: str = "page_id", html: str = "html", suffix: str = "", least_rows: int = 15) -> DataFrame:
    """page_id, symbol, currency: pounds for London (.L), else euros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, s) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in tickers(h, suffix, least_rows)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([s for _, s in found], pa.string())], names=["page_id", "symbol"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), html).mapInArrow(run, "page_id long, symbol string")
    return rows.withColumn("currency", F.when(F.col("symbol").endswith(".L"), "GBP").otherwise("EUR"))


def listed_pages(spark: SparkSession, folder: str, least_rows: int = 15) -> DataFrame:
    """symbol, name, grp, exchange, currency of the members of European indices: a page <index>.<SUFFIX>.html for each, members without a dot take its suffix."""
    at = F.input_file_name()
    pages = spark.read.option("wholetext", True).text(folder).select(F.xxhash64(at).alias("page_id"), F.regexp_extract(at, r"(\.[A-Z]+)\.html?$", 1).alias("suffix"), F.col("value").alias("html"))
    found = ticker_rows(pages, least_rows=least_rows).join(pages.select("page_id", "suffix"), "page_id")
    symbol = F.when(F.col("symbol").contains("."), F.col("symbol")).otherwise(F.concat("symbol", "suffix"))
    rows = found.select(symbol.alias("symbol")).distinct()
    return rows.select("symbol", F.col("symbol").alias("name"), F.lit("equity_eu").alias("grp"), F.lit("").alias("exchange"), F.when(F.col("symbol").endswith(".L"), "GBP").otherwise("EUR").alias("currency"))
