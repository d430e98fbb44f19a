"""Joins of whole documents with small tables about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a table that may be broadcast, by its rows and the bytes that each one has at most; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def text_keys(text: str = "text") -> list[Column]:
    """k1, k2: 128 bits that know a text; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(whole, F.lit(1)).alias("k2")]


def bounded(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, marked to be broadcast if all its rows together are small; row_bytes bounds one of them."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table
