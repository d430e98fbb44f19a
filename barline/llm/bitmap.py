"""A bitmap of fixed size: which slots of a hash occur. What is not in it can be passed over; the rest is checked."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.scratch import Scratch

#: Rows of ids (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Slots of the bitmap of ids beyond that, for each one, and most bits of the number of a slot (64 MB).
SLOTS_A_ROW, MOST_BITS = 32, 29


def _packed(rows: DataFrame, slot: Column) -> DataFrame:
    """bucket, bits: the bitmap of slots, 32768 of them in a row of 4 KB."""
    one = slot.cast("long") + 1  # Spark's bitmaps count from 1
    return rows.select(F.bitmap_bucket_number(one).alias("bucket"), F.bitmap_bit_position(one).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def bitmap(rows: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """Bytes of the bitmap of slots 0 to 2^bits - 1; 2^bits / 32768 rows of 4 KB reach the driver at most."""
    whole = np.zeros(max((1 << bits) // 8, 4096), np.uint8)
    for bucket, held in _packed(rows, slot).collect():
        at = (bucket - 1) * 4096
        whole[at : at + 4096] = np.frombuffer(bytes(held), np.uint8)
    return whole


def contains(whole: np.ndarray, slot: np.ndarray) -> np.ndarray:
    slot = slot.astype(np.int64)
    return (whole[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def without(docs: DataFrame, gone: DataFrame, **keys: Column) -> DataFrame:
    """The rows of docs whose keys are not in gone (a written table with a column for each of them); null equals null.

    Beyond BROADCAST_ROWS of them only keys are shuffled, no other column: rows whose slot of a bitmap is empty stay; of the others the keys are joined
    with gone, and the few that only share a slot with one are broadcast to let their rows stay.
    """
    many = gone.count()
    if many <= BROADCAST_ROWS:
        return docs.join(F.broadcast(gone.select(*[F.col(k).alias(f"_other_{k}") for k in keys])), _same(keys), "left_anti")
    bits = min((SLOTS_A_ROW * many).bit_length(), MOST_BITS)
    scratch, names = Scratch(docs.sparkSession, "without"), [f"_other_{k}" for k in keys]
    slots = _packed(gone, F.pmod(F.xxhash64(*keys), F.lit(1 << bits))).select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    slots = F.broadcast(scratch.save(slots, "slots"))  # 2^bits / 8 bytes at most
    slot = F.pmod(F.xxhash64(*keys.values()), F.lit(1 << bits)) + 1
    bucket, at = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    full = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False))
    marked = docs.join(slots, bucket == F.col("_bucket"), "left").withColumn("_full", full).drop("_bucket", "_bits")
    some = marked.where("_full").select(*[value.alias(name) for name, value in zip(names, keys.values(), strict=True)]).distinct()
    spared = scratch.save(some.join(gone.select(*keys), _same({k: F.col(k) for k in keys}), "left_anti").withColumn("_spared", F.lit(True)), "spared")
    spared = F.broadcast(spared) if spared.count() <= BROADCAST_ROWS else spared
    return marked.join(spared, _same(keys), "left").where("not _full or _spared").select(*docs.columns)


def _same(keys: dict[str, Column]) -> Column:
    """Whether these keys of a row are those named _other_ of another one; null equals null."""
    return reduce(lambda a, b: a & b, [value.eqNullSafe(F.col(f"_other_{k}")) for k, value in keys.items()])
