"""Histogram sort of documents into shards of nearly equal bytes; equal texts stay together.

Keys are 64-bit hashes of texts. Groups of equal texts that weigh much of a shard cannot be cut, so they
are placed first, the heaviest into the lightest shard; their number is bounded by ``shards * HEAVY``.
The rest is sorted by key: each round counts the exact bytes below a grid of candidate boundaries in all
partitions, and refines the grid only where a splitter still misses its target by more than the
tolerance. With the splitters known, rows are exchanged once, by shard and by cells within a shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.llm.scratch import Scratch

#: A group of equal texts counts as heavy from this fraction of a mean shard on.
HEAVY = 50
#: Bits of the first grid, and of each refinement.
GRID_BITS, REFINE_BITS = 9, 6


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, key of each row; null text has no bytes, checksum 0, and a key of its own."""
    t = F.col(text)
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(t).alias("key"),
    )


def place_heavy(weights: dict[int, int], total: int, shards: int) -> tuple[dict[int, int], list[int]]:
    """Shard of each heavy key, and bytes that each shard still takes: all shards are filled up to one level."""
    load = [(0, s) for s in range(shards)]
    homes = {}
    for key, size in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        have, shard = heapq.heappop(load)
        homes[key] = shard
        heapq.heappush(load, (have + size, shard))
    light = total - sum(weights.values())
    level, below, used = 0.0, 0, sorted(load)
    for n, (have, _) in enumerate(used, 1):
        below += have
        level = (light + below) / n
        if n == shards or level <= used[n][0]:
            break
    room = {s: max(0.0, level - have) for have, s in load}
    return homes, [room[s] for s in range(shards)]


def splitters(light: DataFrame, targets: list[float], tolerance: float) -> list[int]:
    """Boundaries: so many bytes of ``light`` (key, size) have a smaller key as the targets say, up to the tolerance.

    Only sums for cells of the grid reach the driver: 2^GRID_BITS at first, then 2^REFINE_BITS for each splitter.
    """
    width = 64 - GRID_BITS
    cells = {None: (-(1 << 63), 0, list(range(len(targets))))}  # coarse cell: its low end, bytes before it, its splitters
    found = [0] * len(targets)
    coarse = 64
    while cells:
        rows = light if coarse == 64 else light.where(F.shiftright("key", coarse).isin(list(cells)))
        sums: dict[int | None, list] = {}
        for cell, size in rows.groupBy(F.shiftright("key", width).alias("cell")).agg(F.sum("size").alias("size")).collect():
            sums.setdefault(None if coarse == 64 else cell >> (coarse - width), []).append((cell, size))
        finer: dict[int | None, tuple] = {}
        for parent, (low, before, wanted) in cells.items():
            edges = [(low, before, None)]  # boundary, bytes below it, the cell above it
            for cell, size in sorted(sums.get(parent, [])):
                start = cell << width
                if edges[-1][0] != start:
                    edges.append((start, edges[-1][1], None))
                edges[-1] = (start, edges[-1][1], cell)
                edges.append((start + (1 << width), edges[-1][1] + size, None))
            for s in wanted:
                near = min(edges, key=lambda e: abs(e[1] - targets[s]))
                inside = next((e for e, after in zip(edges, edges[1:], strict=False) if e[1] < targets[s] < after[1] and e[2] is not None), None)
                found[s] = near[0]
                if inside is not None and width and abs(near[1] - targets[s]) > tolerance:
                    finer.setdefault(inside[2], (inside[0], inside[1], []))[2].append(s)
        cells, coarse = finer, width
        width = max(0, width - REFINE_BITS)
    return found


def _between(key: Column, bounds: list[int], low: int, high: int) -> Column:
    """How many of bounds[low:high] are at or below the key, by halving; plus low."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    if bounds[mid] >= 1 << 63:  # beyond the largest key
        return _between(key, bounds, low, mid)
    return F.when(key < bounds[mid], _between(key, bounds, low, mid)).otherwise(_between(key, bounds, mid + 1, high))


def histogram_shards(docs: DataFrame, shards: int = 40, tolerance: float = 0.01, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in each shard) of every row.

    Law: sizes near equal. size: UTF-8 bytes of the text and 16; a null text has none, and null texts are one
    group. A shard strays from its share by a group that is too heavy to fit, else by the tolerance of each of
    its two splitters plus the lightest groups at them. Rows that repeat a doc_id each have a slot. An empty
    table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    rows = scratch.save(keyed(docs, doc_id, text), "keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * (shards * HEAVY) >= total)
    homes, room = place_heavy({k: b for k, b in groups.collect()}, total, shards)  # shards * HEAVY rows at most
    heavy = F.broadcast(spark.createDataFrame(list(homes.items()), "key long, home int"))
    placed = rows.join(heavy, "key", "left")
    ends, so_far = [], 0.0
    for r in room[:-1]:
        so_far += r
        ends.append(so_far)
    bounds = splitters(placed.where("home is null").select("key", "size"), ends, tolerance * total / shards) if count else [0] * (shards - 1)
    placed = placed.withColumn("shard", F.coalesce("home", _between(F.col("key"), sorted(bounds), 0, shards - 1)).cast("int"))
    cells = 4 * max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per_cell = max(1, count // cells)
    held = {s: n for s, n in placed.groupBy("shard").count().collect()}
    pieces = F.array(*[F.lit(max(1, -(-held.get(s, 0) // per_cell))) for s in range(shards)])
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "key"), F.get(pieces, F.col("shard"))))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "cell").orderBy("key", "doc_id", "size", "text_crc32")
    slotted = placed.withColumn("within", F.row_number().over(within) - 1)
    out = slotted.join(F.broadcast(offsets), ["shard", "cell"])  # as many rows as cells, set above
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("within")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Writes the documents in one folder for each shard, in the order of their slots; doc_id must be unique in docs."""
    rows = docs.join(assigned.select(F.col("doc_id").alias(doc_id), "shard", "slot"), doc_id)
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
