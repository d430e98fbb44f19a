"""Removal of long word passages that stand earlier too, found by anchors at the places of a difference cover.

Numbers modulo PERIOD in COVER have this property: for any two places i and j there is a step k < PERIOD at which both i + k
and j + k fall on the cover. Two equal windows of WINDOW words therefore share an anchor of WINDOW - PERIOD + 1 words that begins on
the cover in both documents and lies inside both windows. Only these anchors, 4 of 13 places, are counted over the corpus;
those that occur once drop out, the others are extended to all windows around them, and only these windows are compared.

Counts and earliest places are partial aggregates, so a passage that a third of all documents share travels as one row
of each task. Documents travel by themselves only where a table about them is too large to be broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.llm.bitmap import bitmap, contains
from barline.llm.scratch import Scratch
from barline.llm.sized import bounded, text_keys
from barline.llm.textblocks import CASED, fold, hashes, mix, slices, spans, utf8, word_hashes

# Words of a window, and a perfect difference set.
WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1

#: Bits of the number of a slot in the table of repeated anchors (16 MB). A fuller table only lets more anchors through to the exact join.
BITS = 27
#: Rows without a doc_id stand after all others.
LAST = (1 << 63) - 1

_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchors(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: row, place in its document and hash of each anchor."""
    words, begin = word_hashes(part.column("text"), CASED)
    runs = fold(words, ANCHOR)
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[: len(runs)]
    place = np.arange(len(runs)) - begin[:-1][row]
    keep = _ON_COVER[place % PERIOD] & (np.arange(len(runs)) + ANCHOR <= begin[1:][row]) & (np.diff(begin)[row] >= WINDOW)
    return row[keep], place[keep], runs[keep]


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, k1, again: each anchor of a document once."""
    for batch in batches:
        for part in slices(batch, "text"):
            row, _, anchor = _anchors(part)
            if not len(row):
                continue
            order = np.lexsort((row, anchor))
            new = np.ones(len(order), bool)
            new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (row[order][1:] != row[order][:-1])
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(order))) > 1
            at = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[at].view(np.int64)), part.column("k1").take(pa.array(row[at])), pa.array(many)], names=["anchor", "k1", "again"])


def _slot(anchor: Column) -> Column:
    return F.shiftrightunsigned(anchor, 64 - BITS)


def repeated_anchors(keyed: DataFrame) -> DataFrame:
    """anchor: those in two different texts, or twice in one. Copies of one text are one."""
    found = keyed.select("k1", "text").mapInArrow(_first_seen, "anchor long, k1 long, again boolean")
    per = found.groupBy("anchor").agg(F.min("k1").alias("low"), F.max("k1").alias("high"), F.max("again").alias("again"))
    return per.where("again or low <> high").select("anchor")


def candidate_runs(keyed: DataFrame, repeated: DataFrame) -> DataFrame:
    """k1, runs: the window starts of a text that an anchor of the table reaches, as array of (low, high)."""
    held = keyed.sparkSession.sparkContext.broadcast(bitmap(repeated, _slot(F.col("anchor")), BITS))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, place, anchor = _anchors(part)
                some = np.flatnonzero(contains(held.value, anchor >> np.uint64(64 - BITS))) if len(row) else row
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[some].view(np.int64)), part.column("k1").take(pa.array(row[some])), pa.array(place[some].astype(np.int32))], names=["anchor", "k1", "place"])

    hits = keyed.select("k1", "text").mapInArrow(places, "anchor long, k1 long, place int").join(repeated, "anchor", "left_semi")
    spots = hits.groupBy("k1", "place").agg(F.lit(1).alias("one"))  # copies of a text give equal places
    return _runs(spots.select("k1", F.greatest(F.col("place") - (PERIOD - 1), F.lit(0)).alias("low"), F.col("place").alias("high")), ["k1"])


def _runs(spans_: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (low, high; inclusive) merged where they touch: an array of them for each key."""
    own = Window.partitionBy(*keys).orderBy("high", "low")
    reach = F.max("high").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans_.withColumn("opens", (reach.isNull() | (F.col("low") > reach + 1)).cast("int"))
    numbered = opened.withColumn("run", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*keys, "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return merged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("runs"))


def _starts(runs: list[dict] | None) -> np.ndarray:
    """Every place of the runs."""
    return np.concatenate([np.arange(r["low"], r["high"] + 1) for r in runs]) if runs else np.zeros(0, np.int64)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """window, more (together 96 bits), id, start, k1 of the windows in the runs."""
    for batch in batches:
        for part in slices(batch, "text"):
            words, begin = word_hashes(part.column("text"), CASED)
            one, two = fold(words, WINDOW), fold(mix(words ^ np.uint64(0x5851F42D4C957F2D)), WINDOW)
            rows, starts = [], []
            for k, runs in enumerate(part.column("runs").to_pylist()):
                at = _starts(runs)
                at = at[at + WINDOW <= begin[k + 1] - begin[k]]
                rows.append(np.full(len(at), k))
                starts.append(at)
            row, start = np.concatenate(rows), np.concatenate(starts)
            if not len(row):
                continue
            at = begin[:-1][row] + start
            take = pa.array(row)
            columns = [pa.array(one[at].view(np.int64)), pa.array((two[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)), part.column("id").take(take), pa.array(start.astype(np.int32)), part.column("k1").take(take)]
            yield pa.RecordBatch.from_arrays(columns, names=["window", "more", "id", "start", "k1"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, n_removed, kept of each document."""
    for batch in batches:
        for part in slices(batch, "text"):
            offsets, data = utf8(part.column("text"))
            starts, ends = spans(offsets, data)
            begin = np.searchsorted(starts, offsets, side="left")
            out: list[tuple] = []
            for k, (copy, runs, first) in enumerate(zip(*(part.column(c).to_pylist() for c in ("copy", "runs", "first_runs")), strict=True)):
                low, high = int(begin[k]), int(begin[k + 1])
                n = high - low
                gone = np.zeros(n, bool)
                if copy:
                    gone[:] = n >= WINDOW
                elif runs and n >= WINDOW:
                    later = np.zeros(n + 1, np.int64)
                    at = _starts(runs)
                    at = np.setdiff1d(at[at + WINDOW <= n], _starts(first), assume_unique=True)
                    np.add.at(later, at, 1)
                    np.add.at(later, at + WINDOW, -1)
                    gone = np.cumsum(later[:n]) > 0
                s, e = starts[low:high][~gone], ends[low:high][~gone]
                kept = b" ".join(data[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True))
                out.append((n, int(gone.sum()), kept.decode()))
            n, removed, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.large_string()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by spaces): a row for each row of docs.

    A word goes if a window of WINDOW words that covers it has the words of a window that starts earlier: in a document of smaller
    doc_id, or earlier in the same one. Windows are judged on the whole input. Rows that repeat a doc_id are one
    document, judged by the place in the text and then by a hash of it; equal rows of it get equal results. Rows without a doc_id are
    such a document too, after all others. Null, empty and short texts lose nothing; an empty table gives an empty
    result; other columns are not looked at. Windows are known by 96 bits, texts by 128.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), *text_keys(text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    firsts = scratch.save(keyed.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "texts")
    repeated = scratch.save(repeated_anchors(keyed), "anchors")
    runs = scratch.save(candidate_runs(keyed, repeated).join(firsts.select("k1", "k2", "first"), "k1"), "runs")
    of_runs = bounded(runs.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), "first", "runs"), _row_bytes(runs))
    one = keyed.join(of_runs, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & (F.col("id") == F.col("first")))
    windows = one.select("k1", "id", "runs", "text").mapInArrow(_windows, "window long, more int, id long, start int, k1 long")
    first = windows.groupBy("window", "more").agg(F.min(F.struct("id", "start", "k1")).alias("at")).select("at.id", "at.k1", F.col("at.start").alias("low"), F.col("at.start").alias("high"))
    first = scratch.save(_runs(first, ["id", "k1"]).withColumnRenamed("runs", "first_runs"), "first")
    both = runs.join(first.withColumnRenamed("id", "first"), ["first", "k1"], "left")
    known = firsts.where("copies > 1").select("k1", "k2", "first").join(both.select("k1", "k2", "runs", "first_runs"), ["k1", "k2"], "full")
    known = scratch.save(known.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), "first", "runs", "first_runs"), "known")
    all_rows = keyed.join(bounded(known, _row_bytes(known)), (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left")
    last = all_rows.select("doc_id", "text", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("copy"), "runs", "first_runs")
    return last.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def _row_bytes(table: DataFrame) -> int:
    """Bytes of a row at most, on the average of the whole table: 12 of each run, 64 of the rest."""
    counted = [F.coalesce(F.size(c), F.lit(0)) for c in ("runs", "first_runs") if c in table.columns]
    total = counted[0] if len(counted) == 1 else counted[0] + counted[1]
    return 64 + 24 * (int(table.agg(F.avg(total)).first()[0] or 0) + 1)
