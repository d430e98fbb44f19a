"""Benchmark decontamination on canonical templates.

Numbers, names and units are replaced by typed placeholders, a name of several words by one, so that a question with
other numbers or names has the same template. Windows of ``WINDOW`` canonical words of the documents are hash-joined
with those of the benchmark items; a window of which more than half is placeholders says too little without its
values and is joined with them. Where windows meet in one alignment, the values in the placeholders must correspond one to
one: a value of the item always becomes the same value in the document, and no other value becomes that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.bitmap import bitmap, contains
from barline.llm.scratch import Scratch
from barline.llm.textblocks import CASED, fold, hashes, mix, slices, spans, utf8

WINDOW = 8
#: Items of fewer words than this say too little to be looked for.
LEAST_WORDS = 3
BITS = 24
#: Bits of the number of a slot in the table of the benchmark's names (512 KB). Words that share a slot with one are placeholders too, on both sides alike.
NAME_BITS = 22
#: Windows of the benchmark (about 100 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000

# Units that are read as one.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees "
    "meter meters metre metres kilometer kilometers kilogram kilograms mph kmh"
).split()
NUMBER, NAME, UNIT, VALUES = (mix(np.array([k], np.uint64))[0] for k in (101, 102, 103, 104))

_DROP = np.zeros(256, bool)
_DROP[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_ENDS_SENTENCE = np.zeros(256, bool)
_ENDS_SENTENCE[list(b".!?:")] = True


def canonical(column: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical words, slot values (0 for plain words), and where each text's words begin.

    A word is a run without ASCII white space, less ASCII punctuation, in lower case (Latin letters). It is a
    number if it begins with a digit, a unit if listed, a name if it begins with a capital but no sentence, or if it is in
    ``known`` (a bitmap), whatever its case. Words in capitals next to each other are shouted: that makes no names of them. Names that
    follow each other in a sentence are one, of one value.
    """
    words, name, fixed, place, begin = _words(column, known)
    return _slots(words, name, fixed, place, begin)


def _words(column: pa.Array, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its hash, whether it is a name, its placeholder if it is a number or unit, its place; and where each text's words begin."""
    offsets, data = utf8(column)
    starts, ends = spans(offsets, data)
    keep = ~_DROP[data]
    kept = np.concatenate([[0], np.cumsum(keep)])
    low, high = kept[starts], kept[ends]
    some = high > low
    line = np.concatenate([[0], np.cumsum(data == 0x0A)])
    opens = np.zeros(len(starts), bool)
    if len(starts):
        opens[0] = True
        opens[1:] = _ENDS_SENTENCE[data[ends[:-1] - 1]] | (line[starts[1:]] > line[ends[:-1]])
        own = np.searchsorted(starts, offsets[:-1], side="left")
        opens[own[own < len(starts)]] = True
    starts, low, high, opens = starts[some], low[some], high[some], opens[some]
    text = data[keep]
    after_c3 = np.zeros(len(text), bool)
    after_c3[1:] = text[:-1] == 0xC3
    capital = ((text >= 0x41) & (text <= 0x5A)) | (after_c3 & (text >= 0x80) & (text <= 0x9E) & (text != 0x97))
    lower = np.where(capital, text + 0x20, text).astype(np.uint8)
    words = hashes(lower, low, high, CASED)
    second = np.minimum(low + 1, len(text) - 1)
    big = capital[low] | ((text[low] == 0xC3) & capital[second]) if len(low) else np.zeros(0, bool)
    number = (text[low] >= 0x30) & (text[low] <= 0x39)
    unit = np.isin(words, _unit_hashes()) & ~number
    begin = np.searchsorted(starts, offsets, side="left")
    small = ((text >= 0x61) & (text <= 0x7A)) | (after_c3 & (text >= 0xA0) & (text <= 0xBE) & (text != 0xB7))
    letters = np.concatenate([[0], np.cumsum(small)])
    loud = big & (letters[high] == letters[low])
    beside = np.zeros(len(loud), bool)  # the word before is in capitals too, in the same text
    beside[1:] = loud[1:] & loud[:-1]
    beside[begin[:-1][begin[:-1] < len(loud)]] = False
    shouted = beside.copy()
    shouted[:-1] |= beside[1:]
    name = big & ~opens & ~shouted
    if known is not None:
        name |= contains(known, words >> np.uint64(64 - NAME_BITS))
    name &= ~number & ~unit
    fixed = np.where(number, NUMBER, np.where(unit, UNIT, np.uint64(0)))
    return words, name, fixed, np.arange(len(words)), begin


def _slots(words: np.ndarray, name: np.ndarray, fixed: np.ndarray, place: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = np.where(fixed != 0, fixed, np.where(name, NAME, words))
    goes_on = np.zeros(len(out), bool)  # a name right after a name
    goes_on[1:] = name[1:] & name[:-1]
    goes_on[begin[:-1][begin[:-1] < len(out)]] = False
    first = np.flatnonzero(~goes_on)
    place = place - np.maximum.accumulate(np.where(goes_on, 0, place)) if len(out) else place
    whole = np.where(name, mix(words + place.astype(np.uint64)), words)
    value = np.add.reduceat(whole, first) if len(first) else whole
    slot = (name | (fixed != 0))[first]
    return out[first], np.where(slot, value | np.uint64(1), np.uint64(0)), np.searchsorted(first, begin, side="left")


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        at, raw = utf8(pa.array(UNITS))
        _units.append(hashes(raw, at[:-1], at[1:], CASED))
    return _units[0]


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words, name, *_ = _words(part.column("text"), None)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words[name]).view(np.int64))], names=["name"])


def _windows(batch: pa.RecordBatch, sizes: list[int] | None, wanted: np.ndarray | None, known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """id, words (of the text), size, window, at, slots. sizes None: one size for each text, as long as it allows."""
    for part in slices(batch, "text"):
        words, slots, begin = canonical(part.column("text"), known)
        n = np.diff(begin)
        ids = part.column("id")
        row = np.repeat(np.arange(len(n)), n)
        own = np.minimum(n, WINDOW)
        plain = np.concatenate([[0], np.cumsum(slots == 0)])
        for size in sizes if sizes is not None else range(LEAST_WORDS, WINDOW + 1):
            m = max(len(words) - size + 1, 0)
            telling = 2 * (plain[size : size + m] - plain[:m]) >= size
            window = np.where(telling, fold(words, size), fold(np.where(slots == 0, words, slots), size) ^ VALUES) ^ np.uint64(size)
            ok = begin[1:][row[:m]] - np.arange(m) >= size
            if sizes is None:
                ok &= own[row[:m]] == size
            if wanted is not None:
                ok &= contains(wanted, window >> np.uint64(64 - BITS))
            at = np.flatnonzero(ok)
            if len(at):
                values = slots[at[:, None] + np.arange(size)[None, :]].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(row[at])),
                        pa.array(n[row[at]].astype(np.int32)),
                        pa.array(np.full(len(at), size, np.int32)),
                        pa.array(window[at].view(np.int64)),
                        pa.array((at - begin[:-1][row[at]]).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * size + 1, size, dtype=np.int32)), pa.array(values.ravel())),
                    ],
                    names=["id", "words", "size", "window", "at", "slots"],
                )


_SCHEMA = "id long, words int, size int, window long, at int, slots array<long>"


def leaks(docs: DataFrame, benchmark: DataFrame, min_coverage: float = 0.5, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, item_words, covered_words, coverage, slots, changed_slots, first_word: documents with a benchmark item.

    A row for each document and item of which at least ``min_coverage`` of the canonical words stand in matching
    windows of alignments whose slots correspond one to one; each word of the item counts once. Alignments count together
    where their slots agree with each other too, else the one that covers most stands alone. changed_slots: item
    values that have another value in the document. first_word: where the first match begins, in canonical words.
    What an item names counts as a name whatever its case, so copies in capitals or in lower case have the same template; other names
    are known by their capital, so a text in one case hides new ones, and an item all in capitals has none of its own.
    Null and empty texts match nothing, nor do items of fewer than LEAST_WORDS words; items of fewer than
    WINDOW words are one window. Rows that repeat a doc_id or an item_id count as one; rows without an id count as one
    of a null id; empty tables give an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")

    names = scratch.save(benchmark.select(F.col(text).alias("text")).mapInArrow(_names, "name long").distinct(), "names")
    known = spark.sparkContext.broadcast(bitmap(names, F.shiftrightunsigned("name", 64 - NAME_BITS), NAME_BITS))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _windows(batch, None, None, known.value)

    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(of_items, _SCHEMA)
    items = scratch.save(items.select(F.col("id").alias("item_id"), F.col("words").alias("item_words"), "size", "window", F.col("at").alias("item_at"), F.col("slots").alias("item_slots")).distinct(), "items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    wanted = spark.sparkContext.broadcast(bitmap(items, F.shiftrightunsigned("window", 64 - BITS), BITS))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _windows(batch, sizes, wanted.value, known.value)

    found = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(of_docs, _SCHEMA)
    found = found.select(F.col("id").alias("doc_id"), "window", "at", "slots")
    side = F.broadcast(items) if items.count() <= BROADCAST_WINDOWS else items
    met = found.join(side, "window").where(F.size("slots") == F.col("size"))
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda x: (x["a"] != 0) & (x["b"] != 0))
    own = F.sequence(F.col("item_at"), F.col("item_at") + F.col("size") - 1)
    # Windows of one alignment; copies of it elsewhere in the document add nothing but their place.
    aligned = met.groupBy("doc_id", "item_id", "item_words", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))).alias("pairs"),
        F.min("at").alias("first_word"),
    )
    aligned = aligned.where(_one_to_one("pairs")).groupBy("doc_id", "item_id", "item_words", "places", "pairs").agg(F.min("first_word").alias("first_word"))
    best = F.max(F.struct(F.size("places").alias("n"), -F.col("first_word"), "places", "pairs"))
    whole = aligned.groupBy("doc_id", "item_id", "item_words").agg(
        best.alias("best"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("all_places"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("all_pairs"),
        F.min("first_word").cast("long").alias("first_word"),
    )
    agree = _one_to_one("all_pairs")
    whole = whole.select("doc_id", "item_id", F.col("item_words").cast("long").alias("item_words"), F.when(agree, F.size("all_places")).otherwise(F.col("best.n")).cast("long").alias("covered_words"), F.when(agree, F.col("all_pairs")).otherwise(F.col("best.pairs")).alias("pairs"), "first_word")
    out = whole.withColumn("coverage", F.col("covered_words") / F.col("item_words")).where(F.col("coverage") >= min_coverage)
    return out.select("doc_id", "item_id", "item_words", "covered_words", "coverage", F.size("pairs").cast("long").alias("slots"), F.size(F.filter("pairs", lambda x: x["a"] != x["b"])).cast("long").alias("changed_slots"), "first_word")


def _one_to_one(pairs: str) -> Column:
    """Whether no value of either side has two partners; pairs: distinct (a, b)."""

    def values(side: str) -> Column:
        return F.size(F.array_distinct(F.transform(pairs, lambda x: x[side])))

    return (F.size(pairs) == values("a")) & (F.size(pairs) == values("b"))
