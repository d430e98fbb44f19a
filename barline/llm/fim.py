"""Fill-in-middle: every document is cut at two seeded places and its middle goes to the end.

Code points are found once for each distinct text, as an Elias-Fano list of the bytes where they begin (about two
bits each). Documents are joined to the list of their text and read their two cuts from it; the cutting itself is
slices of bytes in built-in functions. Copies of a text share one list however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.scratch import Scratch
from barline.llm.sized import bounded, text_keys
from barline.llm.textblocks import slices, utf8

# Marks of the three parts, and the shares of texts left whole and of those with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
SEED = 1

_BITS = np.array([bin(b).count("1") for b in range(256)], np.int64)


def boundaries(text: np.ndarray) -> np.ndarray:
    """Byte offsets where the code points of UTF-8 bytes begin, and the length of the whole."""
    return np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))


def encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Elias-Fano list of ascending values: bits kept apart, the high parts in unary, the low parts packed."""
    apart = max(int(values[-1]) // len(values), 1).bit_length() - 1
    high = np.zeros((int(values[-1]) >> apart) + len(values), bool)
    high[(values >> apart) + np.arange(len(values))] = True
    low = (values[:, None] >> np.arange(apart)[None, :]) & 1
    return apart, np.packbits(high, bitorder="little").tobytes(), np.packbits(low.astype(bool).ravel(), bitorder="little").tobytes()


class EliasFano:
    """Reads single values of an encoded list."""

    def __init__(self, apart: int, high: bytes, low: bytes):
        self.apart, self.high, self.low = apart, np.frombuffer(high, np.uint8), np.frombuffer(low, np.uint8)
        self.ones = np.cumsum(_BITS[self.high])

    def select(self, k: int) -> int:
        """The value of rank k, from 0."""
        at = int(np.searchsorted(self.ones, k, side="right"))
        rank = k - (int(self.ones[at - 1]) if at else 0)
        bit = int(np.flatnonzero(np.unpackbits(self.high[at : at + 1], bitorder="little"))[rank])
        low = sum(((int(self.low[(k * self.apart + b) >> 3]) >> ((k * self.apart + b) & 7)) & 1) << b for b in range(self.apart))
        return ((8 * at + bit - k) << self.apart) | low


_INDEX = "k1 long, k2 long, content string, n long, apart int, high binary, low binary"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            at, raw = utf8(part.column("text"))
            rows = []
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                values = boundaries(raw[low:high])
                rows.append((len(values) - 1, *encode(values)))
            n, apart, high_bits, low_bits = zip(*rows, strict=True)
            columns = [*(part.column(c) for c in ("k1", "k2", "content")), pa.array(n, pa.int64()), pa.array(apart, pa.int32()), pa.array(high_bits, pa.binary()), pa.array(low_bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "content", "n", "apart", "high", "low"])


def text_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2, content (hex SHA-256), n, apart, high, low: the boundary list of each distinct text, once.

    Texts are grouped by narrow hashes with partial counts, so copies of one text never meet in a task; the list is
    made from the row of smallest doc_id.
    """
    scratch = Scratch(docs.sparkSession, "fim-index")
    keyed = docs.select(*text_keys(text), F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first = scratch.save(keyed.groupBy("k1", "k2").agg(F.min("id").alias("first")), "first")
    one = keyed.alias("d").join(bounded(first, 24).alias("f"), (F.col("d.k1") == F.col("f.k1")) & (F.col("d.k2") == F.col("f.k2")) & F.col("id").eqNullSafe(F.col("first")), "left_semi")
    lists = one.select("k1", "k2", F.sha2("text", 256).alias("content"), "text").mapInArrow(_lists, _INDEX)
    return scratch.save(lists.dropDuplicates(["k1", "k2"]), "lists")  # rows that repeat a doc_id and its text


def seeds(doc_id: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of a SHA-256, as integers; a null doc_id counts as no digits."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


_CUTS = "id long, k1 long, k2 long, content string, n long, first long, second long, first_byte long, second_byte long"


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        found, held, read = [], None, None
        rows = zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "apart", "high", "low", "first", "second")), strict=True)
        for k1, k2, apart, high, low, first, second in rows:
            if held != (k1, k2):  # copies of a text come one after another
                held, read = (k1, k2), EliasFano(apart, high, low)
            found.append((read.select(first), read.select(second)))
        one, two = zip(*found, strict=True)
        columns = [*(batch.column(c) for c in ("id", "k1", "k2", "content", "n", "first", "second")), pa.array(one, pa.int64()), pa.array(two, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _CUTS.split(", ")])


def cuts(docs: DataFrame, index: DataFrame, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, k1, k2, content, n, first, second (code points), first_byte, second_byte of each different row."""
    own = docs.select(F.col(doc_id).cast("long").alias("id"), *text_keys(text)).distinct()
    h1, h2, _, _ = seeds(F.col("id"), seed)
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    joined = own.join(index, ["k1", "k2"]).withColumns({"first": F.least(a, b), "second": F.greatest(a, b)})
    return joined.mapInArrow(_select, _CUTS)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from."""

    def inner(one: str, two: str, then: list[int]) -> Column:
        parts = F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), f"{one}|{two}", 3)
        return F.concat(*[F.get(parts, F.lit(k)) for k in then])

    return F.when(form == "psm", inner(SUFFIX, MIDDLE, [0, 2, 1])).when(form == "spm", inner(PREFIX, MIDDLE, [1, 2, 0])).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars, output, content: a row for each row of docs.

    Cuts follow the seed and the doc_id alone, so equal texts of different ids are cut at different places. A text that is
    empty (or null), holds a mark, or falls into the plain share stays as it is, with null lengths. Rows of a null
    doc_id are seeded by the empty string; rows that repeat a doc_id and its text give equal rows; an empty
    table gives an empty result; other columns are not looked at. A text whose content is not that of its list (two texts of
    equal 128-bit hashes) is cut by counting its own code points.
    """
    scratch = Scratch(docs.sparkSession, "fim")
    found = scratch.save(cuts(docs, text_index(docs, doc_id, text), seed, doc_id, text), "cuts")
    k1, k2 = text_keys(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), k1.alias("d1"), k2.alias("d2"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2"))
    rows = rows.join(bounded(found, 160), same)
    h1, h2, h3, h4 = seeds(F.col("doc_id"), seed)
    whole, verified = F.col("text").cast("binary"), F.sha2("text", 256) == F.col("content")
    own = F.char_length("text").cast("long")
    rows = rows.withColumns({"verified": verified}).withColumns(
        {
            "n": F.when(F.col("verified"), F.col("n")).otherwise(own),
            "first": F.when(F.col("verified"), F.col("first")).otherwise(F.least(h1 % (own + 1), h2 % (own + 1))),
            "second": F.when(F.col("verified"), F.col("second")).otherwise(F.greatest(h1 % (own + 1), h2 % (own + 1))),
        }
    )

    def piece(first_byte: Column, last_byte: Column, first: Column, last: Column) -> Column:
        by_byte = F.substring(whole, (first_byte + 1).cast("int"), (last_byte - first_byte).cast("int"))
        return F.when(F.col("verified"), by_byte).otherwise(F.substring(F.col("text"), (first + 1).cast("int"), (last - first).cast("int")).cast("binary"))

    zero, end = F.lit(0).cast("long"), F.octet_length("text").cast("long")
    prefix = piece(zero, F.col("first_byte"), zero, F.col("first"))
    middle = piece(F.col("first_byte"), F.col("second_byte"), F.col("first"), F.col("second"))
    suffix = piece(F.col("second_byte"), end, F.col("second"), F.col("n"))
    mark = {m: F.lit(m).cast("binary") for m in (PREFIX, SUFFIX, MIDDLE)}
    marked = F.lit(False)
    for m in mark:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("n") == 0) | marked | (h3 % 100 >= 100 - PLAIN_PERCENT)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < SPM_PERCENT, "spm").otherwise("psm"))
    psm = F.concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)
    spm = F.concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)
    form = F.col("form")
    output = F.when(form == "psm", psm.cast("string")).when(form == "spm", spm.cast("string")).otherwise(F.col("text"))
    chars = {"prefix_chars": F.when(form != "plain", F.col("first")), "middle_chars": F.when(form != "plain", F.col("second") - F.col("first"))}
    return rows.withColumns(chars).select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"), "content")
