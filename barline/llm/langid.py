"""Language of a text by cross-parsing: how few phrases of each language's sample it takes to spell the text.

A suffix automaton of the sample of a language recognises its substrings. Letters of any script are read in
lower case, digits as one, all else as spaces, and then as UTF-8 bytes, so that no letters fall together. A text is
read in blocks of ``BLOCK`` bytes; in each, the longest match from the present position is one phrase, and the next begins
where it ends. Phrases, normalised by the logarithm of the sample's length over the text's length, estimate
the cross entropy; the language with the least wins. All blocks of a batch step through the automaton
side by side, in numpy.

Samples are bounded: ``sample_bytes`` for each language, from up to ``sample_docs`` labelled rows. A language's table has a
row for each state, at most two for each byte of its sample, and a column for each byte that occurs: about 6 MB
for a Latin script and 16 MB for a large one. All tables together stay under ``MODEL_BYTES``: with more languages
(200, say) than that holds, each sample gets shorter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.llm.textblocks import slices

BLOCK = 256
#: Of all tables together; 4 bytes a cell.
MODEL_BYTES = 256 << 20
#: A row of the sample is rather no longer than this, so that a sample holds several texts.
RATHER_BYTES = 4096
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_PHRASE = np.int32(-(1 << 31))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the states; state 0 is the start, and every path from it spells a substring."""
    follow: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for s in symbols:
        new = len(follow)
        follow.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in follow[p]:
            follow[p][s] = new
            p = link[p]
        if p >= 0:
            q = follow[p][s]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(follow)
                follow.append(dict(follow[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(s) == q:
                    follow[p][s] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return follow


def _read_table() -> np.ndarray:
    """Code points as they are read: letters in lower case, digits as one, all else as a space; beyond the last letters all is a space."""
    out = np.full(0x33480, 0x20, np.uint32)
    for p in range(len(out)):
        c = chr(p).lower()[0]
        if c.isdigit():
            out[p] = ord("0")
        elif c.isalpha():
            out[p] = ord(c)
    return out


_READ = _read_table()


def points(text: str) -> np.ndarray:
    """Code points of a text as they are read."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _READ[np.minimum(raw, len(_READ) - 1)]


def read(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts as they are read, runs of spaces as one, and the length of each text in them."""
    length = np.array([len(t) for t in texts], np.int64)
    whole = points("".join(texts))
    row = np.repeat(np.arange(len(texts)), length)
    keep = whole != 0x20
    keep[1:] |= (whole[:-1] != 0x20) | (row[1:] != row[:-1])
    keep[:1] = True
    whole, row = whole[keep], row[keep]
    wide = 1 + (whole >= 0x80).astype(np.int64) + (whole >= 0x800) + (whole >= 0x10000)
    data = np.frombuffer(whole.tobytes().decode("utf-32-le").encode(), np.uint8)
    return data, np.bincount(row, weights=wide, minlength=len(texts)).astype(np.int64)


class LanguageModel:
    """Tables of one automaton for each language, over the bytes that its sample holds."""

    def __init__(self, samples: dict[str, str], sample_bytes: int = 16384):
        self.languages = sorted(samples)
        self.tables, self.classes, self.scale, self.width = [], [], [], []
        for language in self.languages:
            data = read([samples[language]])[0]
            found = np.unique(data)
            width = len(found) + 2  # class 0: past a text's end; 1: a byte that the sample lacks
            data = data[: min(sample_bytes, MODEL_BYTES // (8 * width * len(samples)))]
            classes = np.ones(256, np.int32)
            classes[found] = np.arange(2, width)
            self.classes.append(classes)
            self.width.append(width)
            self.tables.append(self._table(suffix_automaton(classes[data].tolist()), width))
            self.scale.append(np.log2(max(len(data), 2)))

    @staticmethod
    def _table(follow: list[dict[int, int]], width: int) -> np.ndarray:
        """Next state times width for state * width + class; where a match breaks off, a new phrase's state with the sign bit."""
        table = np.full((len(follow), width), -1, np.int32)
        for state, edges in enumerate(follow):
            for symbol, to in edges.items():
                table[state, symbol] = to * width
        fresh = np.where(table[0] >= 0, table[0], 0)
        broken = table < 0
        table[broken] = (np.broadcast_to(fresh, table.shape) | _PHRASE)[broken]
        table[0] = fresh | _PHRASE  # at the start each byte begins a phrase
        table[:, 0] = 0
        return table.ravel()

    def entropy(self, texts: list[str]) -> np.ndarray:
        """Normalised phrases, texts by languages."""
        whole, length = read(texts)
        blocks = -(-length // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        grid = np.zeros((first[-1], BLOCK), np.uint8)  # byte 0 is no letter: it stands past a text's end
        start = np.concatenate([[0], np.cumsum(length)])
        grid.ravel()[np.arange(len(whole)) + np.repeat(first[:-1] * BLOCK - start[:-1], length)] = whole
        grid = np.ascontiguousarray(grid.T)
        out = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(blocks)
        for k, (table, classes, scale) in enumerate(zip(self.tables, self.classes, self.scale, strict=True)):
            classes = classes.copy()
            classes[0] = 0
            state = np.zeros(first[-1], np.int32)
            phrases = np.zeros(first[-1], np.int32)
            for symbols in grid:
                state = table[state + classes[symbols]]
                phrases -= state >> 31
                state &= 0x7FFFFFFF
            if len(full):
                out[full, k] = np.add.reduceat(phrases, first[:-1][full]) * scale / length[full]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (how far the second language lies behind, 0 to 1) of each text."""
        spelled = [t if t is not None and _LETTER.search(t) else None for t in texts]
        known = [k for k, t in enumerate(spelled) if t is not None]
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known and self.languages:
            h = self.entropy([spelled[k] for k in known])
            best = h.argmin(axis=1)
            if h.shape[1] > 1:
                two = np.partition(h, 1, axis=1)[:, :2]
                score[known] = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-12)
            else:
                score[known] = 1.0
            for k, b in zip(known, best.tolist(), strict=True):
                names[k] = self.languages[b]
        return names, np.clip(score, 0, 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """A third of the rows, by the CRC-32 of the id's text, from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, sample_bytes: int = 16384, sample_docs: int = 64, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model of rows that are not held out and have a text and a language.

    For each language, the row of smallest hash in each of sample_docs cells of another hash, texts of up to RATHER_BYTES
    first; whole texts in that order until sample_bytes are reached, of which the last may be longer.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.withColumn("rank", F.struct((F.octet_length("text") > RATHER_BYTES).alias("long"), F.xxhash64("doc_id").alias("hash"), F.xxhash64("text").alias("key"), F.octet_length("text").alias("size")))
    chosen = rows.groupBy("lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(sample_docs)).alias("cell")).agg(F.min("rank").alias("rank"))
    before = F.coalesce(F.sum("rank.size").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = chosen.withColumn("before", before).where(F.col("before") < sample_bytes).select("lang", "rank")
    # As many rows as languages times sample_docs at most: a model holds all languages anyway.
    taken = rows.join(F.broadcast(chosen), ["lang", "rank"]).select("lang", "rank", "text").distinct().collect()
    samples: dict[str, str] = {}
    for r in sorted(taken, key=lambda r: (r.lang, tuple(r["rank"]), r.text)):
        samples[r.lang] = samples.get(r.lang, "") + r.text + " "
    return LanguageModel({k: v for k, v in samples.items() if v.strip()}, sample_bytes)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Null texts and texts without a letter are ``und`` with score 0. Of equal languages the first by name wins,
    with score 0. Repeated rows each have a result; other columns are not looked at; an empty table gives an
    empty result; without anything to learn from, all is ``und``.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                names, score = m.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
