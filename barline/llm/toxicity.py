"""Toxicity by subword embeddings averaged into a linear softmax, trained jointly in numpy.

The bag of a word is its character n-grams of 3 and of 5 to 8 bytes, with its ends marked, so a misspelling or an
inflected form shares most vectors with the word it comes from. The vectors of a bag are averaged and go
into the softmax; a text scores as its most toxic word does, so that a long text cannot hide one.
Labels are known for texts only: the first fit takes as toxic the words that several toxic texts hold and
hardly any clean one; then the model itself finds more of them in toxic texts, and is fitted again.

All that the fit needs of the texts is how many toxic and clean ones hold each word. Spark counts that over at most
``toxic`` and ``clean`` labelled rows, those of smallest hash; a tenth of them only calibrate the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.quality import platt
from barline.llm.scratch import Scratch
from barline.llm.textblocks import slices, spans, utf8

BITS = 17
DIMENSIONS = 2
GRAMS = (3, 5, 6, 7, 8)
SPACE = 0x20
#: Scores are calibrated to this share of toxic texts: rather many, as a missed one costs more than a clean one.
PRIOR = 0.15
#: Step of the embeddings, and the share of the largest gradient that damps it.
RATE, DAMP = 6.0, 0.1
#: Logit from which a word of a toxic text counts as toxic in a refit, as the first ones always do; and the texts
#: that must hold a first one, and the share of toxic texts among them.
SURE, SEED_TEXTS, SEED_SHARE = 2.0, 5, 0.9
#: Words that the fit takes at most, those of most texts; a word of one text only tells nothing.
MOST_WORDS = 200_000

# Bytes as they are read, A-Z as a-z, digits and signs as the letters they often stand for.
_READ = np.arange(256, dtype=np.uint8)
_READ[:0x30] = _READ[0x3A:0x40] = _READ[0x5B:0x61] = _READ[0x7B:0x80] = SPACE
_READ[0x41:0x5B] = np.arange(0x61, 0x7B)
for _from, _to in zip(b"013457@$", b"oieastas", strict=True):
    _READ[_from] = _to


def read_words(column: pa.Array) -> dict[str, np.ndarray]:
    """text (all texts as they are read, a space before each and one at the end), starts and ends of words, begin (first word of each text)."""
    offsets, data = utf8(column)
    n = len(offsets) - 1
    text = np.full(len(data) + n + 1, SPACE, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _READ[data]
    starts, ends = spans(np.array([0, len(text)]), text)
    return {"text": text, "starts": starts, "ends": ends, "begin": np.searchsorted(starts, offsets + np.arange(n + 1), side="left")}


def subwords(column: pa.Array) -> dict[str, np.ndarray]:
    """read_words with grams (buckets of the n-grams) and word (of each gram)."""
    out = read_words(column)
    text = out["text"]
    blanks = np.concatenate([[0], np.cumsum(text == SPACE)])
    at, grams = [], []
    wide = text.astype(np.uint32) + np.uint32(1)
    for g in GRAMS:
        m = len(text) - g + 1
        if m <= 0:
            continue
        whole = np.flatnonzero(blanks[g - 1 : g - 1 + m] == blanks[1 : 1 + m])  # no space inside; one may stand at either end
        value = np.full(len(whole), g, np.uint32)
        for j in range(g):
            value *= np.uint32(0x01000193)
            value ^= wide[whole + j]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        at.append(whole + 1)
        grams.append((value >> np.uint32(32 - BITS)).astype(np.int32))
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    grams = np.concatenate(grams) if grams else np.zeros(0, np.int32)
    return out | {"grams": grams, "word": np.searchsorted(out["starts"], at, side="right") - 1}


class ToxicityModel:
    """bucket: how far each n-gram moves the difference of the two logits; the averaging and the softmax are linear in it."""

    def __init__(self, embeddings: np.ndarray, output: np.ndarray, bias: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.bucket = (embeddings @ (output[:, 1] - output[:, 0])).astype(np.float32)
        self.bias, self.slope, self.shift = float(bias[1] - bias[0]), slope, shift

    def word_logits(self, grams: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(word, weights=self.bucket[grams], minlength=n) / np.maximum(np.bincount(word, minlength=n), 1) + self.bias

    def logits(self, c: dict[str, np.ndarray]) -> np.ndarray:
        """Of the most toxic word of each text; of no words, the bias."""
        return _largest(self.word_logits(c["grams"], c["word"], len(c["starts"])), c["begin"], self.bias)

    def probability(self, c: dict[str, np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(c) + self.shift, -50, 50)))


def _largest(z: np.ndarray, begin: np.ndarray, empty: float) -> np.ndarray:
    out = np.full(len(begin) - 1, empty)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        out[full] = np.maximum.reduceat(z, begin[:-1][full])
    return out


def _train(gram: np.ndarray, bag: np.ndarray, size: np.ndarray, toxic: np.ndarray, clean: np.ndarray, rounds: int, start: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joint Adam steps on embeddings and softmax. Bags are distinct words, with their weight as toxic and as clean."""
    if start is None:
        rng = np.random.default_rng(7)
        start = (np.zeros((1 << BITS, DIMENSIONS)), rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2))
    e, u, b = (x.copy() for x in start)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (e, u, b)]
    target = np.stack([clean, toxic], axis=1)
    weight = target.sum(axis=1, keepdims=True)

    def add(values: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        return np.stack([np.bincount(at, weights=values[:, d], minlength=length) for d in range(DIMENSIONS)], axis=1)

    for t in range(1, rounds + 1):
        hidden = add(e[gram], bag, len(size)) / size[:, None]
        z = hidden @ u + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = weight * p - target
        back = (g @ u.T) / size[:, None]
        grads = (add(back[bag], gram, 1 << BITS) + 1e-8 * e, hidden.T @ g, g.sum(axis=0))
        for x, grad, (first, second), rate, damp in zip((e, u, b), grads, moments, (RATE, 0.1, 0.1), (DAMP, 0.0, 0.0), strict=True):
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            size_of = np.sqrt(second)
            # Damped by the largest gradient: what few words hold moves little, and is not learned by heart.
            x -= rate * (1 - (t - 1) / rounds) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * first / (size_of + damp * size_of.max() + 1e-12)
    return e, u, b


def fit(words: list[str], in_toxic: np.ndarray, in_clean: np.ndarray, rounds: int = 40, refits: int = 2) -> ToxicityModel | None:
    """A model, not yet calibrated, from the numbers of toxic and of clean texts that hold each word; None without both."""
    if not len(words) or not in_toxic.sum() or not in_clean.sum():
        return None
    own = subwords(pa.array([" ".join(words)]))  # each distinct word once
    gram, bag = own["grams"], own["word"]
    size = np.maximum(np.bincount(bag, minlength=len(words)), 1)
    # At first those words count as toxic that several toxic texts hold and hardly any clean one does.
    seed = (in_toxic >= SEED_TEXTS) & (in_toxic >= SEED_SHARE * (in_toxic + in_clean))
    label = seed if seed.any() else in_toxic > in_clean
    model = None
    for _ in range(refits):
        pos, neg = np.where(label, in_toxic, 0.0), in_clean + np.where(label, 0.0, in_toxic)
        model = _train(gram, bag, size, pos * (0.5 / max(pos.sum(), 1)), neg * (0.5 / max(neg.sum(), 1)), rounds, model)
        label = (ToxicityModel(*model).word_logits(gram, bag, len(words)) > SURE) | seed
    return ToxicityModel(*model)


def calibrate(model: ToxicityModel, z: np.ndarray, toxic: np.ndarray, share: float = PRIOR) -> ToxicityModel:
    """Slope and shift of the scores from the logits of texts left out of the fit, for this share of toxic texts."""
    if 0 < toxic.sum() < len(toxic):
        weight = np.where(toxic > 0, share / toxic.sum(), (1 - share) / (1 - toxic).sum()) * len(toxic)
        model.slope, model.shift = platt(z, toxic.astype(np.float64), weight)
    return model


def same_for_all(share: float = PRIOR) -> ToxicityModel:
    """Without labels of both classes every text has one score."""
    return ToxicityModel(np.zeros((1 << BITS, DIMENSIONS)), np.zeros((DIMENSIONS, 2)), np.zeros(2), 1.0, float(np.log(share / (1 - share))))


def held_out(doc_id: str = "doc_id"):
    """A fifth of the rows, by the CRC-32 of the id's text, from whose labels nothing is learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, toxic: int = 2000, clean: int = 6000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """A model of labelled rows that are not held out: so many of each class at most, in the order of a hash of their ids.

    Labels that are null or that have no document are left out. Without labels of both classes every text gets one score.
    The driver receives words with their counts, and a logit for each text of the tenth that calibrates; no text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    rank = F.xxhash64("doc_id")
    some = rows.where("toxic = 1").orderBy(rank, "doc_id").limit(toxic).unionByName(rows.where("toxic = 0").orderBy(rank, "doc_id").limit(clean))
    sample = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id")  # toxic + clean rows
    sample = scratch.save(sample.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit("tenth")), F.lit(10)) == 0), "sample")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 17):
                c = read_words(part.column("text"))
                raw, begin = c["text"].tobytes(), c["begin"]
                each = [raw[s:e].decode() for s, e in zip(c["starts"].tolist(), c["ends"].tolist(), strict=True)]
                own = [sorted(set(each[a:b])) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(own, pa.list_(pa.string()))], names=["toxic", "words"])

    held = sample.where("not calibrates").select("toxic", "text").mapInArrow(words_of, "toxic int, words array<string>")
    counts = held.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("in_toxic"), F.sum(1 - F.col("toxic")).alias("in_clean"))
    counts = counts.where("in_toxic + in_clean > 1").orderBy(F.desc(F.col("in_toxic") + F.col("in_clean")), "word").limit(MOST_WORDS).collect()
    model = fit([r.word for r in counts], np.array([r.in_toxic for r in counts], np.float64), np.array([r.in_clean for r in counts], np.float64))
    if model is None:
        return same_for_all()
    model_ = spark.sparkContext.broadcast(model)

    def logit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 17):
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(model_.value.logits(subwords(part.column("text"))))], names=["toxic", "logit"])

    found = sample.where("calibrates").select("toxic", "text").mapInArrow(logit, "toxic int, logit double").orderBy("logit", "toxic").collect()
    scratch.drop("sample")
    return calibrate(model, np.array([r.logit for r in found]), np.array([r.toxic for r in found], np.int64))


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score of 0.5 and above) of every row.

    Null and empty texts score as a text without words. Repeated rows are each scored; a null doc_id is not
    held out; other columns are not looked at; an empty table gives an empty result.
    """
    model_ = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 17):
                p = m.probability(subwords(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
