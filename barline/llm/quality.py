"""Quality rules: counts for each text, and a calibrated logistic regression on hashed word and character n-grams.

The model is fitted on at most ``per_class`` labelled rows of each class, those of smallest hash, so that it
does not grow with the input; the class shares it is calibrated to are counted over all labels. Whole texts
are scored in Arrow batches: a text's score is the mean weight of its n-grams, family by family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.textblocks import CASED, ASCII_SPACE, fold, hashes, mix, slices, spans, utf8

# Fixed values.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 3

BITS = 17
CHARACTERS = (3, 5)
FAMILIES = 2 + len(CHARACTERS)
#: A text is kept from this calibrated probability of good quality on.
THRESHOLD = 0.5

_KINDS = np.zeros(256, bool)
_KINDS[list(SYMBOLS)] = True


# ---- counts ---------------------------------------------------------------------------------------


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text, and its words for the n-grams."""
    offsets, data = utf8(column)
    starts, ends = spans(offsets, data)
    words = hashes(data, starts, ends, CASED)
    begin = np.searchsorted(starts, offsets, side="left")
    n_words = np.diff(begin)
    first_byte = (data & 0xC0) != 0x80  # a code point's first byte
    out = {
        "n_words": n_words,
        "word_chars": _per_row(first_byte & ~ASCII_SPACE[data], offsets),
        "n_symbols": _per_row(_KINDS[data], offsets),
        "n_dup_lines": np.zeros(len(n_words), np.int64),
        "n_repeat_words": np.zeros(len(n_words), np.int64),
    }
    for k, text in enumerate(column.to_pylist()):
        if text and "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
            out["n_dup_lines"][k] = len(lines) - len(set(lines))
    windows = fold(words, REPEAT_WINDOW)
    for k, (low, high) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        if high - low > REPEAT_WINDOW:
            own = windows[low : high - REPEAT_WINDOW + 1]
            order = np.argsort(own)
            same = own[order][1:] == own[order][:-1]
            if same.any():
                often = np.zeros(len(own), bool)
                often[order[1:][same]] = often[order[:-1][same]] = True
                covered = np.zeros(high - low, bool)
                for j in range(REPEAT_WINDOW):
                    covered[j : len(own) + j] |= often
                out["n_repeat_words"][k] = covered.sum()
    out["words"], out["begin"], out["offsets"], out["data"] = words, begin, offsets, data
    return out


# ---- n-grams --------------------------------------------------------------------------------------


def _features(c: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family: the hashed n-gram at each position, where each text's begin and where they end."""
    words, begin, offsets, data = c["words"], c["begin"], c["offsets"], c["data"]
    yield (mix(words + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int32), begin[:-1], begin[1:]
    pairs = (fold(words, 2) >> np.uint64(64 - BITS)).astype(np.int32)
    yield pairs, begin[:-1], np.maximum(begin[1:] - 1, begin[:-1])
    wide = data.astype(np.uint32) + np.uint32(1)
    for n in CHARACTERS:
        m = max(len(data) - n + 1, 0)
        value = np.full(m, n, np.uint32)
        for j in range(n):
            value *= np.uint32(0x01000193)
            value ^= wide[j : j + m]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        yield (value >> np.uint32(32 - BITS)).astype(np.int32), offsets[:-1], np.maximum(offsets[1:] - n + 1, offsets[:-1])


def _raw_scores(c: dict[str, np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Sum over families of the mean weight of a text's n-grams; weights: families by 2^BITS."""
    out = np.zeros(len(c["n_words"]))
    for w, (feature, low, high) in zip(weights, _features(c), strict=True):
        total = np.concatenate([[0.0], np.cumsum(w[feature], dtype=np.float64)])
        out += np.where(high > low, (total[np.minimum(high, len(feature))] - total[np.minimum(low, len(feature))]) / np.maximum(high - low, 1), 0.0)
    return out


# ---- the model ------------------------------------------------------------------------------------


class QualityModel:
    """weights (families by 2^BITS), and slope and shift of the calibrated logistic."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def probability(self, c: dict[str, np.ndarray]) -> np.ndarray:
        return _sigmoid(self.slope * (_raw_scores(c, self.weights) + self.bias) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def platt(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of the logistic of a score: Newton's steps on smoothed targets, halved until they help."""
    middle, width = score.mean(), score.std() + 1e-9
    x = (score - middle) / width
    high, low = (label * weight).sum(), ((1 - label) * weight).sum()
    target = np.where(label > 0, (high + 1) / (high + 2), 1 / (low + 2))

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 1e-4 * a * a)

    a, b = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * x + b)
        g, h = weight * (p - target), weight * p * (1 - p)
        grad = np.array([(g * x).sum() + 2e-4 * a, g.sum()])
        curve = np.array([[(h * x * x).sum() + 2e-4, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step, now = np.linalg.solve(curve, grad), loss(a, b)
        scale = 1.0
        while scale > 1e-6 and loss(a - scale * step[0], b - scale * step[1]) > now:
            scale /= 2
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(scale * step).max() < 1e-6:
            break
    a = max(a, 1e-3)
    return a / width, b - a * middle / width


def fit(texts: list[str], good: np.ndarray, share_good: float, rounds: int = 60) -> QualityModel:
    """Adam on all rows but a fifth; that fifth calibrates, weighted to the share of good rows in all labels."""
    c = counts(pa.array(texts, pa.string()))
    n = len(texts)
    index, value, row = [], [], []
    for f, (feature, low, high) in enumerate(_features(c)):
        for k in range(n):
            if high[k] > low[k]:
                own, many = np.unique(feature[low[k] : high[k]], return_counts=True)
                index.append((own + (f << BITS)).astype(np.int32))
                value.append((many / (high[k] - low[k])).astype(np.float32))
                row.append(np.full(len(own), k, np.int32))
    index, value, row = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((index, np.int32), (value, np.float32), (row, np.int32)))
    held = np.arange(n) % 5 == 4
    weight = np.where(good > 0, 0.5 / max(good[~held].sum(), 1), 0.5 / max((1 - good[~held]).sum(), 1)) * ~held
    w, bias = np.zeros(FAMILIES << BITS), 0.0
    first, second, mean_b, var_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[index] * value, minlength=n) + bias
        g = weight * (_sigmoid(z) - good)
        grad = np.bincount(index, weights=value * g[row], minlength=len(w)) * 100 + 1e-7 * w
        grad_b = g.sum()
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        mean_b += 0.1 * (grad_b - mean_b)
        var_b += 0.01 * (grad_b * grad_b - var_b)
        rate = 0.5 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= rate * first / (np.sqrt(second) + 1e-6)
        bias -= 0.05 * mean_b / (np.sqrt(var_b) + 1e-8)
    z = np.bincount(row, weights=w[index] * value, minlength=n) + bias
    both = held.any() and 0 < good[held].sum() < held.sum()
    on = held if both else np.ones(n, bool)
    share = np.where(good > 0, share_good / max(good[on].sum(), 1), (1 - share_good) / max((1 - good[on]).sum(), 1)) * on.sum()
    slope, shift = platt(z[on], good[on], share[on]) if n else (1.0, 0.0)
    return QualityModel(w.reshape(FAMILIES, -1), bias, slope, shift)


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = 1500, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> QualityModel:
    """A model of the labelled rows: up to per_class of each class, in the order of a hash of their ids.

    Labels that are null or that have no document are left out. Without labels the model says 0.5 and above.
    """
    rows = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).cast("int").alias("good")).where("good in (0, 1) and doc_id is not null")
    shares = {g: n for g, n in rows.groupBy("good").count().collect()}
    rank = F.xxhash64("doc_id")
    some = rows.where("good = 1").orderBy(rank, "doc_id").limit(per_class).unionByName(rows.where("good = 0").orderBy(rank, "doc_id").limit(per_class))
    sample = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id").orderBy(rank, "doc_id", "good").collect()  # 2 * per_class texts
    good = np.array([r.good for r in sample], np.float64)
    return fit([r.text or "" for r in sample], good, shares.get(1, 0) / max(sum(shares.values()), 1) if shares else 0.5)


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good of every row.

    Words are runs of characters other than ASCII white space; a null text is empty, and fails for its few
    words. Repeated rows are each scored; other columns are not looked at; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                c = counts(part.column("text"))
                p = m.probability(c)
                failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                own = [pa.array(c[k].astype(np.int64)) for k in names]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *own, pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], names=["doc_id", *names, "base_failed", "kept", "p_good"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean, p_good double")
