"""Words and word shingles of Arrow text columns, as numpy arrays of 64-bit hashes.

Work goes by slices of about a megabyte, so memory does not depend on the size of an Arrow batch,
and no text is cut: a document longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_FOLD = np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ASCII_SPACE = _SPACE

_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
CASED = _CODES
LOWERED = _CODES.copy()
LOWERED[0x41:0x5B] = _CODES[0x61:0x7B]

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about ``most`` bytes of text."""
    if not batch.num_rows:
        return
    at, _ = utf8(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def spans(offsets: np.ndarray, data: np.ndarray, space: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ``space``; runs end where a document ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~space[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, 2 * len(have)), _STEP if kind == "up" else _STEP_INVERSE, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.multiply.accumulate(step)
    return have[:n]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, by one running sum: equal spans have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # a piece of about a slice, so that the powers stay few for any length of text
        low = starts[first]
        last = max(int(np.searchsorted(ends, low + SLICE_BYTES, side="right")), first + 1)
        piece = data[low : ends[last - 1]]
        total = np.empty(len(piece) + 1, np.uint64)
        total[0] = 0
        np.cumsum(codes[piece] * _power("up", len(piece)), out=total[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (total[e] - total[s]) * _power("down", len(piece))[s] + (e - s).astype(np.uint64)
        first = last
    return mix(out)


def fold(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive words (not yet cut at documents)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m].copy()
    for k in range(1, n):
        out *= _FOLD
        out += words[k : k + m]
    return mix(out)


def word_hashes(column: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each document's words begin (one more entry than documents)."""
    offsets, data = utf8(column)
    starts, ends = spans(offsets, data)
    return hashes(data, starts, ends, codes), np.searchsorted(starts, offsets, side="left")


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its word shingles, lower-cased in A-Z.

    A document with fewer words than ``size`` has one shingle of all of them; one without words has none.
    """
    words, begin = word_hashes(column, LOWERED)
    runs = fold(words, size)
    out = []
    for low, high in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if high - low >= size:
            out.append(np.unique(runs[low : high - size + 1]))
        elif high > low:
            out.append(mix(fold(words[low:high], high - low) + np.uint64(high - low)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
