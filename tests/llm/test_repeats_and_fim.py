"""Removal of repeated passages, and fill-in-middle, each against a plain version; and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import fim, repeats

SCHEMA = "doc_id long, text string, k1 string, copy int, n string, runs string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA).repartition(parts)


def plainly(rows):
    """Of each row: words, removed words, kept text. Rows without an id are one document after all others."""
    words = [((1 << 63) - 1 if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for (i, w), (real, _) in zip(words, rows, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (i, s):
                gone[s : s + 20] = [True] * 20
        out.append((real, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


def test_cover_meets_every_pair():
    on = {c % repeats.PERIOD for c in repeats.COVER}
    assert all(any((i + k) % repeats.PERIOD in on and (j + k) % repeats.PERIOD in on for k in range(repeats.PERIOD)) for i in range(13) for j in range(13))
    assert repeats.ANCHOR + repeats.PERIOD - 1 == repeats.WINDOW


def test_passages_of_every_length_and_place(spark):
    r = random.Random(2)
    fresh = iter(range(10**6))
    new = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    rows = []
    for k in range(120):
        passage = new(r.choice([18, 19, 20, 21, 27, 60]))
        for d in range(r.choice([1, 2, 3])):
            rows.append((3 * k + d, " ".join(new(r.randrange(30)) + passage + new(r.randrange(30)) + (passage if r.random() < 0.2 else []))))
    rows += [(1000 + k, " ".join(r.choice("abc") for _ in range(r.randrange(15, 120)))) for k in range(60)]  # few words: chance repeats, overlaps
    rows += [(2000 + k, "\t".join(["la"] * r.randrange(18, 60))) for k in range(10)]
    r.shuffle(rows)
    assert found(repeats.remove_repeats(table(spark, rows))) == plainly(rows)


def test_odd_rows_of_repeats(spark):
    long = " ".join(f"v{k % 997}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "few words only"), (5, long), (9, long), (None, long), (None, None), (4, "few words only")]
    rows += [(7, " ".join(f"p{k}" for k in range(40)))] * 3 + [(8, " ".join(f"p{k}" for k in range(40)) + " end")]
    rows += [(8, " ".join(f"p{k}" for k in range(5, 40)))]  # another row of the same id: its place is earlier
    assert found(repeats.remove_repeats(table(spark, rows))) == plainly(rows)
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("room", [0, 64 << 20])
def test_joins_by_shuffle_and_by_broadcast(spark, monkeypatch, room):
    monkeypatch.setattr("barline.llm.sized.BROADCAST_BYTES", room)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(repeats.remove_repeats(docs)) == plainly(rows)
    assert {r.doc_id: r.back for r in fim.fill_in_middle(docs).select("doc_id", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()} == {i: t or "" for i, t in rows}


def test_elias_fano_lists():
    r = random.Random(1)
    for text in ["", "a", "plain", "ü" * 9, "\U0001f600" * 40, "".join(r.choice("abé中\U0001f600\n") for _ in range(3000))]:
        raw = np.frombuffer(text.encode(), np.uint8)
        values = fim.boundaries(raw)
        want = [len(text[:k].encode()) for k in range(len(text) + 1)]
        apart, high, low = fim.encode(values)
        read = fim.EliasFano(apart, high, low)
        assert values.tolist() == want and [read.select(k) for k in range(len(text) + 1)] == want
        assert 8 * (len(high) + len(low)) <= 4 * len(want) + 16
    sparse = np.array([0, 5, 700, 701, 100_000])
    read = fim.EliasFano(*fim.encode(sparse))
    assert [read.select(k) for k in range(5)] == sparse.tolist()


ODD = [(1, None), (2, ""), (3, "x"), (4, "has <S> inside"), (5, "<P>"), (6, "ü" * 30_000), (7, "a\U0001f600b\r\n\x00c"), (8, "< P> <"), (None, "no id"), (None, "no id"), (6, "ü" * 30_000), (10, "M><S<P" * 5)]


def cut(i, t, seed=1):
    t = t or ""
    n, digest = len(t), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, t, t)
    if h[3] % 100 < 20:
        return (i, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}", t)
    return (i, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", t)


@pytest.mark.parametrize("seed", [1, 5])
def test_cuts_and_round_trip(spark, seed):
    rows = ODD + [(100 + k, f"text é {k % 7} of many copies") for k in range(200)]
    out = fim.fill_in_middle(table(spark, rows), seed).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out) == Counter(cut(i, t, seed) for i, t in rows)
    assert {r.form for r in out} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_list_for_all_copies(spark):
    rows = [(k, f"text {k % 7}") for k in range(70)] + [(1, "text 1")]
    assert fim.text_index(table(spark, rows)).count() == 7


def test_lists_of_other_texts_are_not_used(spark, monkeypatch):
    """Two texts of equal hashes: the content tells them apart."""
    monkeypatch.setattr(fim, "text_keys", lambda text="text": [F.lit(1).cast("long").alias("k1"), F.lit(2).cast("long").alias("k2")])
    rows = [(k, "é" * k + "other text") for k in range(30)]
    out = fim.fill_in_middle(table(spark, rows)).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out) == Counter(cut(i, t) for i, t in rows)
