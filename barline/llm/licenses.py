"""Licence scan by a positional index of rare words.

Each template of licence wording is indexed by its rarest words, rare by their document frequency in the
scanned corpus, with their positions in the template. A file's occurrences of those words each imply where
the template would begin; where the words of a template agree on that place, its mandatory key phrases are
verified there. No place is missed: it holds every rare word of the template at its own position.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words, base phrases, wordings of licences.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases of the text that must stand in their places; none: the whole text.
    mandatory: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def phrases(self) -> list[tuple[int, list[str]]]:
        """Offset in words and words of each mandatory phrase."""
        out = []
        for phrase in self.mandatory or (self.text,):
            want = phrase.split()
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(want)] == want)
            out.append((at, want))
        return out


TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license",)),
    Template("epl", "eclipse public license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge", "copy of this software"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "conditions are met"),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def words_of(text: Column) -> Column:
    """Runs of 0-9, a-z and characters beyond ASCII of a text lower-cased in A-Z; splitting is much faster than extracting."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS), "")


def idf(words: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of each word of the templates, over all rows of ``words`` (words array)."""
    known = sorted({w for t in templates for w in t.words})
    found = words.select(F.explode(F.array_intersect("words", _strings(known))).alias("word")).groupBy("word").count()
    n = words.count()
    df = {w: c for w, c in found.collect()}  # a row for each known word at most
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in known}


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def rare_words(template: Template, weight: dict[str, float], most: int = 2) -> list[tuple[str, int]]:
    """The words of highest IDF in the template's mandatory phrases and their positions there; they only occur once in them."""
    seats = [(w, at + k) for at, phrase in template.phrases() for k, w in enumerate(phrase)]
    ranked = sorted(seats, key=lambda s: (-weight[s[0]], s[1]))
    return list(dict(reversed(ranked)).items())[::-1][:most]


def _begins(word: str, at: int) -> Column:
    """Where a template would begin that has this word at this position."""
    return F.transform(F.filter("seats", lambda x: x["w"] == word), lambda x: x["i"] - at)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Null and empty texts, and texts without a word, have no words, no labels and score 0. The score is the
    largest IDF-weighted share of a template's words found in their places, over the verified places.
    Repeated rows are each scanned; other columns are not looked at; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words_of(F.col(text)).alias("words"))
    weight = idf(rows.select("words"), templates)
    rare = {t: rare_words(t, weight) for t in templates}
    first = sorted({r[0][0] for r in rare.values()})
    indexed = sorted({w for r in rare.values() for w, _ in r})
    seat = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(indexed))
    rows = rows.withColumn("seats", F.when(F.arrays_overlap("words", _strings(first)), seat))

    def places(t: Template) -> Column:
        """Where the template's rare words agree that it begins, and its mandatory phrases stand."""
        begins = [_begins(w, at) for w, at in rare[t]]
        agreed = begins[0] if len(begins) == 1 else F.array_intersect(*begins)

        def stands(s: Column) -> Column:
            ok = s >= 0
            for at, phrase in t.phrases():
                ok = ok & F.when(s >= 0, F.slice("words", F.greatest(s, F.lit(0)) + (at + 1), len(phrase)) == _strings(phrase)).otherwise(False)
            return ok

        return F.filter(F.array_distinct(agreed), stands)

    def share(t: Template, name: str) -> Column:
        """Of the best place."""
        total = reduce(add, (weight[w] for w in t.words), 0.0)  # in the order of the words, so that a whole template scores 1 exactly

        def held(s: Column) -> Column:
            return reduce(add, (F.when(F.get(F.col("words"), s + k) == w, F.lit(weight[w])).otherwise(0.0) for k, w in enumerate(t.words)), F.lit(0.0))

        return F.array_max(F.transform(F.col(name), lambda s: held(s) / F.lit(total)))

    names = {t: f"at{k}" for k, t in enumerate(templates)}
    found = rows.withColumns({names[t]: F.when(F.col("seats").isNotNull(), places(t)) for t in templates})

    def labels(some: list[Template]) -> Column:
        each = [F.when(F.size(F.coalesce(F.col(names[t]), F.array().cast("array<int>"))) > 0, F.lit(t.label)) for t in some]
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact(F.array(*each)))))

    base = [t for t in templates if t.base]
    all_base = F.coalesce(F.concat(*[F.col(names[t]) for t in base]), F.array().cast("array<int>"))
    found = found.withColumn("base_at", all_base)
    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("base_at").cast("long").alias("n_base"),
        F.array_min("base_at").cast("long").alias("first_word"),
        F.array_max("base_at").cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(list(templates)).alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), *[share(t, n) for t, n in names.items()])).alias("score"),
    )
