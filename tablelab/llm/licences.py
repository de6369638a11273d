"""Licence scan by a positional index of rare words, in DataFrame functions alone.

Templates are short licence notices with key phrases that must stand in them. Texts are read once: each keeps the
licence words that it has and, if it has all words of some template's key phrases, their places. Document
frequencies over the whole corpus give the words' weights (IDF). For each template a file may hold, its
``LOOKUPS`` words of highest IDF among the key phrases are looked up: every place of such a word, less the word's
places in the template (its postings), is a possible start, and the starts on which all looked-up words agree are
kept. At those starts the key phrases are verified word by word, and the IDF weight of all template words that
stand where they should is the place's share of the template. A place counts if all key phrases stand there and its
share is at least ``LEAST_SHARE``. As every place has all its looked-up words, the look-up loses none.

Words are runs of ASCII letters and digits and of any characters beyond ASCII, with A-Z alone lower-cased.

Defined cases: a null or empty text has no words and no label; ties of IDF go to the smaller word; repeated rows are
scanned one by one and each counts in the frequencies; ids may be null or repeat; an empty table gives an empty
result; a text of any length is scanned whole; columns beyond the named ones are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Words of a template that are looked up.
LOOKUPS = 2
#: Share of a template's weight that has to stand at a place.
LEAST_SHARE = 0.5
#: Words of all templates together. Their index is broadcast, so its size has a bound.
MOST_WORDS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def words_of(text: str) -> list[str]:
    return re.findall(f"[^{_OTHER}]+", text.translate(str.maketrans(_UPPER, _LOWER)))


@dataclass(frozen=True)
class Template:
    """A notice, the label of texts that hold it, and the phrases of it that must stand; by default all of it."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False

    def words(self) -> list[tuple[int, str, bool]]:
        """(place, word, whether a key phrase holds it)."""
        found = words_of(self.text)
        key = [not self.phrases] * len(found)
        for phrase in map(words_of, self.phrases):
            starts = [i for i in range(len(found)) if phrase and found[i : i + len(phrase)] == phrase]
            if not starts:
                raise ValueError(f"a key phrase of {self.label} does not stand in its template: {' '.join(phrase)!r}")
            key[starts[0] : starts[0] + len(phrase)] = [True] * len(phrase)
        return [(i, w, k) for i, (w, k) in enumerate(zip(found, key, strict=True))]


# Phrases of the base labels, and notices of common licences with their key phrases.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
TEMPLATES = (
    *BASE,
    Template("mit", "MIT License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction",
        ("permission is hereby granted free of charge",),
    ),
    Template("apache-2.0", "Apache License, Version 2.0"),
    Template("gpl-3.0", "General Public License, version 3"),
    Template("gpl-2.0", "General Public License, version 2"),
    Template("lgpl", "Lesser General Public License"),
    Template("cc-by-4.0", "CC BY 4.0"),
    Template("cc-by-sa-4.0", "CC BY-SA 4.0"),
    Template("cc-by-nc-4.0", "CC BY-NC 4.0"),
    Template("cc-by-nd-4.0", "CC BY-ND 4.0"),
    Template("mpl-2.0", "Mozilla Public License"),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("distribute this software for any purpose", "with or without fee"),
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("public-domain", "dedicated to the public domain"),
)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scanned(docs: DataFrame, keep: Sequence[str], text: str, templates: Sequence[Template]) -> DataFrame:
    """One row per text: a row number, n_words, the licence words it has, and their places where a template may stand."""
    vocabulary = sorted({w for t in templates for _, w, _ in t.words()})
    keys = [sorted({w for _, w, k in t.words() if k}) for t in templates]
    lower = lambda w: F.translate(w, _UPPER, _LOWER)

    def of(words: Column) -> Column:
        n = F.size(words)
        # Lower-casing that goes beyond A-Z is quick and finds more; what it finds is looked at again.
        places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.lower(F.get(words, i)).isin(vocabulary))
        hits = F.transform(F.when(n > 0, places).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("at"), lower(F.get(words, i)).alias("word")))
        return F.struct(n.cast("long").alias("n_words"), F.filter(hits, lambda h: h["word"].isin(vocabulary)).alias("hits"))

    def narrowed(found: Column) -> Column:
        present = F.array_sort(F.array_distinct(F.transform(found["hits"], lambda h: h["word"])))

        def with_present(here: Column) -> Column:
            fits = [F.size(F.array_except(F.lit(k), here)) == 0 for k in keys]
            possible = F.filter(F.array(*[F.when(f, F.lit(i)) for i, f in enumerate(fits)]), lambda i: i.isNotNull())
            return F.struct(found["n_words"].alias("n_words"), here.alias("present"), possible.alias("possible"),
                            F.when(F.size(possible) > 0, found["hits"]).alias("hits"))

        return _bound(present, with_present)

    # Cut at what is between words: extracting them copies the text for each.
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), f"[{_OTHER}]+", -1), lambda w: w != "")
    found = docs.select(*keep, _bound(_bound(words, of), narrowed).alias("_found"))
    return checkpointed(found.select(*keep, "_found.*", F.monotonically_increasing_id().alias("_row")))


def scan(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", templates: Sequence[Template] = TEMPLATES,
    lookups: int = LOOKUPS, least_share: float = LEAST_SHARE,
) -> tuple[DataFrame, DataFrame]:
    """(rows, places): ``keep`` columns and n_words of each row with its number ``_row``, and one row per place found.

    A place has ``_row``, ``template`` (its number), ``label``, ``base``, ``start`` (word, from 0) and ``share``.
    """
    spark = docs.sparkSession
    listed = [(t, at, w, key) for t, template in enumerate(templates) for at, w, key in template.words()]
    if len(listed) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} words")
    rows = _scanned(docs, keep, text, templates)
    # One row for each word of the templates at most.
    n = rows.count()
    holding = {r["word"]: r["n"] for r in rows.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    idf = {w: math.log((n + 1) / (holding.get(w, 0) + 1)) + 1 for _, _, w, _ in listed}
    rarest = [sorted({w for k, _, w, key in listed if k == t and key}, key=lambda w: (-idf[w], w))[:lookups] for t in range(len(templates))]
    postings = spark.createDataFrame(
        [(t, w, at, len(rarest[t])) for t, at, w, key in listed if key and w in rarest[t]], "template int, word string, posting int, wanted int"
    )
    likely = rows.filter(F.size("possible") > 0)
    # The places of the words that are looked up, template by template.
    sought = F.lit([w for w in sorted({w for ws in rarest for w in ws})])
    at = likely.select("_row", "possible", F.inline(F.filter("hits", lambda h: F.array_contains(sought, h["word"]))))
    starts = (
        at.join(F.broadcast(postings), "word")
        .filter(F.array_contains("possible", F.col("template")))
        .groupBy("_row", "template", (F.col("at") - F.col("posting")).alias("start"))
        .agg(F.count_distinct("word").alias("agreeing"), F.first("wanted").alias("wanted"))
        .filter("agreeing = wanted AND start >= 0")
        .select("_row", "template", "start")
    )
    index = spark.createDataFrame([(t, at_, w, key, idf[w]) for t, at_, w, key in listed], "template int, posting int, word string, key boolean, weight double")
    expected = starts.join(F.broadcast(index), "template").withColumn("at", F.col("start") + F.col("posting"))
    standing = likely.select("_row", F.inline("hits")).withColumn("stands", F.lit(True))
    checked = expected.join(standing, ["_row", "at", "word"], "left").groupBy("_row", "template", "start").agg(
        F.count_if(F.col("key") & F.col("stands").isNull()).alias("missing"),
        (F.sum(F.when(F.col("stands"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("share"),
    )
    labels = spark.createDataFrame([(t, x.label, x.base) for t, x in enumerate(templates)], "template int, label string, base boolean")
    places = checked.filter((F.col("missing") == 0) & (F.col("share") >= least_share)).join(F.broadcast(labels), "template")
    return rows.select(*keep, "n_words", "_row"), places.select("_row", "template", "label", "base", "start", "share")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document with the columns of the contract."""
    rows, places = scan(docs.select("doc_id", "text"), **options)
    base = F.col("base")
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = places.groupBy("_row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"), labels(F.when(base, F.col("label"))).alias("base_labels"),
        labels(F.col("label")).alias("labels"), F.round(F.max("share"), 6).alias("score"),
    )
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return rows.join(found, "_row", "left").na.fill(none).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
