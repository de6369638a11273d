"""One pass for many keywords gives what a search for each gives."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tablelab.functions import keywords as kw
from tablelab.operators import labeling as lab


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcAB é") for _ in range(rng.randint(0, 300)))) for i in range(60)] + [(60, None), (61, "")]
    return spark.createDataFrame(rows, "id long, t string").cache()


WORDS = ["".join(w) for n in (1, 2, 3, 4) for w in itertools.product("abcé", repeat=n)] + ["Ab", "aB"]


def both(monkeypatch, make):
    """The result of the automaton, and of a search for each keyword."""
    fast = make()
    monkeypatch.setattr(lab, "FEW_KEYWORDS", 10**9)
    return fast, make()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("case_sensitive", [False, True])
@pytest.mark.parametrize("least", [1, 5, 40])
def test_labels(monkeypatch, texts, case_sensitive, least):
    assert len(WORDS) > 300
    labels = [lab.Label("first", tuple(WORDS[::2])), lab.Label("second", (*WORDS[1::2], "ab", "AB")), lab.Label("none"), lab.Label("never", ("zz",))]
    options = lab.MatchOptions(case_sensitive=case_sensitive, minimum_keyword_matches=least)
    fast, slow = both(monkeypatch, lambda: rows(lab.label_rows(texts, labels, ["t"], options)[0]))
    assert fast == slow


def test_counts(monkeypatch, texts):
    fast, slow = both(monkeypatch, lambda: rows(lab.keyword_counts(texts, F.col("t"), [*WORDS, "aa", "aba", "aaa"])))
    assert fast == slow and len(fast) == len({*WORDS, "aa", "aba", "aaa"})


def test_statistics(monkeypatch, texts):
    labels = [lab.Label("first", tuple(WORDS)), lab.Label("second", tuple(WORDS[:9])), lab.Label("off", ("a",), enabled=False)]
    fast, slow = both(monkeypatch, lambda: rows(lab.keyword_statistics(texts, F.lower("t"), labels)))
    assert fast == slow


def test_hits_of_odd_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("abab",)], "t string")
    assert [r[0] for r in df.select(kw.keyword_hits(F.col("t"), ["ab", "ba", "x"])).collect()] == [None, [], [0, 1]]
    found = df.select(kw.keyword_occurrences(F.col("t"), ["aba", "ab"])).collect()
    assert [None if r[0] is None else {x["k"]: x["n"] for x in r[0]} for r in found] == [None, {}, {0: 1, 1: 2}]
