"""Many keywords in one pass over a text, by an automaton of all of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many keywords each is searched on its own, inside the JVM; beyond it the work would grow with their number.
FEW_KEYWORDS = 32


@cache
def _automaton(keywords: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, word in enumerate(keywords):
        made.add_word(word, (k, len(word)))
    made.make_automaton()
    return made


def _walk(keywords: tuple[str, ...], row: Callable[[str], object], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    def walk(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else row(t) for t in texts.to_pylist()], kind)

    return walk


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """Numbers of the keywords that a text holds, each once; null for a null text. No keyword is empty or repeated."""
    words = tuple(keywords)

    def row(t: str) -> list[int]:
        return sorted({k for _, (k, _) in _automaton(words).iter(t)})

    @F.arrow_udf("array<int>")
    def hits(texts: pa.Array) -> pa.Array:
        return _walk(words, row, pa.list_(pa.int32()))(texts)

    return hits(text)


def keyword_occurrences(text: Column, keywords: Sequence[str]) -> Column:
    """(keyword number, n) of the keywords that a text holds: occurrences from left to right that don't overlap."""
    words = tuple(keywords)
    kind = pa.list_(pa.struct([("k", pa.int32()), ("n", pa.int64())]))

    def row(t: str) -> list[dict]:
        free: dict[int, int] = {}  # where the next occurrence of a keyword may start
        n: dict[int, int] = {}
        for end, (k, length) in _automaton(words).iter(t):
            if end + 1 - length >= free.get(k, 0):
                free[k] = end + 1
                n[k] = n.get(k, 0) + 1
        return [{"k": k, "n": c} for k, c in n.items()]

    @F.arrow_udf("array<struct<k:int,n:bigint>>")
    def counts(texts: pa.Array) -> pa.Array:
        return _walk(words, row, kind)(texts)

    return counts(text)
