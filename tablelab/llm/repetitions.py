"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least
``max(least, 2 * q)`` words that no neighbouring word extends. Its words occur at least twice in it, so a word that
occurs once in a segment belongs to no run there and splits it; segments under ``least`` words hold no run. Splitting
goes on until no segment changes. What survives is scanned by lags: short lags are compared word by word, longer ones
only where a block of words recurs at that lag, which every run of such a period has, and each find is extended to
both sides.

A lag's block has a quarter to half its words, so a text of n words has at most 2 n finds per doubling of the lag;
finds inside a known run of a period under the block's length are repeats of that run and are dropped. Work is
n log n words, however long a text is and however often it repeats itself.

Defined cases: a null text counts as empty; a text under ``least`` words has no run; words are runs of bytes other
than blank, tab, line feed, vertical tab, form feed and carriage return; rows may be equal, ids null; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .arrow import add_columns

#: Words of the shortest run.
LEAST = 12
#: Words are made of all bytes but these.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
BLANKS = r"[\x20\x09-\x0D]+"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def word_numbers(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts (a binary array), the number of each word among them, and the rows' word offsets."""
    data, offsets = words.utf8(column)
    inside = ~_BLANK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[inside])])
    coded = found.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(starts, offsets)


def surviving(numbers: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that splitting leaves, and the segment of each (segments and places ascending)."""
    places = np.arange(len(numbers))
    segment = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    many = int(numbers.max(initial=0)) + 1
    while True:
        sizes = np.bincount(segment) if len(segment) else np.zeros(0, np.int64)
        keep = sizes[segment] >= least
        places, segment = places[keep], segment[keep]
        _, which, counts = np.unique(segment * many + numbers[places], return_inverse=True, return_counts=True)
        # Any run holds two periods at least, so a word of it occurs twice in it.
        frequent = counts[which] >= 2
        if frequent.all():
            return places, segment
        places, before = places[frequent], segment[frequent]
        new = np.ones(len(places), bool)
        new[1:] = (np.diff(places) != 1) | (np.diff(before) != 0)
        segment = np.cumsum(new) - 1


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the powers of its base."""
    powers = np.full(len(values) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(words.mix(values.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    return sums, powers


def _reach(same, far: np.ndarray) -> np.ndarray:
    """The largest x up to ``far`` for which ``same(x)`` holds; it holds at 0 and up to a limit of each."""
    low, high = np.zeros(len(far), np.int64), far.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        good = same(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def lag_scan(values: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs among ``values``, by start, then period."""
    n = len(values)
    runs = [np.zeros(0, np.int64)] * 3

    def known(starts: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
        """Whether a run of a period up to ``longest`` holds the whole stretch."""
        use = runs[2] <= longest
        if not use.any():
            return np.zeros(len(starts), bool)
        order = np.argsort(runs[0][use], kind="stable")
        at, upto = runs[0][use][order], np.maximum.accumulate((runs[0] + runs[1])[use][order])
        k = np.searchsorted(at, starts, side="right") - 1
        return (k >= 0) & (upto[np.maximum(k, 0)] >= ends)

    def add(starts: np.ndarray, lengths: np.ndarray, lags: np.ndarray) -> None:
        """Add stretches that are runs. A stretch that has a smaller period too is the same stretch at that period."""
        long = lengths >= np.maximum(least, 2 * lags)
        joined = [np.concatenate([r, x[long]]) for r, x in zip(runs, (starts, lengths, lags), strict=True)]
        order = np.lexsort((joined[2], joined[1], joined[0]))
        joined = [x[order] for x in joined]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(joined[0]) != 0) | (np.diff(joined[1]) != 0)
        runs[:] = [x[new] for x in joined]

    half = least // 2
    for lag in range(1, min(half, n)):
        same = np.concatenate([[False], values[lag:] == values[:-lag], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        starts, ends = edges[::2], edges[1::2]
        add(starts, ends - starts + lag, np.full(len(starts), lag))

    # Lags from ``size`` up to twice it: a run matches itself at its lag for ``size`` words at least, which holds one
    # of the blocks of half as many words that start at multiples of their length.
    size = half
    sums, powers = _prefix(values)
    while size <= n // 2:
        block = size // 2
        grams = (sums[block:] - sums[:-block]) * powers[::-1][: n - block + 1]  # shifted to a common power
        order = np.lexsort((np.arange(len(grams)), grams))
        _, group = np.unique(grams, return_inverse=True)
        keys = group[order] * (n + 1) + order
        anchors = np.arange(0, n - block + 1, block)
        first = np.searchsorted(keys, group[anchors] * (n + 1) + np.minimum(anchors + size, n))
        last = np.searchsorted(keys, group[anchors] * (n + 1) + np.minimum(anchors + 2 * size, n))
        found = last - first
        at = np.repeat(anchors, found)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(found) - found, found)
        lags = order[np.repeat(first, found) + nth] - at
        fresh = ~known(at, at + lags + block, block)
        at, lags = at[fresh], lags[fresh]
        if len(at):
            equal = lambda i, j, m: (sums[i + m] - sums[i]) * powers[j - i] == sums[j + m] - sums[j]
            right = _reach(lambda m, i=at, j=at + lags: equal(i, j, m), n - at - lags)
            left = _reach(lambda m, i=at, j=at + lags: equal(i - m, j - m, m), at)
            add(at - left, left + right + lags, lags)
        size *= 2
    order = np.lexsort((runs[2], runs[0]))
    return tuple(r[order] for r in runs)


def runs_of(numbers: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (in the whole of ``numbers``), lengths and periods of the runs of all rows, by start, then period."""
    places, segment = surviving(numbers, offsets, least)
    if not len(places):
        return (np.zeros(0, np.int64),) * 3
    # Segments end to end, a value of its own after each, so that no stretch reaches across.
    gaps = np.concatenate([[0], np.cumsum(np.diff(segment) != 0)])
    values = -1 - np.arange(len(places) + gaps[-1] + 1)
    at = np.arange(len(places)) + gaps
    values[at] = numbers[places]
    values -= values.min()
    starts, lengths, periods = lag_scan(values, least)
    origin = np.zeros(len(values), np.int64)
    origin[at] = places
    return origin[starts], lengths, periods


def _collapsed(distinct: pa.Array, numbers: np.ndarray, offsets: np.ndarray, runs: Sequence[np.ndarray]) -> pa.Array:
    """Texts of the words that no run repeats, joined by one blank."""
    starts, lengths, periods = runs
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    keep = np.cumsum(change[:-1]) == 0
    kept = distinct.cast(pa.string()).take(pa.array(numbers[keep]))
    places = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(places, pa.int32()), kept), " ")


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def find_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", least: int = LEAST) -> DataFrame:
    """``keep`` columns, n_words, the ``runs`` of each text by start, then period, and the ``collapsed`` text.

    The collapsed text is the words that no run holds after its first period, joined by one blank.
    """

    def function(column: pa.Array) -> tuple:
        distinct, numbers, offsets = word_numbers(column)
        runs = runs_of(numbers, offsets, least)
        row_of = np.searchsorted(offsets, runs[0], side="right") - 1
        values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (runs[0] - offsets[row_of], *runs[1:])], RUN.names)
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row_of, np.arange(len(offsets))), pa.int32()), values)
        return np.diff(offsets), lists, _collapsed(distinct, numbers, offsets, runs)

    fields = [("n_words", T.LongType()), ("runs", T.ArrayType(RUN)), ("collapsed", T.StringType())]
    return add_columns(docs, text, list(keep), fields, lambda: function)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) in which the hash of the id has a tenth of the texts repeat a stretch from some word on.

    With h the CRC of the decimal id and g = h div 10: if h mod 10 is 0, word i from a = g mod n on is word
    a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8). Texts of null ids stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def altered(found: Column) -> Column:
        n = F.size(found).cast("long")
        g = F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        take = lambda i: F.get(found, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), take), " ")).otherwise(F.lit(""))

    bound = F.transform(F.array(F.filter(F.split("text", BLANKS, -1), lambda w: w != "")), altered)
    return docs.select("doc_id", F.when(h % 10 == 0, F.get(bound, F.lit(0))).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document with the columns of the contract."""
    found = find_runs(with_planted_runs(docs), least=least)
    # The longest run; of equal ones the first, then that of the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in RUN.names]))
    rows = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), lines.alias("_lines"), "collapsed")
    length, period = F.col("_best.length"), -F.col("_best.period")
    return rows.select(
        "doc_id", "n_runs", (-F.col("_best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join("_lines", "\n"), F.when(F.size("_lines") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
