"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every window of 13 consecutive words of a benchmark item is a pattern. Texts and patterns are brought to the
same form (lower-case words, one blank around each), so a pattern occurs in a text exactly where its words do.
A table of block shifts skips positions where no pattern can end, buckets of suffix and prefix blocks select
the patterns that may stand at the others, and a direct comparison confirms them. The scan advances many
stretches of text at once in numpy.

Patterns are broadcast in blocks of at most ``max_windows`` (a size bound); a larger benchmark is searched
block after block over all rows.

Defined cases: a null or wordless text has no words, hits nothing and is not contaminated; a null or wordless
item has no window; an item of fewer than 13 words is one window; repeated rows are judged one by one; a window
that several items share counts for each of them; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .arrow import add_columns, stored

WINDOW = 13
BLOCK = 8
#: Rows (window, item) in one broadcast block; a window of 13 words is about 100 bytes.
MAX_WINDOWS = 200_000
#: Length of the stretches that are scanned side by side.
LANE = 1024

HITS = [
    ("n_words", T.LongType()),
    ("hit_starts", T.ArrayType(T.LongType())),
    ("hit_ends", T.ArrayType(T.LongType())),
    ("item_ids", T.ArrayType(T.StringType())),
]


def normalise(text: bytes) -> tuple[bytes, int]:
    """The words of a text with one blank around each, and their number."""
    parts = text.translate(words.TRANSLATE).split()
    return (b" " + b" ".join(parts) + b" " if parts else b""), len(parts)


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """Distinct (item_id, window) rows; ``window`` is the normalised bytes."""

    def make():
        def windows(column):
            out = []
            for value in column.to_pylist():
                parts = (value or "").encode().translate(words.TRANSLATE).split()
                starts = range(max(1, len(parts) - width + 1)) if parts else ()
                out.append(sorted({b" " + b" ".join(parts[i : i + width]) + b" " for i in starts}))
            return (out,)

        return windows

    found = add_columns(benchmark, text, [item], [("windows", T.ArrayType(T.BinaryType()))], make)
    return found.select(F.col(item).cast("string").alias("item_id"), F.explode("windows").alias("window")).distinct()


class WuManber:
    """Search tables over patterns of similar length.

    ``find`` returns (start position, pattern number) of every occurrence in a stream of bytes.
    """

    def __init__(self, patterns: Sequence[bytes]):
        self.patterns = list(patterns)
        self.least = min(map(len, self.patterns))
        self.block = min(BLOCK, self.least)
        self.bits = max(12, min(20, (len(self.patterns) * self.least * 4).bit_length()))
        self.shift = np.full(1 << self.bits, self.least - self.block + 1, np.int64)
        joined = np.frombuffer(b"".join(p[: self.least] for p in self.patterns), np.uint8).reshape(-1, self.least)
        for at in range(self.least - self.block + 1):
            value = self._blocks(joined[:, at : at + self.block])
            np.minimum.at(self.shift, self._slot(value), self.least - self.block - at)
        keys = self._key(self._blocks(joined[:, self.least - self.block :]), self._blocks(joined[:, : self.block]))
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def _blocks(self, rows: np.ndarray) -> np.ndarray:
        value = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            value |= rows[:, j].astype(np.uint64) << np.uint64(8 * j)
        return value

    def _slot(self, value: np.ndarray) -> np.ndarray:
        return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _key(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return words.mix(suffix) + prefix * np.uint64(0xD6E8FEB86659FD93)

    def find(self, stream: bytes) -> list[tuple[int, int]]:
        last = len(stream) - self.least  # of the positions where a pattern may start
        if last < 0:
            return []
        padded = stream + b"\0" * 8
        view = np.ndarray((len(stream) + 1,), "<u8", padded, strides=(1,))
        mask = np.uint64((1 << (8 * self.block)) - 1)
        at = np.arange(0, last + 1, LANE)
        stop = np.minimum(at + LANE - 1, last)
        tail = self.least - self.block
        found = []
        while len(at):
            value = view[at + tail] & mask
            shift = self.shift[self._slot(value)]
            zero = shift == 0
            if zero.any():
                here, suffix = at[zero], value[zero]
                key = self._key(suffix, view[here] & mask)
                left, right = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
                for k in np.flatnonzero(right > left):
                    start = int(here[k])
                    for number in self.order[left[k] : right[k]]:
                        if stream.startswith(self.patterns[number], start):
                            found.append((start, int(number)))
                shift = np.maximum(shift, 1)
            at = at + shift
            live = at <= stop
            at, stop = at[live], stop[live]
        return found


def searchers(windows: Sequence[bytes]) -> list[tuple[WuManber, list[int]]]:
    """Patterns by length class, as the shortest one limits the shifts of its class."""
    classes: dict[int, list[int]] = {}
    for number, window in enumerate(windows):
        classes.setdefault(len(window).bit_length() if len(window) < 32 else 6, []).append(number)
    return [(WuManber([windows[i] for i in numbers]), numbers) for _, numbers in sorted(classes.items())]


def _search(windows: list[bytes], items: list[list[str]]):
    """Function from texts to word counts, hit spans (word numbers, end exclusive) and item ids."""
    tables = searchers(windows) if windows else []
    lengths = [w.count(b" ") - 1 for w in windows]

    def search(column: pa.Array):
        data, offsets = words.utf8(column)
        raw, counts, parts, begins, at = data.tobytes(), [], [], [], 0
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            text, n = normalise(raw[a:b])
            counts.append(n)
            begins.append(at)
            parts.append(text)
            at += len(text) + 1
        stream = b"\n".join(parts)
        hits: list[tuple[int, int]] = []
        for table, numbers in tables:
            hits += [(start, numbers[k]) for start, k in table.find(stream)]
        spans: list[list[tuple[int, int]]] = [[] for _ in counts]
        named: list[set[str]] = [set() for _ in counts]
        if hits:
            blanks = np.flatnonzero(np.frombuffer(stream, np.uint8) == 32)
            starts = np.array([h[0] for h in hits])
            row = np.searchsorted(begins, starts, "right") - 1
            first = np.searchsorted(blanks, starts) - np.searchsorted(blanks, np.array(begins)[row])
            for r, w, (_, number) in zip(row.tolist(), first.tolist(), hits, strict=True):
                spans[r].append((w, w + lengths[number]))
                named[r].update(items[number])
        merged = [_merge(s) for s in spans]
        return counts, [[a for a, _ in s] for s in merged], [[b for _, b in s] for s in merged], [sorted(s) for s in named]

    return search


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_hits(
    docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WINDOW, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """``keep`` columns with n_words, hit spans in words (sorted, disjoint) and the sorted ids of the items found."""
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item, item_text, width)
    total = windows.count()
    n_blocks = max(1, math.ceil(total / max_windows))
    if n_blocks > 1:
        # Half-filled blocks on average, so that uneven hashing stays inside the bound.
        n_blocks *= 2
        windows = stored(windows, "windows")
    result = None
    for block in range(n_blocks):
        part = windows if n_blocks == 1 else windows.filter(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == block)
        by_window: dict[bytes, list[str]] = {}
        for row in part.collect():
            by_window.setdefault(bytes(row["window"]), []).append(row["item_id"] if row["item_id"] is not None else "")
        shared = spark.sparkContext.broadcast((list(by_window), list(by_window.values())))
        found = _scan(docs if result is None else result, shared, keep, text, first=result is None, last=block == n_blocks - 1)
        result = found if n_blocks == 1 else stored(found, "hits")
    return result


def _scan(df: DataFrame, shared, keep, text, first: bool, last: bool) -> DataFrame:
    names = [n for n, _ in HITS]
    if first:
        found = add_columns(df, text, list(dict.fromkeys([*keep, *([] if last else [text])])), HITS, lambda: _search(*shared.value))
        return found
    own = [n for n in dict.fromkeys([*keep, *([] if last else [text])])]
    more = [(f"_{n}", t) for n, t in HITS]
    found = add_columns(df, text, [*own, *names], more, lambda: _search(*shared.value))
    spans = F.array_sort(F.arrays_zip(F.concat("hit_starts", "_hit_starts").alias("a"), F.concat("hit_ends", "_hit_ends").alias("b")))
    span = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))
    top = lambda acc: F.element_at(acc, -1)
    merged = F.aggregate(
        spans,
        F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= x["a"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), span(top(acc)["a"], F.greatest(top(acc)["b"], x["b"]))),
        ).otherwise(F.concat(acc, span(x["a"], x["b"]))),
    )
    found = found.withColumn("_spans", merged)
    return found.select(
        *own, "n_words", F.col("_spans.a").alias("hit_starts"), F.col("_spans.b").alias("hit_ends"),
        F.array_sort(F.array_distinct(F.concat("item_ids", "_item_ids"))).alias("item_ids"),
    )


def n_hit() -> F.Column:
    total = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda s, x: s + x)
    return total("hit_ends") - total("hit_starts")


def contaminated() -> F.Column:
    """At least one hit, and a twentieth or more of the words are hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document with the digest columns of the contract."""
    found = find_hits(docs, benchmark, **options)
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that are not contaminated, with all their columns."""
    columns = docs.columns
    inner = docs.select(F.struct(*[docs[c] for c in columns]).alias("_row"), docs["text"].alias("text"))
    return find_hits(inner, benchmark, keep=["_row"], **options).filter(~contaminated()).select("_row.*")


def digest(items: Sequence[str]) -> str:
    """The items_sha256 of a list of item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
