"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends at a blank where the hash falls below a threshold, so the
cuts depend on the 32 bytes before them alone and an insertion moves no later cut. Chunks are about five words.
A chunk is a repeat if its digest stands earlier in the text or in a text of a smaller id. Runs of repeats of
``MIN_WORDS`` words or more (``MIN_OWN_WORDS`` for what stands in the same text alone) are cut out; single repeated
phrases stay.

Digests are counted with partial sums, and only repeated digests are joined back to the documents, so a passage
that a third of all texts share is no group of its own anywhere.

Words are counted at blanks of any script; of scripts without blanks (Chinese, Japanese, Thai, Lao, Khmer and
others) a chunk ends after any character with a chance of one in ten, and two characters count as a word. In other
texts without blanks a chunk ends where the hash is lower still, and 40 characters count as a word in a run's length.

Defined cases: a null text stays null, an empty one empty; rows of one id count as one document and are treated alike; rows of a null id are compared with themselves
alone; ``text`` is replaced in place, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .arrow import add_columns

#: A blank ends a chunk with this chance; any other character that begins one, with the second.
CHANCE, CHANCE_INSIDE = 1 / 5, 1 / 256
#: The same for characters of scripts written without blanks, of which two count as a word.
CHANCE_WIDE = 1 / 10
#: Characters that count as a word at least in the length of a run, so that long texts without blanks have runs too.
WORD_CHARS = 40
MIN_WORDS = 15
#: A text's own repeats are cut from longer runs on.
MIN_OWN_WORDS = 50
WINDOW = 32
#: One random number a byte value.
GEAR = (words.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

#: Blanks beyond ASCII in UTF-8.
_WIDE_BLANKS = [c.encode() for c in "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]

FIELDS = [
    ("n_chunks", T.LongType()), ("n_repeated", T.LongType()), ("starts", T.ArrayType(T.LongType())), ("ends", T.ArrayType(T.LongType())),
    ("words_removed", T.LongType()), ("text", T.StringType()),
]


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of blanks, last bytes of blanks, and last bytes of characters of scripts without blanks."""
    blank = _BLANK[data]
    blank_ends = blank.copy()
    wide = np.zeros(len(data), bool)
    lead = np.flatnonzero(data >= 0xC2)  # a character beyond ASCII begins
    a = data[lead].astype(np.int32)
    b, c = (data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) for k in (1, 2))
    for code in _WIDE_BLANKS:
        found = (a == code[0]) & (b == code[1])
        if len(code) == 3:
            found &= c == code[2]
        at = lead[found]
        for k in range(len(code)):
            blank[at + k] = True
        blank_ends[at + len(code) - 1] = True
    # Thai, Lao, Tibetan; Myanmar; Khmer; Chinese, Japanese and Yi, with their marks; rarer Chinese.
    three = (a == 0xE0) & (b >= 0xB8) | (a == 0xE1) & ((b <= 0x82) | (b == 0x9E) | (b == 0x9F)) | (a == 0xE2) & (b >= 0xBA) | (a >= 0xE3) & (a <= 0xE9)
    three |= (a == 0xEA) & (b <= 0x93) | (a == 0xEF) & ((b >= 0xA4) & (b <= 0xAB) | (b >= 0xBC) & (b <= 0xBE))
    wide[lead[three] + 2] = True
    wide[lead[(a == 0xF0) & (b >= 0xA0)] + 3] = True
    return blank, blank_ends, wide & ~blank


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, digest and number of words of each chunk, in the order of the texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n) + WINDOW * (row + 1)  # a gap before each text keeps the windows apart
    rolled = np.zeros(n + WINDOW * (len(lengths) + 1), np.uint32)
    rolled[place] = GEAR[data]
    step = 1
    while step < WINDOW:  # sums over windows of 2, 4, ... bytes, each byte shifted once more than its successor
        rolled[step:] += rolled[:-step] << np.uint32(step)
        step *= 2
    hashed = rolled[place]
    begins = np.ones(n, bool)  # where a character begins after the byte
    begins[:-1] = (data[1:] & 0xC0) != 0x80
    blank, blank_ends, wide = _characters(data)
    last = (blank_ends & (hashed < np.uint32(CHANCE * 2**32))) | (begins & (hashed < np.uint32(CHANCE_INSIDE * 2**32)))
    last |= wide & (hashed < np.uint32(CHANCE_WIDE * 2**32))
    last[offsets[1:][lengths > 0] - 1] = True
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * words._power_table(words._BASE, n), out=sums[1:])
    digests = words.mix((sums[ends] - sums[starts]) * words._power_table(words._INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    first = ~blank
    first[1:] &= blank[:-1] | (row[1:] != row[:-1])
    within = np.flatnonzero(wide)
    for back in (2, 3):  # characters that count by themselves begin no other word
        at = within[data[within - back] >= (0xE0 if back == 2 else 0xF0)]
        first[at - back] = False
    counts, wides = (np.concatenate([[0], np.cumsum(x)]) for x in (first, wide))
    return starts, ends, digests, counts[ends] - counts[starts] + (wides[ends] - wides[starts] + 1) // 2


def _sizes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each chunk for the length of a run: ``WORD_CHARS`` characters are one at least."""
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.maximum(counts, (characters[ends] - characters[starts]) // WORD_CHARS)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest): the distinct chunk digests of each row."""

    def make():
        def function(column: pa.Array):
            data, offsets = words.utf8(column)
            starts, _, found, _ = cut(data, offsets)
            row = np.searchsorted(offsets[1:], starts, "right")
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
            at = np.searchsorted(row[new], np.arange(len(column) + 1))
            return (pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found[new].view(np.int64))),)

        return function

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    return add_columns(rows, "text", ["id"], [("digests", T.ArrayType(T.LongType()))], make).select("id", F.explode("digests").alias("digest"))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, earlier, later): digests of a document that stand in documents of smaller ids, or only in later ones."""
    found = digests(docs, key, text)
    shared = found.groupBy("digest").agg(F.min("id").alias("owner"), F.max("id").alias("last")).filter("owner <> last").drop("last")
    hits = found.join(shared, "digest")
    return hits.groupBy("id").agg(
        F.collect_set(F.when(F.col("owner") < F.col("id"), F.col("digest"))).alias("earlier"),
        F.collect_set(F.when(F.col("owner") == F.col("id"), F.col("digest"))).alias("later"),
    )


def _runs(flags: np.ndarray, counts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First and last + 1 of the runs of set flags whose counts sum to ``least`` or more."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    sums = np.concatenate([[0], np.cumsum(counts)])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if sums[b] - sums[a] >= least]


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs that cover the same places."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, keep: Sequence[str] = (), key: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """Every row with its remaining text, the byte spans that were cut out, and counts of chunks and words.

    ``n_repeated`` counts the chunks in runs that stand in other texts too, the first text that has them included.
    """
    hits = repeated(docs, key, text)
    columns = [c for c in dict.fromkeys([key, *keep]) if c != text]
    # What is kept travels in one column, so that no name of it can clash with those made here.
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("_kept"), docs[key].alias("_key"), docs[text].alias("_text"))
    joined = rows.join(hits.select(F.col("id").alias("_id"), "earlier", "later"), F.col("_key") == F.col("_id"), "left")

    def make():
        def function(column: pa.Array, earlier: pa.Array, later: pa.Array):
            data, offsets = words.utf8(column)
            starts, ends, found, counts = cut(data, offsets)
            sizes = _sizes(data, starts, ends, counts)
            at = np.searchsorted(starts, offsets)
            raw, nulls = data.tobytes(), column.is_null().to_numpy(zero_copy_only=False)
            out: list[list] = [[] for _ in FIELDS]
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own, count, size = found[a:b], counts[a:b], sizes[a:b]
                before = np.array(earlier[i].as_py() or [], np.int64).view(np.uint64)
                after = np.array(later[i].as_py() or [], np.int64).view(np.uint64)
                again = np.ones(len(own), bool)
                again[np.unique(own, return_index=True)[1]] = False
                known = np.isin(own, before) if len(before) else np.zeros(len(own), bool)
                cuts = _joined(_runs(known, size, least) + _runs(known | again, size, max(least, MIN_OWN_WORDS)))
                shared = _runs(known | (np.isin(own, after) if len(after) else False), size, least)
                base = int(offsets[i])
                spans = [(int(starts[a + x]), int(ends[a + y - 1])) for x, y in cuts]
                parts, from_ = [], base
                for x, y in spans:
                    parts.append(raw[from_:x])
                    from_ = y
                parts.append(raw[from_ : int(offsets[i + 1])])
                values = (
                    b - a, sum(y - x for x, y in shared), [x - base for x, _ in spans], [y - base for _, y in spans],
                    int(sum(count[x:y].sum() for x, y in cuts)), None if nulls[i] else b"".join(parts).decode(),
                )
                for to, value in zip(out, values, strict=True):
                    to.append(value)
            return out

        return function

    made = add_columns(joined, "_text", ["_kept"], FIELDS, make, also=["earlier", "later"])
    return made.select(*[F.col("_kept")[c].alias(c) for c in columns], *[F.col(n).alias(n if n != "text" else text) for n, _ in FIELDS])


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, the spans that were cut out, and the remaining text."""
    return dedup(docs)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """Documents without repeated passages, with all their columns; those that are left without a word go.

    ``length``, where the table has it, is brought up to date.
    """
    columns = docs.columns
    others = [c for c in columns if c != text] or [key]
    inner = docs.select(docs[key].alias("_id"), docs[text].alias("_left"), F.struct(*[docs[c] for c in others]).alias("_others"))
    found = dedup(inner, ["_others"], "_id", "_left").filter((F.col("words_removed") == 0) | F.col("_left").rlike(r"\S"))
    now = {text: F.col("_left")}
    if length in columns:
        now[length] = F.length("_left").cast(docs.schema[length].dataType)
    return found.select(*[now.get(c, F.col("_others")[c]).alias(c) for c in columns])
