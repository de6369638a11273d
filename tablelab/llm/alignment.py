"""Alignment of the tokens that two tokenizers make of the same text.

Both tokenizers see the text after one blank, and each token has a range of its bytes. Per batch, two
``pandas.merge_asof`` joins, keyed by document and byte in one number, let the start of each token find the token of the other side that
covers it; the union of both directions is the set of overlapping tokens. Tokens of an overlap that end at the same
byte are linked, and the links cut a text into groups: the tokens of both sides between two common ends.

Corpus-wide counts of linked id pairs come from the stored links. Pairs that hold at least one in ``HOT`` links are
at most ``HOT`` in number and are looked up in the tasks; the links of all others go through a join by pair.

Defined cases: a text that is null or empty, or whose tokens of either side don't spell the blank and the text (as
where a text holds the mark that one vocabulary writes for a blank), has no tokens: all its counts are 0 and the
written form of its groups is empty. Strings of special tokens are plain text. Repeated rows are aligned one by one
and count one by one; ids may be null or repeat; an empty table gives an empty result; other columns are not read.
A text of any length is aligned whole, in a step of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from .arrow import add_columns, small_batches
from .packing import _PRINTED

#: Pairs that are looked up in the tasks hold at least one in so many links each, so there are at most so many.
HOT = 1 << 19
#: Distinct pieces whose tokens a Python worker remembers, from task to task.
CACHE = 500_000
#: A single blank between two of these characters: no token of either side reaches across it.
_CUT = re.compile(r"(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
#: A blank that is not such a cut.
_OTHER_BLANK = re.compile(r"(?:^|[^!-~À-ɏ]) | (?:[^!-~À-ɏ]|$)").search
#: What the byte-level pre-tokenizer cuts texts of these characters into: letters, digits, signs, single line feeds.
_PART = r"[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n(?!\n)"
_PARTS, _PLAIN = re.compile(_PART).findall, re.compile(rf"(?!\n)(?:{_PART})+").fullmatch
_BLANK_MARK = "▁"

LINKS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
OVERLAPS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- the two tokenizers ---------------------------------------------------------------------------------------


class ByteLevel:
    """Ids of a byte-level vocabulary, and the bytes of each id."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        # The alphabet: printable bytes as they are, the others as the characters from 256 on, in order.
        others = (b for b in range(256) if b not in _PRINTED)
        self.written = {b: chr(256 + i) for i, b in enumerate(others)}
        byte_of = {chr(b): b for b in _PRINTED} | {c: b for b, c in self.written.items()}
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.parts: dict[str, list[int]] = {}
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes[i] = entry.encode() if entry in added else bytes(map(byte_of.__getitem__, entry))
        #: Blanks start a piece of their own in the pre-tokenizer, so a cut before a single one changes nothing.
        self.cuts = json.loads(self.tokenizer.to_str())["pre_tokenizer"].get("use_regex", False)

    def __call__(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids of each text after a blank."""
        if len(self.parts) > CACHE // 4:
            self.parts.clear()
        out: list = [None] * len(texts)
        rest = []
        for k, text in enumerate(texts):
            if self.cuts and _PLAIN(text):
                first, *more = _PARTS(text)
                out[k] = self._part(" " + first)
                for part in more:
                    out[k] = out[k] + self._part(part)
            else:
                rest.append(k)
        if rest:
            for k, made in zip(rest, self.tokenizer.encode_batch_fast([" " + texts[k] for k in rest], add_special_tokens=False), strict=True):
                out[k] = made.ids
        return out

    def _part(self, part: str) -> list[int]:
        """Ids of a part that the pre-tokenizer would cut out, so that the merges are all that is left to do."""
        ids = self.parts.get(part)
        if ids is None:
            if part.isascii():  # letters, digits and signs are written as they are
                written = part.replace(" ", self.written[32]).replace("\n", self.written[10])
            else:
                written = part.encode().decode("latin-1").translate(self.written)
            ids = self.parts[part] = [t.id for t in self.tokenizer.model.tokenize(written)]
        return ids


class Pieces:
    """Ids of a piece vocabulary, which puts a blank before the text itself, and the bytes of each id."""

    def __init__(self, file: str):
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=file)
        pieces = [self.tokenizer.id_to_piece(i) for i in range(self.tokenizer.get_piece_size())]
        self.bytes = [
            bytes([int(p[1:-1], 16)]) if self.tokenizer.is_byte(i) else p.replace(_BLANK_MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        #: No entry goes on after a blank that follows something else, so no merge reaches across a single blank.
        self.cuts = not any(_BLANK_MARK in p.lstrip(_BLANK_MARK) for p in pieces)

    def __call__(self, texts: Sequence[str]) -> list[list[int]]:
        return self.tokenizer.encode(list(texts), num_threads=1)


class _Store:
    """Ids of numbered pieces, end to end in one array that grows."""

    def __init__(self):
        self.ids, self.ends, self.pieces = np.zeros(1 << 16, "<i4"), np.zeros(1 << 12, np.int64), 0

    def add(self, ids: Sequence[int], counts: Sequence[int]) -> None:
        used = int(self.ends[self.pieces])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.pieces + len(counts) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used : used + len(ids)] = ids
        self.ends[self.pieces + 1 : self.pieces + 1 + len(counts)] = used + np.cumsum(counts)
        self.pieces += len(counts)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered pieces, one after the other, and their offsets."""
        starts = self.ends[numbers]
        offsets = np.concatenate([[0], np.cumsum(self.ends[numbers + 1] - starts)])
        at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], np.diff(offsets))
        return self.ids[at], offsets


class Both:
    """Ids of texts on both sides. Texts are cut at single blanks and the pieces' ids remembered."""

    def __init__(self, file_a: str, file_b: str):
        self.sides = ByteLevel(file_a), Pieces(file_b)
        self.cuts = all(s.cuts for s in self.sides)
        self.lengths = [np.array([len(b) for b in s.bytes], np.int64) for s in self.sides]
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.stores = _Store(), _Store()
        self.odd: set[int] = set()  # pieces that one side does not spell

    def __call__(self, texts: Sequence[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts and the texts' offsets; texts without tokens have no ids."""
        split = [self._split(t) if t else [] for t in texts]
        pieces = np.concatenate([[0], np.cumsum([len(x) for x in split], dtype=np.int64)])
        coded = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        missing = [p for p in distinct if p not in self.number]
        if len(self.number) + len(missing) > CACHE:
            self._forget()
            missing = distinct
        self._learn(missing)
        numbers = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        made = [store.of(numbers) for store in self.stores]
        out = [(ids, offsets[pieces]) for ids, offsets in made]
        if self.odd:
            hit = np.isin(numbers, np.fromiter(self.odd, np.int64, len(self.odd)))
            for k in np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(hit)])[pieces])):
                whole = (" " + texts[k]).encode()
                if any(_spelt(side, ids[o[k] : o[k + 1]].tolist()) != whole for side, (ids, o) in zip(self.sides, out, strict=True)):
                    out = [(np.delete(ids, np.s_[o[k] : o[k + 1]]), np.where(np.arange(len(o)) > k, o - (o[k + 1] - o[k]), o)) for ids, o in out]
        return out

    def _split(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return _CUT.split(text) if _OTHER_BLANK(text) else text.split(" ")

    def _learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 4000):
            part = pieces[i : i + 4000]
            first = len(self.number)
            self.number.update(zip(part, range(first, first + len(part)), strict=True))
            made = [side(part) for side in self.sides]
            text = "".join([" " + p for p in part]).encode()
            for store, ids in zip(self.stores, made, strict=True):
                store.add(list(chain.from_iterable(ids)), [len(x) for x in ids])
            if any(_spelt(side, chain.from_iterable(ids)) != text for side, ids in zip(self.sides, made, strict=True)):
                for k, piece in enumerate(part):
                    if any(_spelt(side, ids[k]) != (" " + piece).encode() for side, ids in zip(self.sides, made, strict=True)):
                        self.odd.add(first + k)


@cache
def _remembered(file_a: str, file_b: str) -> Both:
    """One pair of tokenizers a worker process, so that its next task finds the pieces of the last."""
    return Both(file_a, file_b)


def _spelt(side, ids: Iterable[int]) -> bytes:
    return b"".join(map(side.bytes.__getitem__, ids))


# --- alignment of a batch -------------------------------------------------------------------------------------


def overlapping(starts_a: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (a, b) of all overlapping tokens of a batch, by a, then b.

    Starts count from the start of the batch, so each document has a range of its own and the starts carry the key
    by document; the first token of a document starts at the same byte on both sides.
    """
    a = pd.DataFrame({"start": starts_a, "a": np.arange(len(starts_a))})
    b = pd.DataFrame({"start": starts_b, "b": np.arange(len(starts_b))})
    covered = pd.merge_asof(a, b, on="start")  # the b token that covers each a token's start
    covering = pd.merge_asof(b, a, on="start")
    # Tokens that start together are found both ways.
    by_b = covering["a"].to_numpy().astype(np.int64)
    fresh = starts_a[by_b] != starts_b
    both_a = np.concatenate([covered["a"].to_numpy(), by_b[fresh]])
    both_b = np.concatenate([covered["b"].to_numpy(), covering["b"].to_numpy()[fresh]]).astype(np.int64)
    order = np.argsort(both_a * (len(starts_b) + 1) + both_b, kind="stable")
    return both_a[order], both_b[order]


def _digits(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids as bytes, each with the byte in ``after`` behind it (0: nothing), and the offsets of the ids."""
    highest = int(ids.max(initial=0))
    width = len(str(highest))
    numbers = np.arange(highest + 1)
    signs = 1 + (numbers[:, None] >= 10 ** np.arange(1, max(width, 2))).sum(axis=1)
    # Digits from the left, then zeros.
    powers = 10 ** np.maximum(signs[:, None] - 1 - np.arange(width + 1), 0)
    table = (48 + numbers[:, None] // powers % 10).astype(np.uint8)
    n = signs[ids]
    cells = table[ids]
    cells[np.arange(len(ids)), n] = after
    n += after != 0
    return cells[np.arange(width + 1) < n[:, None]], np.concatenate([[0], np.cumsum(n)])


def _written(ids: list[np.ndarray], ends: list[np.ndarray], offsets: list[np.ndarray]) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each row: the ids of its groups. ``ends`` are the last tokens of the groups."""
    group = [np.searchsorted(e, np.arange(len(i))) for e, i in zip(ends, ids, strict=True)]
    # Tokens before a token: those of its own side, and of the other side those of the groups before (for b: up to) its own.
    firsts = [np.concatenate([[0], e + 1]) for e in ends]
    at_a = np.arange(len(ids[0])) + firsts[1][group[0]]
    at_b = np.arange(len(ids[1])) + firsts[0][group[1] + 1]
    all_ids = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
    after = np.full(len(all_ids), ord(","), np.uint8)
    all_ids[at_a], all_ids[at_b] = ids[0], ids[1]
    after[at_a[ends[0]]], after[at_b[ends[1]]] = ord("|"), ord(";")
    row_ends = offsets[0][1:] + offsets[1][1:]
    some = np.diff(offsets[0]) > 0
    after[row_ends[some] - 1] = 0
    data, places = _digits(all_ids, after)
    data = data.tobytes()
    cuts = places[np.concatenate([[0], row_ends])].tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def _lists(offsets: np.ndarray, fields: Sequence[np.ndarray], kind: pa.DataType) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(f, kind) for f in fields], ["a", "b"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


#: Links as they are stored between steps: the ids of their pairs, little-endian.
PACKED = np.dtype("<u4")

#: What ``align`` can return of a row.
OUTPUTS = {
    "n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_overlaps": T.LongType(), "links": LINKS,
    "overlaps": OVERLAPS, "groups": T.StringType(), "groups_sha256": T.StringType(), "packed_links": T.BinaryType(),
}


def _align(both: Both, texts: list[str | None], outputs: Sequence[str]) -> list:
    ids, offsets, starts, ends = [], [], [], []
    for (flat, places), lengths in zip(both(texts), both.lengths, strict=True):
        sizes = lengths[flat]
        end = np.cumsum(sizes)
        ids.append(flat)
        offsets.append(places)
        ends.append(end)
        starts.append(end - sizes)
    over_a, over_b = overlapping(*starts)
    linked = ends[0][over_a] == ends[1][over_b]
    link_a, link_b = over_a[linked], over_b[linked]
    # Both orders agree, as ends grow from token to token.
    link_offsets = np.searchsorted(link_a, offsets[0])
    out = []
    texts_of = _written(ids, [link_a, link_b], offsets) if {"groups", "groups_sha256"} & set(outputs) else None
    for name in outputs:
        if name in ("n_a", "n_b"):
            out.append(np.diff(offsets[name == "n_b"]))
        elif name == "n_groups":
            out.append(np.diff(link_offsets))
        elif name == "n_overlaps":
            out.append(np.diff(np.searchsorted(over_a, offsets[0])))
        elif name == "links":
            out.append(_lists(link_offsets, [ids[0][link_a], ids[1][link_b]], pa.int32()))
        elif name == "overlaps":
            of_row = np.searchsorted(over_a, offsets[0])
            row = np.searchsorted(offsets[0], over_a, side="right") - 1
            out.append(_lists(of_row, [over_a - offsets[0][row], over_b - offsets[1][row]], pa.int64()))
        elif name == "packed_links":
            pairs = np.stack([ids[0][link_a], ids[1][link_b]], axis=1).astype(PACKED).tobytes()
            cuts = (link_offsets * 2 * PACKED.itemsize).tolist()
            out.append([pairs[x:y] for x, y in zip(cuts, cuts[1:])])
        elif name == "groups":
            out.append([t.decode() for t in texts_of])
        else:
            out.append([hashlib.sha256(t).hexdigest() if t else "" for t in texts_of])
    return out


def align(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", files: tuple[str, str] | None = None,
    outputs: Sequence[str] = ("n_a", "n_b", "n_groups", "links", "overlaps", "groups"),
) -> DataFrame:
    """``keep`` columns of each row and the ``outputs`` of its alignment.

    ``links`` are the id pairs of tokens that end together, ``overlaps`` the numbers (from 0) of overlapping
    tokens, ``groups`` the ids of all groups in writing (``groups_sha256`` its digest).
    """
    file_a, file_b = files or default_tokenizers()

    def make() -> Callable:
        both = _remembered(file_a, file_b)
        return lambda column: _align(both, column.to_pylist(), outputs)

    return add_columns(docs, text, list(keep), [(n, OUTPUTS[n]) for n in outputs], make)


# --- counts over the corpus -----------------------------------------------------------------------------------


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed links of a batch as pairs (a id in the upper half), and the offsets of its rows."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in column], np.int64)
    data = np.frombuffer(b"".join(column.drop_null().to_pylist()), PACKED).astype(np.int64)
    return data[0::2] << 32 | data[1::2], np.concatenate([[0], np.cumsum(sizes // (2 * PACKED.itemsize))])


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): links that hold each id pair, and whether no pair of its b id has more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(_pairs(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    counts = small_batches(links.select("packed_links")).mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts.withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1)))
    # One row for each entry of the smaller vocabulary at most.
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_figures(rows: DataFrame, keep: Sequence[str], hot: int = HOT) -> DataFrame:
    """``keep`` columns of each row of ``packed_links``, and its n_links, n_best and count_sum. Rows may be equal."""
    spark = rows.sparkSession
    rows = checkpointed(rows.select(*keep, "packed_links", F.monotonically_increasing_id().alias("_row")))
    counts = checkpointed(pair_counts(rows))
    total = counts.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n").cast("double") * hot >= float(total)
    table = counts.filter(is_hot).toArrow()
    found = [table.column(c).to_numpy() for c in ("pair", "n", "best")]
    order = np.argsort(found[0])
    shared = spark.sparkContext.broadcast([x[order] for x in found])
    schema = T.StructType([
        T.StructField("_row", T.LongType()), T.StructField("n_links", T.LongType()), T.StructField("n_best", T.LongType()),
        T.StructField("count_sum", T.LongType()), T.StructField("rest", T.ArrayType(T.LongType())),
    ])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        totals = lambda values, at: np.diff(np.concatenate([[0], np.cumsum(values)])[at])
        for batch in batches:
            pair, places = _pairs(batch.column("packed_links"))
            known, n, good = np.zeros(len(pair), bool), np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
            if len(pairs):
                value, inverse = np.unique(pair, return_inverse=True)  # few of the links are different
                at = np.minimum(np.searchsorted(pairs, value), len(pairs) - 1)
                hit = pairs[at] == value
                known, n, good = hit[inverse], np.where(hit, counts[at], 0)[inverse], (hit & best[at])[inverse]
            rest_places = np.concatenate([[0], np.cumsum(~known)])[places]
            rest = pa.ListArray.from_arrays(pa.array(rest_places, pa.int32()), pa.array(pair[~known], pa.int64()))
            yield pa.RecordBatch.from_arrays([
                batch.column("_row"), pa.array(np.diff(places), pa.int64()), pa.array(totals(good, places), pa.int64()),
                pa.array(totals(n, places), pa.int64()), rest,
            ], schema.names)

    first = checkpointed(small_batches(rows.select("_row", "packed_links")).mapInArrow(look_up, schema))
    rest = first.filter(F.size("rest") > 0).select("_row", F.explode("rest").alias("pair")).groupBy("_row", "pair").agg(F.count("*").alias("times"))
    rest = rest.join(counts.filter(~is_hot), "pair").groupBy("_row").agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    sums = first.drop("rest").join(rest, "_row", "left").select(
        "_row", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )
    return rows.select(*keep, "_row").join(sums, "_row").drop("_row")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document with the columns of the contract."""
    made = ["n_a", "n_b", "n_groups", "groups_sha256"]
    rows = align(docs, ["doc_id"], outputs=[*made, "packed_links"], **options)
    return link_figures(rows, ["doc_id", *made]).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
