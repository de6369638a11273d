"""Packing of tokenised documents along a space-filling curve.

A document's words are hashed into a vector that is projected to a few dimensions; the cell of the projection on
a Hilbert curve is its sort key. Documents are range-partitioned by the key, ordered inside a partition, and
laid end to end into sequences, so that neighbours on the curve share a sequence. A document is cut where a
sequence is full, so only the last sequence of a partition is short: it is cut into lengths that are powers of
two, which need no padding.

Ties on the curve (copies) are spread by a hash of the document key, so one hot text fills many partitions.

The bounds of the ranges are placed by a hash sample of about ``BOUND_ROWS`` rows a partition; every row is placed
by them, so a sample that is off makes ranges uneven and loses nothing.

Defined cases: a null or empty text has the end token alone; repeated rows are packed one by one; an empty table
gives an empty result; a text of any length is cut into as many pieces as it needs; columns beyond the named ones
are not read.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .arrow import add_columns, small_batches

SEQUENCE = 2048
END_TOKEN = 1
DIMENSIONS, BITS = 3, 10
#: Distinct pieces whose tokens a Python worker remembers, from task to task; the rest is tokenised anew.
CACHE = 400_000
#: Rows of a partition that place its bounds.
BOUND_ROWS = 500
_STOP = re.compile(r"(?<=[a-zA-Zà-öø-ÿ])([.,])(?=\s|\Z)")
#: Sequence numbers of one range start at range * RANGE_SEQUENCES.
RANGE_SEQUENCES = 1 << 40
#: Byte-level vocabularies write bytes that are not printable as the characters from 256 on, in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class CachedTokenizer:
    """Token ids of texts, piece by piece.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its blank-separated
    pieces in order, and common pieces are looked up. A stop or comma between a letter and white space is a token
    of its own, and the tokenizer lower-cases, so both are evened out before the look-up.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {"": b""}

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        split = [self._pieces(t) for t in texts if t]
        cache = self.cache
        missing = set().union(*split).difference(cache)
        full = len(cache) + len(missing) > CACHE
        self._learn(missing)
        made = iter([b"".join(map(cache.__getitem__, pieces)) for pieces in split])
        if full:
            for piece in missing:
                del cache[piece]
        return [next(made) if t else b"" for t in texts]

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        return _STOP.sub(r" \1", text).replace("\n", " ").split(" ")

    def _learn(self, pieces: set[str]) -> None:
        rest, cache, tokenize, kind = [], self.cache, self.model.tokenize, self.dtype.char
        for piece in pieces:
            # Letters up to Latin Extended-A: lower-casing is all that the tokenizer does to them before its merges.
            if piece.isalpha() and max(piece) < "\u0180" and "\u0130" not in piece:
                low = piece.lower()
                written = low if low.isascii() else low.encode().decode("latin-1").translate(_BYTE_LETTERS)
                cache[piece] = array(kind, [t.id for t in tokenize(written)]).tobytes()
            else:
                rest.append(piece)
        for i in range(0, len(rest), 4000):
            part = rest[i : i + 4000]
            for piece, made in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                cache[piece] = array(kind, made.ids).tobytes()


@cache
def _remembered(file: str) -> CachedTokenizer:
    """One tokenizer a worker process, so that its next task finds the pieces of the last."""
    return CachedTokenizer(file)


def project(column: pa.Array, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Cells (row, dimension) of the projected word vectors of texts."""
    hashes, _, _, word_offsets = words.word_hashes(*words.utf8(column))
    counts = np.diff(word_offsets)
    cells = np.zeros((len(counts), dimensions), np.int64)
    for j in range(dimensions):
        signs = ((hashes >> np.uint64(7 * j + 3)) & np.uint64(1)).astype(np.int64) * 2 - 1
        sums = np.concatenate([[0], np.cumsum(signs)])[word_offsets]
        value = np.diff(sums) / np.sqrt(np.maximum(counts, 1))
        cells[:, j] = np.clip((0.5 + 0.5 * np.tanh(value / 4)) * (1 << bits), 0, (1 << bits) - 1)
    return cells


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each cell on the Hilbert curve through the cube of side 2**bits.

    Goes from the coarsest to the finest bit; at each level the frame is turned the way the curve turns there,
    and the bits of a level are read as a Gray code.
    """
    axes = cells.T.astype(np.int64).copy()
    n = len(axes)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            set_ = (axes[i] >> level) & 1
            swap = np.where(set_ == 1, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(set_ == 1, low, swap)
            axes[i] ^= swap
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    axes ^= turn
    out = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((axes[i] >> level) & 1)
    return out


def curve_keys(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the curve position of each row's text."""
    return add_columns(docs, text, keep, [("curve", T.LongType())], lambda: lambda column: (hilbert(project(column)),))


def pack(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = SEQUENCE, end_token: int = END_TOKEN,
    partitions: int | None = None,
) -> DataFrame:
    """One row per piece: the id, start, length, doc_tokens, sequence_id, offset, and ids (binary, little-endian uint32)."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The key is a place on the curve with a hash below it, so that ties have an even spread.
    key = F.shiftleft("curve", 32) + F.shiftrightunsigned(F.xxhash64(F.col(id_column)), 33)
    share = min(1.0, BOUND_ROWS * partitions / max(docs.count(), 1))
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit("bounds"), F.col(id_column), F.col(text)), 11).cast("double") < share * float(1 << 53)
    keyed = curve_keys(docs.select(id_column, text).filter(drawn), [id_column], text).select(key.alias("key"))
    found = keyed.agg(F.percentile_approx("key", [i / partitions for i in range(1, partitions)] or [0.5], 10 * partitions)).head()[0] or []
    bounds = np.array(sorted(set(found))[: partitions - 1], np.int64)
    itemsize = CachedTokenizer(tokenizer).dtype.itemsize

    def tokenised():
        encode = _remembered(tokenizer)

        def function(column: pa.Array):
            return hilbert(project(column)), encode(column.to_pylist())

        return function

    tokens = add_columns(docs, text, [id_column], [("curve", T.LongType()), ("tokens", T.BinaryType())], tokenised)
    tokens = tokens.withColumn("key", key)
    range_of = F.lit(0) if not len(bounds) else F.size(F.filter(F.lit(bounds.tolist()), lambda b: b < F.col("key")))
    ordered = (
        tokens.select(F.col(id_column), "key", range_of.cast("int").alias("range"), "tokens")
        .repartitionById(partitions, F.col("range"))
        .sortWithinPartitions("range", "key", id_column, "tokens")
    )
    schema = T.StructType([
        docs.schema[id_column], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length)
        kind = None
        for batch in batches:
            kind = batch.schema.field(id_column).type
            ids, ranges, data = batch.column(id_column), batch.column("range").to_pylist(), batch.column("tokens")
            out: list[tuple] = []
            size = 0
            for doc, number, raw in zip(ids.to_pylist(), ranges, data, strict=True):
                tokens = np.frombuffer(raw.as_buffer(), f"<u{itemsize}").astype("<u4")
                made = packer.add(doc, number, np.append(tokens, np.uint32(end_token)).astype("<u4"))
                out += made
                size += sum(len(x[-1]) for x in made)
                if size > 8 * words.STEP_BYTES:
                    yield _batch(out, names, kind)
                    out, size = [], 0
            if out:
                yield _batch(out, names, kind)
        if kind is not None and (out := packer.finish()):
            yield _batch(out, names, kind)

    return small_batches(ordered).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [kind, *[pa.int64()] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


class Packer:
    """Lays documents end to end; holds the pieces of the one open sequence."""

    def __init__(self, length: int):
        self.length, self.range, self.sequence, self.filled = length, None, 0, 0
        self.open: list[tuple] = []  # (doc, start, doc_tokens, ids)

    def add(self, doc, range_: int, ids: np.ndarray) -> list[tuple]:
        out = []
        if range_ != self.range:
            out += self.finish()
            self.range, self.sequence = range_, range_ * RANGE_SEQUENCES
        at = 0
        while at < len(ids):
            take = min(self.length - self.filled, len(ids) - at)
            self.open.append((doc, at, len(ids), ids[at : at + take]))
            self.filled += take
            at += take
            if self.filled == self.length:
                out += self._close(self.open)
                self.open, self.filled = [], 0
        return out

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc, start, total, ids in pieces:
            out.append((doc, start, len(ids), total, self.sequence, offset, ids.tobytes()))
            offset += len(ids)
        self.sequence += 1
        return out

    def finish(self) -> list[tuple]:
        """The open sequence, cut into lengths that are powers of two."""
        out, rest, left = [], self.open, self.filled
        while left:
            size = 1 << (left.bit_length() - 1)
            now, need = [], size
            while need:
                doc, start, total, ids = rest[0]
                now.append((doc, start, total, ids[:need]))
                rest = ([(doc, start + need, total, ids[need:])] if len(ids) > need else []) + rest[1:]
                need -= len(now[-1][3])
            out += self._close(now)
            left -= size
        self.open, self.filled = [], 0
        return out


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per piece with the digest columns of the contract."""
    return pack(docs, **options).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
