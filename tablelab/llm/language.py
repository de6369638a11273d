"""Language identification by compression with per-language zstandard raw-content dictionaries.

A language is learned as a dictionary of short pieces of its labelled texts. A text goes to the language whose
dictionary makes it smallest. Sizes are taken first with a fast strategy; where the margin between the two best
is narrow, again with a thorough one; where it stays narrow, the text is rejected.

Texts are compared as lower-case words without digits and punctuation. A long text is compressed whole, in
stretches, so that the dictionary stays near.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; equal sizes go to
the language with more labelled texts; without labelled texts every text is ``und``; repeated rows get the same
answer; columns other than the named ones are not read.

Learning is bounded: at most about ``4 * docs_per_language`` whole texts a language are read for pieces, chosen by a
hash of the text, and a dictionary has at most ``DICTIONARY_BYTES``; any number of label values is taken. A text is
compressed with every language, so its cost grows with their number; a task keeps ``READY`` of them ready and goes
through further ones once for many texts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from .arrow import add_columns

DOCS_PER_LANGUAGE = 256
PIECE_BYTES = 256
PIECES_PER_DOC = 2
DICTIONARY_BYTES = 64 << 10
STRETCH_BYTES = 4096
#: Relative size margins: below the first the thorough strategy decides, below the second the text is rejected.
NARROW, REJECT = 0.06, 0.004
#: Languages whose compressors a task keeps ready.
READY = 32
UNKNOWN = "und"

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FIELDS = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("margin", T.DoubleType()), ("rejected", T.BooleanType())]


def normalise(text: str | None) -> bytes:
    """Lower-case words of letters with one blank around each; empty without a letter."""
    if text is None or not any(map(str.isalpha, text)):
        return b""
    parts = text.lower().encode("utf-8", "replace").translate(_LETTERS).split()
    return b" " + b" ".join(parts) + b" " if parts else b""


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> dict[str, bytes]:
    """Dictionary bytes by language, most frequent language first."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = checkpointed(rows.groupBy("lang").agg(F.count("*").alias("n")))
    counts = counted.orderBy(F.desc("n"), "lang").collect()  # label values
    if not counts:
        return {}
    share = F.lit(4.0 * docs_per_language) / F.col("n")
    rows = rows.join(counted, "lang")
    key = F.shiftrightunsigned(F.xxhash64("text"), 11)
    chosen = rows.withColumn("key", key).filter(F.col("key").cast("double") / float(1 << 53) < share)

    def pieces_of():
        def pieces(column: pa.Array):
            out = []
            for value in column.to_pylist():
                data = normalise(value)
                n = min(PIECES_PER_DOC, max(1, len(data) // PIECE_BYTES)) if data else 0
                out.append([data[(at := i * (len(data) // n)) : at + PIECE_BYTES] for i in range(n)])
            return (out,)

        return pieces

    found = add_columns(chosen, "text", ["lang", "key"], [("pieces", T.ArrayType(T.BinaryType()))], pieces_of)
    by_language: dict[str, dict[int, list[bytes]]] = {c["lang"]: {} for c in counts}
    for row in found.collect():  # about 4 * docs_per_language rows a language, of a few hundred bytes
        by_language[row["lang"]][row["key"]] = [bytes(p) for p in row["pieces"]]
    out = {}
    for name, found_pieces in by_language.items():
        pieces = [p for k in sorted(found_pieces) for p in found_pieces[k]]
        data, seen = b"", set()
        for piece in pieces:
            if piece not in seen and len(data) + len(piece) <= DICTIONARY_BYTES:
                seen.add(piece)
                data += piece
        if data:
            out[name] = data
    return out


def _compressors(data: bytes):
    """A fast and a thorough compressor over one dictionary."""
    make = lambda strategy: zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        compression_params=zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=16, hash_log=16, search_log=4, min_match=4, target_length=16, strategy=strategy,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        ),
    )
    return make(zstandard.STRATEGY_FAST), make(zstandard.STRATEGY_LAZY2)


def _size(compressor, data: bytes) -> int:
    return sum(len(compressor.compress(data[a : a + STRETCH_BYTES])) for a in range(0, len(data), STRETCH_BYTES))


def classifier(dictionaries: dict[str, bytes], narrow: float = NARROW, reject: float = REJECT):
    """Function from texts to (language, score, margin, rejected) of each."""
    names = list(dictionaries)
    compressors = lru_cache(READY)(lambda i: _compressors(dictionaries[names[i]]))

    def ranked(texts: Sequence[bytes], which: int) -> list[tuple[str, float]]:
        sizes = np.empty((len(texts), len(names)), np.int64)
        for i in range(len(names)):
            compressor = compressors(i)[which]
            sizes[:, i] = [_size(compressor, data) for data in texts]
        order = np.argsort(sizes, axis=1, kind="stable")[:, :2].tolist()
        margins = [float((own[o[1]] - own[o[0]]) / own[o[1]]) if len(o) > 1 else 1.0 for own, o in zip(sizes, order, strict=True)]
        return [(names[o[0]], margin) for o, margin in zip(order, margins, strict=True)]

    def classify(texts: Sequence[str | None]) -> list[tuple[str, float, float, bool]]:
        data = [normalise(text) for text in texts]
        known = [k for k, d in enumerate(data) if d and names]
        found = dict(zip(known, ranked([data[k] for k in known], 0), strict=True)) if known else {}
        close = [k for k in known if found[k][1] < narrow]
        if close:
            found |= zip(close, ranked([data[k] for k in close], 1), strict=True)
        out = []
        for k in range(len(data)):
            name, margin = found.get(k, (UNKNOWN, 0.0))
            out.append((name, 1.0 - 0.5 * math.exp(-40.0 * margin), margin, margin < reject) if k in found else (UNKNOWN, 0.0, 0.0, True))
        return out

    return classify


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], keep: Sequence[str] = ("doc_id",), text: str = "text", narrow: float = NARROW, reject: float = REJECT
) -> DataFrame:
    """``keep`` columns with lang_pred, score, margin and rejected of every row. The dictionaries are of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(dictionaries))

    def make():
        classify = classifier(shared.value, narrow, reject)
        return lambda column: list(zip(*classify(column.to_pylist()), strict=True))

    return add_columns(docs, text, keep, FIELDS, make)


def held_out(column: str = "doc_id") -> Column:
    """Rows that are not learned from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def report(docs: DataFrame) -> DataFrame:
    """Predict the language of every document after learning from those that are not held out (contract columns)."""
    fold = F.coalesce(held_out(), F.lit(False))
    dictionaries = learn(docs.filter(~fold))
    return identify(docs, dictionaries).select("doc_id", fold.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """Documents whose language is clear, with all their columns. Learned from the labelled rows that are not held out."""
    dictionaries = learn(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"].alias("text"))
    return identify(inner, dictionaries, keep=["_row"]).filter(~F.col("rejected")).select("_row.*")
