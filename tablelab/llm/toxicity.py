"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its words and word beginnings, and the
bag's score is their noisy-or, 1 - prod(1 - p). A sentence without a learned feature has the score 0, and of
those under ``LEAST_SCORE`` the strongest alone counts, so that length alone makes no text toxic. Weights are learned from document labels alone, by gradient ascent
of the bag likelihood over the features that stand out in documents of label 1; the sentence scores then show
which sentences offend.

Learning is bounded: of each label about ``docs_per_label`` labelled documents, whatever their length, in the order
of a hash of the key as long as they fit ``SAMPLE_BYTES`` bytes together (one that does not fit any more is passed
over), and at most ``FEATURES`` features. Scoring covers whole texts of all rows.

Defined cases: null and wordless texts have no sentence and get the score of the empty bag (0); a label other than
0 and 1 and rows without a text are not learned from; without both labels every score is 0; repeated label rows
of a document count once, toxic if any of them says so; repeated documents are scored alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .arrow import add_columns

DOCS_PER_LABEL = 2500
#: Bytes of the texts of a label that are learned from, together.
SAMPLE_BYTES = 16 << 20
#: Of sentences of a lower score only the strongest counts.
LEAST_SCORE = 0.05
#: Features are hashed into so many bits.
BITS = 20
#: Lengths in bytes of the word beginnings that count as features beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8, 9)
#: A feature is used from so many standard errors of its share of documents on, the strongest first.
STANDS_OUT, FEATURES = 4.0, 4096
ROUNDS = 300
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?\n"]] = True

FIELDS = [("score", T.DoubleType()), ("starts", T.ArrayType(T.LongType())), ("ends", T.ArrayType(T.LongType())), ("sentence_scores", T.ArrayType(T.DoubleType()))]


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        """Weight by hashed feature."""
        out = np.zeros(1 << BITS)
        out[self.features] = self.weights
        return out


NO_MODEL = Model(np.zeros(0, np.int64), np.zeros(0), -30.0)


def features(data: np.ndarray, offsets: np.ndarray):
    """Hashed features of each word (a row per kind, -1 where a word has none), word starts and ends, the sentence
    of each word, and the sentence offsets of the rows.

    A sentence ends at a stop or line end after a word; sentences without words don't count.
    """
    hashes, starts, ends, word_offsets, beginnings = words.word_hashes(data, offsets, BEGINNINGS)
    if not len(hashes):
        return np.zeros((len(BEGINNINGS) + 1, 0), np.int64), starts, ends, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    found = np.stack([(h >> np.uint64(64 - BITS)).astype(np.int64) for h in (hashes, *beginnings)])
    for k, length in enumerate(BEGINNINGS, 1):
        found[k][ends - starts <= length] = -1
    stops = np.concatenate([[0], np.cumsum(_STOPS[data])])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(word_offsets))
    new = np.ones(len(hashes), bool)
    new[1:] = (stops[starts[1:]] != stops[starts[:-1]]) | (row[1:] != row[:-1])
    return found, starts, ends, np.cumsum(new) - 1, np.concatenate([[0], np.cumsum(new)])[word_offsets]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: Sequence[str], labels: Sequence[int], rounds: int = ROUNDS) -> Model:
    """Learn from documents and their labels (0 or 1)."""
    labels = np.asarray(labels)
    if not len(labels) or labels.min() == labels.max():
        return NO_MODEL
    column, sentence, doc, n = [], [], [], 0
    shares = np.zeros((2, 1 << BITS))
    step = 200
    for i in range(0, len(texts), step):
        found, _, _, inside, row_sentences = features(*words.utf8(pa.array(texts[i : i + step], pa.string())))
        rows = np.repeat(np.arange(len(row_sentences) - 1), np.diff(row_sentences))
        at, inside = found.ravel(), np.tile(inside, len(found))
        at, inside = at[at >= 0], inside[at >= 0]
        pair = np.unique((inside.astype(np.int64) << BITS) | at)
        in_doc = np.unique((rows[pair >> BITS].astype(np.int64) << BITS) | (pair & ((1 << BITS) - 1)))
        for y in (0, 1):
            shares[y] += np.bincount((in_doc & ((1 << BITS) - 1))[labels[i + (in_doc >> BITS)] == y], minlength=1 << BITS)
        column.append(pair & ((1 << BITS) - 1))
        sentence.append((pair >> BITS) + n)
        doc.append(rows + i)
        n += len(rows)
    column, sentence, doc = np.concatenate(column), np.concatenate(sentence), np.concatenate(doc)
    n_docs = np.array([(labels == 0).sum(), (labels == 1).sum()])
    share = shares.sum(0) / n_docs.sum()
    error = np.sqrt(share * (1 - share) * (1 / n_docs).sum())
    strength = (shares[1] / n_docs[1] - shares[0] / n_docs[0]) / np.maximum(error, 1e-9)
    chosen = np.argsort(-strength, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[strength[chosen] >= STANDS_OUT])
    number = np.full(1 << BITS, -1)
    number[chosen] = np.arange(len(chosen))
    used = number[column] >= 0
    column, sentence = number[column[used]], sentence[used]
    k = len(chosen)
    # Sentences without a feature that is used have no part in any bag.
    held, sentence = np.unique(sentence, return_inverse=True)
    doc, n = doc[held], len(held)
    weights, bias = np.zeros(k), -5.0
    balance = 1 / len(labels)
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        p = _logistic(bias + np.bincount(sentence, weights[column], n))
        clear = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(labels))  # log of prod(1 - p)
        bag = np.clip(-np.expm1(clear), 1e-9, 1 - 1e-9)
        slope = p * (balance * np.where(labels == 1, (1 - bag) / bag, -1.0))[doc]
        grad = np.append(np.bincount(column, slope[sentence], k) - RIDGE * weights, slope.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        weights += move[:-1]
        bias += move[-1]
    return Model(chosen, weights, float(bias))


RIDGE = 1e-4


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", docs_per_label: int = DOCS_PER_LABEL,
    sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Fit on a bounded sample of the labelled documents."""
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    counts = {r["_label"]: r["count"] for r in marks.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return NO_MODEL
    chance = F.when(F.col("_label") == 1, min(1.0, docs_per_label / counts[1])).otherwise(min(1.0, docs_per_label / counts[0]))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("_key"), F.lit("toxicity")), 11).cast("double") / float(1 << 53)
    chosen = F.broadcast(marks.filter(draw < chance))  # about docs_per_label rows a label
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).join(chosen, "_key")

    sizes = rows.select("_key", "_label", draw.alias("_draw"), F.octet_length("text").alias("_size"), F.xxhash64("text").alias("_text"))
    taken, used = [], {0: 0, 1: 0}
    for r in sorted(sizes.collect(), key=lambda r: (r["_draw"], r["_key"], r["_text"])):  # about docs_per_label rows a label
        if used[r["_label"]] + r["_size"] <= sample_bytes:
            used[r["_label"]] += r["_size"]
            taken.append(r["_key"])
    if not taken:
        return NO_MODEL
    kept = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in sorted(set(taken))], T.StructType([T.StructField("_key", docs.schema[key].dataType)])))
    sample = sorted((r["_label"], r["text"]) for r in rows.join(kept, "_key").select("text", "_label").toLocalIterator())
    return fit([x[1] for x in sample], [x[0] for x in sample])


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text: str = "text", least: float = 0.5) -> DataFrame:
    """``keep`` columns with the document's score and its sentences of score ``least`` or more.

    A sentence is given by its byte range in the UTF-8 text (from its first to its last word) and its score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        table = np.append(model.table(), 0.0)  # the last one is of features that a word lacks
        used = np.zeros(len(table))
        used[model.features] = 1.0

        def function(column: pa.Array):
            found, starts, ends, sentence, row_sentences = features(*(both := words.utf8(column)))
            n = int(row_sentences[-1])
            p = _logistic(model.bias + np.bincount(sentence, table[found].sum(0), n))
            p[np.bincount(sentence, used[found].sum(0), n) == 0] = 0.0
            row = np.repeat(np.arange(len(row_sentences) - 1), np.diff(row_sentences))
            weak = np.zeros(len(row_sentences) - 1)
            np.maximum.at(weak, row, np.where(p < LEAST_SCORE, p, 0.0))
            p[p < LEAST_SCORE] = 0.0
            clear = np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
            total = 1 - np.exp(clear[row_sentences[1:]] - clear[row_sentences[:-1]]) * (1 - weak)
            begin, end = np.searchsorted(sentence, np.arange(n)), np.searchsorted(sentence, np.arange(n), "right") - 1
            high = np.flatnonzero(p >= least)
            base = both[1][row[high]]
            cut = np.searchsorted(row[high], np.arange(len(row_sentences)))
            lists = [
                pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, k))
                for v, k in ((starts[begin[high]] - base, pa.int64()), (ends[end[high]] - base, pa.int64()), (p[high], pa.float64()))
            ]
            return [np.clip(total, 0, 1) + 0.0, *lists]

        return function

    return add_columns(docs, text, keep, FIELDS, make)


def held_out(column: str = "doc_id") -> Column:
    """Rows that are not learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document after learning from the labels of those that are not held out (contract columns)."""
    model = learn(docs, labels.filter(~held_out()))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("starts").cast("long").alias("n_offending")
    )
