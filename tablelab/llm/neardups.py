"""Near-duplicates by BagMinHash signatures, banding and exact verification of multiset overlap.

A text is the multiset of its five-word shingles. Its signature has, for each of ``SLOTS`` slots, the earliest
point of a Poisson process that runs over (shingle, weight level, time): the levels below a shingle's count are
cut into strips (0,1], (1,2], (2,4], (4,8] and so on, each strip is a process of a rate equal to its width, and a
point counts if its place in the strip is below the count. Two texts share a slot's point with a probability equal
to their weighted Jaccard similarity, exactly and without bias.

Rows of equal multisets collapse first, so copies are one node. Nodes that share a band become candidates:

1. every node is compared with one node, the first of a bucket, that it shares most buckets with;
2. inside a bucket, only nodes of different components are still compared with each other: in small buckets
   pair by pair, while nodes that hang together by large ones are compared in blocks of like size, in which a
   task verifies what the signatures find likely and hands out at most one link a node.

So a large group of near copies costs a link per member, no bucket is cut off, and of the links between different
texts that share a band only those inside one component already and those of unlikely signatures (fewer than 98
of 160 slots equal, a chance of 1.4e-8 at a similarity of 0.8) are not looked at. Every link is verified on
the multisets themselves. At a similarity of 0.8 two texts share none of the 32 bands with a chance of
3.04e-6, so 3.1e-6 of the links at that similarity are missed in all.

Defined cases: a null text or null id is alone; wordless texts form a class only with equal texts; a text of fewer
than five words, but not none, is one shingle; rows of one id are one document; columns beyond the named ones are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .arrow import add_columns, stored
from .components import components

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Shared slots from which on a candidate is verified; six deviations below the expectation at SIMILARITY, of
#: which a true link falls short with a chance of 1.4e-8.
LIKELY = 0.8 - 6 * (0.8 * 0.2 / SLOTS) ** 0.5
#: Nodes of a bucket up to which its pairs are rows; the nodes of larger ones are compared in blocks.
SMALL_BUCKET, BLOCK = 24, 2048
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def multisets(column: pa.Array, width: int = WIDTH):
    """Row, hash and count of the distinct shingles of a text column."""
    hashes, _, _, word_offsets = words.word_hashes(*words.utf8(column))
    found, offsets = words.shingles(hashes, word_offsets, width)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    at = np.flatnonzero(first)
    return row[at], found[at], np.diff(np.append(at, len(row)))


def elements(row: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multisets as sets: row and hash of each (shingle, occurrence)."""
    at = np.repeat(np.arange(len(row)), counts)
    number = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row[at], words.mix(hashes[at] + number.astype(np.uint64) * _GOLDEN)


def signatures(row: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_rows: int, slots: int = SLOTS) -> np.ndarray:
    """Earliest point (its time) of each slot, rows by slots; infinite for rows without shingles."""
    best = np.full(n_rows * slots, np.inf)
    weight = np.bincount(row, counts, n_rows)
    parts = []  # (row, hash, count, low, width) of the strips that reach below a count
    index, low, width = np.arange(len(row)), 0, 1
    while len(index):
        parts.append((row[index], words.mix(hashes[index] + np.uint64(low)), counts[index], np.full(len(index), low), np.full(len(index), width)))
        low, width = low + width, max(1, low + width if low else 1)
        index = index[counts[index] > low]
    if not parts:
        return best.reshape(n_rows, slots)
    row, seed, counts, low, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    limit = slots * (np.log(slots) + 2) / np.maximum(weight, 1)
    time, point = np.zeros(len(row)), seed.copy()

    def advance(at: np.ndarray) -> None:
        point[at] = words.mix(point[at] + _GOLDEN)
        uniform = ((point[at] >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        time[at] -= np.log(uniform) / width[at]

    advance(np.arange(len(row)))
    waiting = np.arange(len(row))
    while len(waiting):
        live = waiting[time[waiting] <= limit[row[waiting]]]
        while len(live):
            place = words.mix(point[live] ^ np.uint64(0xA24BAED4963EE407))
            height = low[live] + width[live] * ((place >> np.uint64(24)).astype(np.float64) / (1 << 40))
            ok = height < counts[live]
            slot = row[live] * slots + (place % np.uint64(slots)).astype(np.int64)
            np.minimum.at(best, slot[ok], time[live][ok])
            advance(live)
            live = live[time[live] <= limit[row[live]]]
        open_ = np.isinf(best).reshape(n_rows, slots).any(1) & (weight > 0)
        limit = np.where(open_, 2 * limit, -1.0)
        waiting = waiting[open_[row[waiting]]]
    return best.reshape(n_rows, slots)


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, d1, d2, weight, bands, slots): digest of the multiset, its size, band hashes and one byte a slot."""
    fields = [("d1", T.LongType()), ("d2", T.LongType()), ("weight", T.LongType()), ("bands", T.ArrayType(T.LongType())), ("slots", T.BinaryType())]

    def make():
        def function(column: pa.Array):
            n = len(column)
            sets = multisets(column)
            row, found = elements(*sets)
            weight = np.bincount(row, minlength=n)
            offsets = np.concatenate([[0], np.cumsum(weight)])
            digests = []
            for salt in (1, 2):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(found ^ words.mix(np.full(1, salt, np.uint64))), dtype=np.uint64)])
                digests.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64).copy())
            for i in np.flatnonzero(weight == 0):
                digest = hashlib.sha256((column[int(i)].as_py() or "").encode()).digest()
                digests[0][i], digests[1][i] = np.frombuffer(digest[:16], np.int64)
            times = signatures(*sets, n)
            value = words.mix(times.view(np.uint64))
            bands = np.zeros((n, BANDS), np.uint64)
            for j in range(ROWS):
                bands = words.mix(bands * _GOLDEN + value[:, j::ROWS])
            bands = words.mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            bytes_ = (value >> np.uint64(56)).astype(np.uint8)
            some = weight > 0
            return [*digests, weight, [b if s else [] for b, s in zip(bands, some, strict=True)], [b.tobytes() if s else b"" for b, s in zip(bytes_, some, strict=True)]]

        return function

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    return add_columns(rows, "text", ["id"], fields, make)


def _sets(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(id, elements) of the named documents: their multisets as sorted sets."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text is not null")
    # Sorted on both sides whatever their sizes, so that the plan does not change with the input.
    rows = rows.join(ids.distinct().hint("merge"), "id", "left_semi")

    def make():
        def function(column: pa.Array):
            row, found = elements(*multisets(column))
            found = found[np.lexsort((found, row))]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(column)))])
            return (pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.view(np.int64))),)

        return function

    return stored(add_columns(rows, "text", ["id"], [("elements", T.ArrayType(T.LongType()))], make).dropDuplicates(["id"]), "elements")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""
    side = lambda name, other: sets.select(F.col("id").alias(name), F.col("elements").alias(other))
    joined = pairs.select("a", "b").join(side("a", "_x"), "a").join(side("b", "_y"), "b")
    both = F.size(F.array_intersect("_x", "_y"))
    return joined.filter(both >= similarity * (F.size("_x") + F.size("_y") - both)).select("a", "b")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, shared): share of equal slots of each pair, where likely and the sizes allow the similarity."""
    side = lambda i: nodes.select(F.col("id").alias("ab"[i]), F.col("slots").alias(f"_s{i}"), F.col("weight").alias(f"_w{i}"))
    joined = pairs.join(side(0), "a").join(side(1), "b").filter(F.least("_w0", "_w1") >= SIMILARITY * F.greatest("_w0", "_w1"))

    @F.pandas_udf("double")
    def shared(x: pd.Series, y: pd.Series) -> pd.Series:
        one, two = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, SLOTS) for s in (x, y))
        return pd.Series((one == two).mean(1))

    return joined.select("a", "b", shared("_s0", "_s1").alias("shared")).filter(F.col("shared") >= LIKELY)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))


def _compare(block: pa.Table, similarity: float) -> pa.Table:
    """Verified links between the nodes of two blocks (or of one) that join components, at most one a node."""
    column = lambda c: block.column(c).to_numpy()
    ids, component, weight, first = column("id"), column("component"), column("weight"), column("_first")
    slots = np.frombuffer(b"".join(block.column("slots").to_pylist()), np.uint8).reshape(-1, SLOTS)
    lists = block.column("elements").combine_chunks()
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    within = block.column("_within")[0].as_py()
    top = {c: c for c in component.tolist()}

    def find(c):
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    links = []
    place = np.arange(len(ids))
    for k in place if within else np.flatnonzero(first):
        other = place[k + 1 :] if within else np.flatnonzero(~first)
        other = other[np.minimum(weight[other], weight[k]) >= similarity * np.maximum(weight[other], weight[k])]
        shared = (slots[other] == slots[k]).mean(1)
        likely = shared >= LIKELY
        for x in other[likely][np.argsort(-shared[likely], kind="stable")].tolist():
            c, d = find(component[k]), find(component[x])
            if c == d:
                continue
            both = len(np.intersect1d(values[offsets[k] : offsets[k + 1]], values[offsets[x] : offsets[x + 1]], assume_unique=True))
            if both >= similarity * (weight[k] + weight[x] - both):
                links.append((int(ids[k]), int(ids[x])))
                top[max(c, d)] = min(c, d)
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _blocks(nodes: DataFrame, similarity: float) -> DataFrame:
    """Verified links inside clusters of any size; rows (cluster, id, component, weight, slots, elements).

    Similar texts are of like size, so nodes are set apart by size class, a class by hash into blocks, and blocks
    meet those of their own and of the next class.
    """
    nodes = nodes.withColumn("_class", F.floor(F.log("weight") / float(-np.log(similarity))).cast("int"))
    sizes = nodes.groupBy("cluster", "_class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_groups"))
    beside = sizes
    for name, step in (("_above", 1), ("_below", -1)):
        other = sizes.select("cluster", (F.col("_class") - step).alias("_class"), F.col("_groups").alias(name))
        beside = beside.join(other, ["cluster", "_class"], "left")
    placed = nodes.join(beside.fillna(0), ["cluster", "_class"]).withColumn("_mine", F.pmod(F.xxhash64("id"), F.col("_groups")).cast("int"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    meet = lambda low, i, j, first, within: F.struct(low.alias("_low"), i.alias("_i"), j.alias("_j"), first.alias("_first"), within.alias("_within"))
    own, no, yes, mine = F.col("_class"), F.lit(False), F.lit(True), F.col("_mine")
    places = F.concat(
        F.transform(upto("_groups"), lambda g: meet(own, F.least(mine, g), F.greatest(mine, g) + 0, mine < g, mine == g)),
        F.transform(upto("_above"), lambda g: meet(own, -1 - mine, g + 0, yes, no)),
        F.transform(upto("_below"), lambda g: meet(own - 1, -1 - g, mine + 0, no, no)),
    )
    spread = placed.select("cluster", "id", "component", "weight", "slots", "elements", F.explode(places).alias("_at")).select("*", "_at.*").drop("_at")
    return spread.groupBy("cluster", "_low", "_i", "_j").applyInArrow(lambda t: _compare(t, similarity), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id) of every id with a text: the smallest id that it is linked with, directly or by others."""
    sketches = stored(sketch(docs, key, text), "sketches")
    copies = sketches.groupBy("d1", "d2").agg(F.min("id").alias("node"))
    # Written before it is grouped, so that Spark can split the join where a digest is hot.
    members = stored(sketches.select("id", "d1", "d2").join(copies, ["d1", "d2"]).select("id", "node"), "members")
    members = stored(members.groupBy("id").agg(F.min("node").alias("node")), "members")
    firsts = sketches.join(members.filter("id = node").select("id"), "id", "left_semi")
    nodes = stored(firsts.dropDuplicates(["id"]).filter("weight > 0").select("id", "weight", "bands", "slots"), "nodes")
    banded = nodes.select("id", F.explode("bands").alias("band"))
    buckets = stored(banded.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = stored(banded.join(buckets, "band"), "shared")
    # 1. One link for each node: to the leader that it shares most buckets with.
    votes = shared.filter("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("n"))
    best = votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("leader")).alias("low"))).alias("best"))
    best = _likely(best.select((-F.col("best.low")).alias("a"), F.col("id").alias("b")), nodes).select("a", "b")
    best = stored(best, "pairs")
    first = components(_verified(best, _sets(docs, _ends(best), key, text), similarity))
    # 2. What is still apart inside a bucket.
    named = shared.join(first, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    apart = named.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("leader"))
    rest = stored(named.join(apart.filter("low <> high").drop("low", "high"), "band"), "rest")
    small, large = rest.filter(F.col("n") <= SMALL_BUCKET), rest.filter(F.col("n") > SMALL_BUCKET)
    left, right = small.select("band", F.col("id").alias("a"), F.col("component").alias("_c")), small.select("band", F.col("id").alias("b"), F.col("component").alias("_d"))
    pairs = stored(_likely(left.join(right, "band").filter("a < b and _c <> _d").select("a", "b").distinct(), nodes).select("a", "b"), "pairs")
    clusters = components(large.select(F.col("leader").alias("a"), F.col("id").alias("b"))).select("id", F.col("component").alias("cluster"))
    sets = _sets(docs, _ends(pairs).union(clusters.select("id")), key, text)
    crowd = clusters.join(large.select("id", "component").distinct(), "id").join(nodes.select("id", "weight", "slots"), "id").join(sets, "id")
    more = _verified(pairs, sets, similarity).union(_blocks(crowd, similarity))
    name = lambda c, out: first.select(F.col("id").alias(c), F.col("component").alias(out))
    merged = more.join(name("a", "_x"), "a", "left").join(name("b", "_y"), "b", "left").select(F.coalesce("_x", "a").alias("a"), F.coalesce("_y", "b").alias("b"))
    second = components(merged).select(F.col("id").alias("component"), F.col("component").alias("_top"))
    classes = members.join(first.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return classes.join(second, "component", "left").select("id", F.coalesce("_top", "component").alias("class_id"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, its class, and whether it is the one of its class that stays."""
    found = near_duplicates(docs, key, text)
    rows = docs.select(F.col(key).alias("id")).join(found, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    return rows.select(F.col("id").alias(key), "class_id", (F.col("class_id") == F.col("id")).alias("stays"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with all its columns; rows without an id or text stay."""
    found = stored(near_duplicates(docs, key, text), "classes")
    gone = found.filter("class_id <> id").select(F.col("id").alias("_gone"))
    kept = docs.join(gone, docs[key] == gone["_gone"], "left_anti")
    repeated = docs.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(1).count()
    if repeated:
        kept = kept.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.filter(F.col(key).isNull()))
    return kept
