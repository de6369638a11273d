"""Trees of many models grown together: one job a level for all folds and points of a search.

A fit of its own costs a job for each level of each tree, and a search has dozens of fits. They go over the same rows,
so here they grow together, and the trees are the ones that fits of their own give.

For each held-out fold, rows that no split of its models can tell apart (equal bins of all features, and label) are
counted once, with their weight and number: cells. Where the cells of a fold are few (``ALONE``, checked), each of its
models grows in a task of its own, and one job makes all trees. Elsewhere the cells stay spread over the tasks, and a
job counts one level of the trees of all models: tasks return sums by model, node and bin; they are added and searched
for the best splits on the executors, and the driver gets those splits. Thresholds are looked for as Spark ML does, on
the weighted values of a bounded sample (``SPLIT_ROWS``, all rows where there are fewer), for each held-out fold on
its own.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import as_column
from ..session import checkpointed, ensure_checkpoint_dir
from .trees import Forest

#: Rows that thresholds are looked for in.
SPLIT_ROWS = 50_000
#: Counted rows of a task, at least and at most.
FEW_CELLS, MANY_CELLS = 2_000, 250_000
#: Up to so many bins (cells x features, two bytes each) a model grows in one task.
ALONE = 1_000_000
#: Rounds after which the margins are written to the shared folder, which cuts their lineage.
ROUNDS_KEPT = 25


@dataclass(frozen=True)
class Plan:
    """One model: the fold it does not see, the features it may split by, and its size."""

    fold: int
    depth: int
    rounds: int = 1
    step: float = 0.1
    least: int = 1
    gain: float = 0.0
    column: str = "fold"
    features: tuple[int, ...] | None = None
    count: bool = False  # the rows of each node

    @property
    def key(self) -> tuple[str, int]:
        return self.column, self.fold


@dataclass
class _Tree:
    """Nodes in the order they were made. Leaves point to themselves, so that a walk needs no test."""

    feature: list[int] = field(default_factory=lambda: [0])
    edge: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    sums: list[np.ndarray | None] = field(default_factory=lambda: [None])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    open: list[int] = field(default_factory=lambda: [0])

    def split(self, found: tuple) -> None:
        """Take the best splits of the open nodes; their children are open next."""
        feature, edge, whole, left, right, gain = found
        nodes, self.open = self.open, []
        for i, node in enumerate(nodes):
            self.sums[node] = whole[:, i]
            if feature[i] < 0:
                continue
            self.feature[node], self.edge[node], self.gain[node] = int(feature[i]), int(edge[i]), float(gain[i])
            self.left[node], self.right[node] = len(self.left), len(self.left) + 1
            for sums in (left[:, i], right[:, i]):
                self.open.append(len(self.left))
                for values, value in ((self.feature, 0), (self.edge, -1), (self.left, self.open[-1]), (self.right, self.open[-1]), (self.sums, sums), (self.gain, -1.0)):
                    values.append(value)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """(feature, edge, children, place among the open nodes) for walks."""
        place = np.full(len(self.left), -1, np.int64)
        place[self.open] = np.arange(len(self.open))
        return np.array(self.feature), np.array(self.edge), np.stack([self.left, self.right], axis=1).ravel(), place

    def means(self) -> np.ndarray:
        sums = np.stack(self.sums)
        return np.divide(sums[:, 1], sums[:, 0], out=np.zeros(len(sums)), where=sums[:, 0] != 0)


def _reached(codes: np.ndarray, tree: tuple[np.ndarray, ...], levels: int) -> np.ndarray:
    """Nodes of rows of codes after so many levels."""
    at = np.zeros(len(codes), np.int64)
    for _ in range(levels):
        at = _stepped(codes, at, tree)
    return at


def _stepped(codes: np.ndarray, at: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """Nodes of rows one level further."""
    feature, edge, children, _ = tree
    return children[2 * at + (codes.ravel()[np.arange(0, codes.size, codes.shape[1]) + feature[at]] > edge[at])]


# --- thresholds and cells ---------------------------------------------------------------------------


def thresholds(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Candidate thresholds of one feature: between all values, or between about equal shares of the weight."""
    distinct, at = np.unique(values, return_inverse=True)
    if len(distinct) < 2:
        return np.zeros(0)
    between = (distinct[:-1] + distinct[1:]) / 2.0
    most = min(bins, len(values)) - 1
    if len(between) <= most:
        return between
    sums = np.cumsum(np.bincount(at, weights))
    stride = sums[-1] / (most + 1)
    out, target = [], stride
    for k in range(len(between)):
        if abs(sums[k] - target) < abs(sums[k + 1] - target):
            out.append(between[k])
            target += stride
    return np.array(out)


@dataclass(frozen=True)
class _Bins:
    """Edges of each feature over all held-out folds, and those of each of them."""

    edges: list[np.ndarray]
    own: dict[tuple[str, int], list[np.ndarray]]
    width: int

    @staticmethod
    def of(values: np.ndarray, weights: np.ndarray, folds: dict[str, np.ndarray], held: Sequence[tuple[str, int]], bins: int) -> _Bins:
        found = {}
        for column, fold in held:
            seen = folds[column] != fold
            found[column, fold] = [thresholds(values[seen, j], weights[seen], bins) for j in range(values.shape[1])]
        edges = [np.unique(np.concatenate([f[j] for f in found.values()])) for j in range(values.shape[1])]
        return _Bins(edges, found, 1 + max(len(t) for f in found.values() for t in f))

    def tables(self, key: tuple[str, int]) -> list[np.ndarray]:
        """Per feature the bin of a code (the number of edges under a value) for one held-out fold."""
        return [np.searchsorted(np.searchsorted(e, t), np.arange(len(e) + 1)) for t, e in zip(self.own[key], self.edges, strict=True)]


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def _binary(codes: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(codes, "<u2")
    offsets = (np.arange(len(data) + 1) * 2 * data.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _coded(edges: Sequence[np.ndarray]):
    @F.arrow_udf("binary")
    def code(features: pa.Array) -> pa.Array:
        x = features.flatten().to_numpy().reshape(len(features), len(edges))
        return _binary(np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1))

    return code


def _recoded(cut: _Bins, column: str):
    """Codes among the edges of one held-out fold instead of all edges."""

    @F.arrow_udf("binary")
    def code(codes: pa.Array, held: pa.Array) -> pa.Array:
        c, h = _codes(codes), held.to_numpy(zero_copy_only=False)
        out = np.zeros(c.shape, "<u2")
        for fold in np.unique(h).tolist():
            own = np.flatnonzero(h == fold)
            for j, table in enumerate(cut.tables((column, fold))):
                out[own, j] = table[c[own, j]]
        return _binary(out)

    return code


def _decoded(cut: _Bins, column: str):
    """Features that stand between the same edges of a held-out fold as those of the code."""
    spots = {k[1]: [np.append(e, np.nextafter(e[-1], np.inf)) if len(e) else np.zeros(1) for e in own] for k, own in cut.own.items() if k[0] == column}

    @F.arrow_udf("array<double>")
    def decode(codes: pa.Array, held: pa.Array) -> pa.Array:
        c, h = _codes(codes), held.to_numpy(zero_copy_only=False)
        values = np.zeros(c.shape)
        for fold in np.unique(h).tolist():
            own = np.flatnonzero(h == fold)
            for j, s in enumerate(spots[fold]):
                values[own, j] = s[c[own, j]]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * c.shape[1], pa.int32()), pa.array(values.ravel()))

    return decode


def _block(key: tuple[str, int], table: pa.Table, width: int) -> tuple:
    """(held-out fold, codes, label, weight, rows, margins of its models) of cells."""
    codes = _codes(table.column("codes").combine_chunks()) if table.num_rows else np.zeros((0, width), "<u2")
    return (key, codes, *[table.column(c).to_numpy() for c in ("label", "weight", "n")], {})


def _packed(column: str):
    """One block of each held-out fold that a task has cells of."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if batches:
            table = pa.Table.from_batches(batches)
            for fold in table.column("held").unique().to_pylist():
                block = _block((column, fold), table.filter(pc.equal(table.column("held"), fold)), 0)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, protocol=5)], pa.binary())], ["block"])

    return pack


def planned(estimator, point: Mapping, fold: int, column: str = "fold", features: Sequence[int] | None = None) -> Plan | None:
    """The plan of a fit of the estimator at a grid point; None if it has settings that only Spark's own fit knows."""
    given = {p.name: v for p, v in point.items()}
    of = lambda name: given[name] if name in given else estimator.getOrDefault(name)
    boosted = estimator.hasParam("maxIter")
    plain = {"minWeightFractionPerNode": 0.0, "impurity": "variance" if boosted else "gini", "maxBins": 32}
    plain |= {"subsamplingRate": 1.0, "featureSubsetStrategy": "all", "lossType": "logistic"} if boosted else {}
    if any(of(k) != v for k, v in plain.items()) or any(estimator.hasParam(k) and estimator.isSet(k) for k in ("thresholds", "validationIndicatorCol")):
        return None
    sizes = {"rounds": of("maxIter"), "step": of("stepSize")} if boosted else {}
    return Plan(fold, of("maxDepth"), least=of("minInstancesPerNode"), gain=of("minInfoGain"), column=column, features=features, **sizes)


def two_classes(rows: DataFrame) -> bool:
    return rows.filter(~F.col("label").isin(0, 1)).isEmpty()


# --- one level ----------------------------------------------------------------------------------------


def _residuals(y: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What the next tree of a boosted model is fitted to; ``y`` is -1 or 1."""
    return y if margin is None else 4.0 * y / (1.0 + np.exp(2.0 * y * margin))


def _kinds(plan: Plan, label: np.ndarray, weight: np.ndarray, n: np.ndarray, margin: np.ndarray | None, boosted: bool) -> list[np.ndarray]:
    """What is added up: weight and weighted residual, or weight by class; then rows."""
    y = 2.0 * label - 1.0
    if not boosted:
        return [np.where(y < 0, weight, 0.0), np.where(y > 0, weight, 0.0), n.astype(float)]
    kinds = [weight, weight * _residuals(y, margin)]
    return [*kinds, n.astype(float)] if plan.least > 1 or plan.count else kinds


def _sums(own: np.ndarray, place: np.ndarray, kinds: Sequence[np.ndarray], features: Sequence[int] | None, nodes: int, width: int) -> np.ndarray:
    """Sums by kind, open node, feature and bin; ``own`` has the bins by feature."""
    live = np.flatnonzero(place >= 0)
    some = len(live) < len(place)
    start = (place[live] if some else place) * width
    picked = features or range(len(own))
    out = np.zeros((len(kinds), nodes, len(picked), width))
    kinds = [k[live] if some else k for k in kinds]
    for i, j in enumerate(picked):
        cell = start + (own[j][live] if some else own[j])
        for k, values in enumerate(kinds):
            out[k, :, i] = np.bincount(cell, values, nodes * width).reshape(nodes, -1)
    return out


def _level_sums(blocks: Iterator[tuple], plans: Sequence[Plan], trees: dict[int, tuple], level: int, width: int, boosted: bool) -> Iterator:
    """(model, sums) of a level of each model in each block."""
    for key, codes, label, weight, n, margins in blocks:
        own = np.ascontiguousarray(codes.T, np.int64)
        for m, tree in trees.items():
            if plans[m].key == key:
                kinds = _kinds(plans[m], label, weight, n, margins.get(m), boosted)
                place = tree[3][_reached(codes, tree, level)]
                yield m, _sums(own, place, kinds, plans[m].features, int(tree[3].max()) + 1, width)


def _best_splits(sums: np.ndarray, plan: Plan, boosted: bool) -> tuple[np.ndarray, ...]:
    """(feature or -1, edge, sums of the node, of its left and of its right child, gain) for each open node.

    Of splits of one gain, up to rounding, the first feature and threshold count, however the sums were added.
    """
    nodes = sums.shape[1]
    left = np.cumsum(sums, axis=3)
    whole = left[..., -1:]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        if boosted:
            w, wl, wr = whole[0], left[0], right[0]
            after = (left[1] ** 2 / wl + right[1] ** 2 / wr) / w
            gain, noise = after - whole[1] ** 2 / w / w, 1e-13 * np.abs(after)
            rows = (left[2], right[2]) if len(sums) > 2 else (np.where(wl > 0, 1, 0), np.where(wr > 0, 1, 0))
        else:
            gini = lambda s: 1.0 - (s[0] ** 2 + s[1] ** 2) / (s[0] + s[1]) ** 2
            w, wl, wr = (s[0] + s[1] for s in (whole, left, right))
            gain, noise = gini(whole) - wl / w * gini(left) - wr / w * gini(right), np.full(left.shape[1:], 1e-14)
            rows = (left[2], right[2])
        fits = (rows[0] >= plan.least) & (rows[1] >= plan.least) & (wl > 0) & (wr > 0) & (gain > noise) & (gain >= plan.gain)
    gain = np.where(fits, gain, -np.inf).reshape(nodes, -1)
    top = gain.max(axis=1)
    found = np.isfinite(top)
    near = np.where(found, noise.reshape(nodes, -1)[np.arange(nodes), gain.argmax(axis=1)], 0.0)
    at = (gain >= (top - near)[:, None]).argmax(axis=1)
    i, b = np.divmod(at, sums.shape[3])
    picked = np.array(plan.features or range(sums.shape[2]))
    feature, edge = np.where(found, picked[i], -1), np.where(found, b, -1)
    node = np.arange(nodes)
    return feature, edge, whole[:, node, i, 0], left[:, node, i, b], right[:, node, i, b], gain[node, at]


def _updated(block: tuple, last: Mapping[int, _Tree], plans: Sequence[Plan], r: int) -> tuple:
    """The block with the weighted values of the latest tree, of round r - 1, added to the margins of each of its models."""
    key, codes, *rest, margins = block
    after = {}
    for m, tree in last.items():
        if plans[m].key == key:
            more = (tree.means() * (1.0 if r == 1 else plans[m].step))[_reached(codes, tree.arrays(), plans[m].depth)]
            after[m] = margins[m] + more if m in margins else more
    return (key, codes, *rest, after)


def _alone(block: tuple, plan: Plan, width: int, boosted: bool) -> list[_Tree]:
    """All trees of one model whose cells are one block."""
    _, codes, label, weight, n, _ = block
    own = np.ascontiguousarray(codes.T, np.int64)
    made: list[_Tree] = []
    margin = at = None
    for r in range(plan.rounds):
        if r:
            more = (made[-1].means() * (1.0 if r == 1 else plan.step))[at]
            margin = more if margin is None else margin + more
        kinds = _kinds(plan, label, weight, n, margin, boosted)
        tree, at = _Tree(), np.zeros(len(codes), np.int64)
        for _ in range(plan.depth):
            place = tree.arrays()[3]
            if tree.open:
                tree.split(_best_splits(_sums(own, place[at], kinds, plan.features, len(tree.open), width), plan, boosted))
                at = _stepped(codes, at, tree.arrays())
        made.append(tree)
    return made


# --- all models ---------------------------------------------------------------------------------------


def grow(rows: DataFrame, plans: Sequence[Plan], boosted: bool, bins: int = 32, seed: int = 42) -> tuple[list[Forest], dict[str, DataFrame]]:
    """The trees of each plan, grown on the rows outside its fold, and per fold column the held-out rows counted together.

    Those tables have features (an array of values that every tree of the fold takes the same way as the rows'),
    label, the fold column and ``n``, the number of rows.

    ``rows`` have features, label (0 or 1), weight and the fold columns. ``boosted``: rounds of regression trees on the
    log loss, as ``GBTClassifier``; otherwise one tree by Gini impurity, as ``DecisionTreeClassifier``.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    columns = list(dict.fromkeys(p.column for p in plans))
    if len(columns) > 1:
        # Rows that differ in another column's folds are counted together.
        found = {c: grow(rows, [p for p in plans if p.column == c], boosted, bins, seed) for c in columns}
        forests = {c: iter(f) for c, (f, _) in found.items()}
        return [next(forests[p.column]) for p in plans], {c: counted[c] for c, (_, counted) in found.items()}
    (column,) = columns
    rows = rows.select(
        vector_to_array("features").alias("features"), F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"), column
    )
    n = rows.count()
    sample = (rows if n <= SPLIT_ROWS else rows.sample(SPLIT_ROWS / n, seed)).toArrow()
    values = sample.column("features").combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1)
    held = list(dict.fromkeys(p.key for p in plans))
    cut = _Bins.of(values, sample.column("weight").to_numpy(), {column: sample.column(column).to_numpy()}, held, bins)

    summed = [F.sum("weight").alias("weight"), F.sum("n").alias("n")]
    cells = rows.select(_coded(cut.edges)("features").alias("codes"), "label", "weight", column, F.lit(1).alias("n"))
    cells = cells.groupBy("codes", "label", column).agg(*summed).withColumn("held", F.explode(F.lit([fold for _, fold in held])))
    cells = cells.select("held", _recoded(cut, column)("codes", "held").alias("codes"), "label", (~as_column(column).eqNullSafe(F.col("held"))).alias("seen"), "weight", "n")
    cells = checkpointed(cells.groupBy("held", "codes", "label", "seen").agg(*summed))
    seen, sizes = cells.filter("seen").drop("seen"), {r["held"]: r["n"] for r in cells.filter("seen").groupBy("held").agg(F.count("*").alias("n")).collect()}
    alone = [m for m, p in enumerate(plans) if sizes.get(p.fold, 0) * len(cut.edges) <= ALONE]
    made = dict(zip(alone, _each_alone(seen, alone, plans, cut, boosted, sizes), strict=True))
    spread = [m for m in range(len(plans)) if m not in made]
    if spread:
        some = seen.filter(F.col("held").isin(*{plans[m].fold for m in spread}))
        made |= _by_level(some, sum(sizes[f] for f in {plans[m].fold for m in spread}), spread, plans, cut, boosted)
    out = cells.filter("NOT seen").select(_decoded(cut, column)("codes", "held").alias("features"), "label", F.col("held").alias(column), "n")
    return [_forest(made[m], p, cut.own[p.key], boosted) for m, p in enumerate(plans)], {column: out}


def _blocks(cells: DataFrame, column: str):
    return cells.mapInArrow(_packed(column), "block binary").rdd.map(lambda r: pickle.loads(r[0]))


def _each_alone(cells: DataFrame, models: Sequence[int], plans: Sequence[Plan], cut: _Bins, boosted: bool, sizes: Mapping[int, int]) -> list[list[_Tree]]:
    """The trees of models of few cells: those of a held-out fold meet in one block, which goes to a task of each model."""
    folds = sorted({plans[m].fold for m in models if sizes.get(plans[m].fold)})
    width, grown, made = cut.width, [plans[m] for m in models], {}
    if folds:
        own = cells.filter(F.col("held").isin(*folds)).repartition(len(folds), "held")
        tasks = _blocks(own, plans[models[0]].column).flatMap(lambda block: [(i, block) for i, m in enumerate(models) if plans[m].key == block[0]])
        tasks = tasks.partitionBy(len(models), lambda i: i)
        made = dict(tasks.map(lambda task: (task[0], _alone(task[1], grown[task[0]], width, boosted))).collect())
    # A fold that leaves no rows has no block.
    none = pa.table({"codes": pa.array([], pa.binary()), "label": pa.array([], pa.int32()), "weight": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
    return [made[i] if i in made else _alone(_block(plans[m].key, none, len(cut.edges)), plans[m], width, boosted) for i, m in enumerate(models)]


def _by_level(cells: DataFrame, n: int, models: Sequence[int], plans: Sequence[Plan], cut: _Bins, boosted: bool) -> dict[int, list[_Tree]]:
    """The trees of models of many cells, which stay spread: a job counts one level of the trees of all models."""
    parts = max(math.ceil(n / MANY_CELLS), min(cells.sparkSession.sparkContext.defaultParallelism, math.ceil(n / FEW_CELLS)), 1)
    state = _blocks(cells.repartition(parts), plans[models[0]].column).persist(StorageLevel.MEMORY_AND_DISK)
    made: dict[int, list[_Tree]] = {m: [] for m in models}
    for r in range(max(plans[m].rounds for m in models)):
        growing = {m: _Tree() for m in models if plans[m].rounds > r}
        before = None
        if r:
            before, state = state, _next_state(state, {m: made[m][-1] for m in growing}, plans, r)
        level = 0
        while trees := {m: t.arrays() for m, t in growing.items() if t.open and plans[m].depth > level}:
            for m, found in _grown_level(state, plans, trees, level, cut.width, boosted, parts):
                growing[m].split(found)
            level += 1
        if before is not None:
            before.unpersist()
        for m, tree in growing.items():
            made[m].append(tree)
    state.unpersist()
    return made


def _grown_level(state, plans: Sequence[Plan], trees: dict[int, tuple], level: int, width: int, boosted: bool, parts: int) -> list:
    sums = state.mapPartitions(lambda blocks: _level_sums(blocks, plans, trees, level, width, boosted))
    added = sums.reduceByKey(lambda a, b: a + b, min(parts, len(trees)))
    return added.map(lambda x: (x[0], _best_splits(x[1], plans[x[0]], boosted))).collect()


def _next_state(state, last: Mapping[int, _Tree], plans: Sequence[Plan], r: int):
    after = state.map(lambda block: _updated(block, last, plans, r)).persist(StorageLevel.MEMORY_AND_DISK)
    if r % ROUNDS_KEPT == 0:
        after.checkpoint()
    return after


def _forest(trees: Sequence[_Tree], plan: Plan, edges: Sequence[np.ndarray], boosted: bool) -> Forest:
    roots = np.cumsum([0, *[len(t.left) for t in trees]])
    joined = lambda get: np.concatenate([get(t, k) for t, k in zip(trees, roots)])
    inner = joined(lambda t, k: np.array(t.edge) >= 0)
    feature, edge = (joined(lambda t, k, c=c: np.array(getattr(t, c))) for c in ("feature", "edge"))
    threshold = np.array([edges[f][e] if e >= 0 else 0.0 for f, e in zip(feature, edge, strict=True)])
    child = lambda c: np.where(inner, joined(lambda t, k: np.array(getattr(t, c)) + k), -1)
    sums = joined(lambda t, k: np.stack(t.sums))
    share = np.divide(sums[:, 1], sums[:, 0] + sums[:, 1], out=np.zeros(len(sums)), where=sums[:, 0] + sums[:, 1] != 0)
    return Forest(
        roots[:-1], joined(lambda t, k: _numbers(t)), feature, threshold, np.zeros(len(inner), bool), np.zeros((len(inner), 1), bool),
        child("left"), child("right"), joined(lambda t, k: t.means()) if boosted else (sums[:, 1] > sums[:, 0]).astype(float), share,
        np.array([1.0, *[plan.step] * (len(trees) - 1)]), joined(lambda t, k: np.array(t.gain)), sums[:, 0] if boosted else sums[:, 0] + sums[:, 1],
        sums[:, 2].astype(np.int64) if sums.shape[1] > 2 else None,
    )


def _numbers(tree: _Tree) -> np.ndarray:
    """Numbers of the nodes as Spark saves them: a node before its left side, and that before its right side."""
    out, stack = np.zeros(len(tree.left), np.int64), [0]
    for number in range(len(out)):
        node = stack.pop()
        out[node] = number
        if tree.edge[node] >= 0:
            stack += [tree.right[node], tree.left[node]]
    return out
