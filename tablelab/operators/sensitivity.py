"""Stress tests of a scored table or of a fitted model."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.conditions import complete_cases
from ..functions.groups import to_long
from ..functions.hashing import standard_normal, uniform
from ..functions.nulls import as_column, ratio, ratio_or_zero
from ..functions.order import ROWS_PER_TASK, bucket_index, exact_quantiles, score_edges
from ..session import checkpointed, ensure_checkpoint_dir
from .evaluate import LABEL, PREDICTION, PROBABILITY, ROBUSTNESS, metric_columns, metrics, threshold_sweep
from .growth import grow, planned, two_classes
from .models import PARALLEL_FITS, few_partitions, folds, in_parallel
from .trees import Forest, staged_scores

Scorer = Callable[[DataFrame], DataFrame]

METRICS = ("accuracy", "f1_macro", "precision", "recall", "roc_auc")

# Noise levels, boundary widths and the parameters of the fixed stress model.
NOISE_LEVELS = (0.01, 0.05, 0.1, 0.2)
BOUNDARY_WIDTHS = (0.1, 0.15, 0.2, 0.25)
FIXED_MODEL = {"maxIter": 50, "maxDepth": 3, "stepSize": 0.1, "seed": 42}


# --- bootstrap ---------------------------------------------------------------------------------------


#: Rows of one score that a batch sends on as counts instead of one by one.
SAME_SCORE = 64
_DRAWN = "score double, code tinyint, drawn binary, counts binary"
_BLOCK = "block int, replicate int, pos long, neg long, hit long, false long, other long, won double"


def _packed_draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their draws as bits; rows of one score that stand together often become one row of counts."""
    for batch in batches:
        score, code = batch.column("score").to_numpy(), batch.column("code").to_numpy()
        draws = batch.column("draws").flatten().to_numpy(zero_copy_only=False).reshape(len(score), -1)
        _, group, size = np.unique(score, return_inverse=True, return_counts=True)
        single = size[group] < SAME_SCORE
        bits = [row.tobytes() for row in np.packbits(draws[single], axis=1)]
        rows = [score[single], code[single]]
        together = []
        for g in np.flatnonzero(size >= SAME_SCORE):
            own = group == g
            counts = np.stack([draws[own & (code == c)].sum(axis=0) for c in range(5)]).astype("<i4")
            together.append((float(score[own][0]), counts.tobytes()))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([rows[0], [t[0] for t in together]]), pa.float64()),
            pa.array(np.concatenate([rows[1], [-1] * len(together)]), pa.int8()),
            pa.array(bits + [None] * len(together), pa.binary()), pa.array([None] * len(bits) + [t[1] for t in together], pa.binary()),
        ], ["score", "code", "drawn", "counts"])


def _block_counts(replicates: int):
    """Function from the rows of a block of scores to the counts of each replicate there."""

    def count(table: pa.Table) -> pa.Table:
        score, code = table.column("score").to_numpy(), table.column("code").to_numpy()
        values, group = np.unique(score, return_inverse=True)
        single = code >= 0
        bits = np.frombuffer(b"".join(table.column("drawn").drop_null().to_pylist()), np.uint8).reshape(int(single.sum()), -1)
        whole = [np.frombuffer(x, "<i4").reshape(5, replicates) for x in table.column("counts").drop_null().to_pylist()]
        whole_at, group_at, code_at = group[~single], group[single], code[single]
        out = []
        for r in range(replicates):
            own = (bits[:, r // 8] >> (7 - r % 8)) & 1 == 1
            # Rows by score and by code: neither class, label 0 and 1, each without and with a positive prediction.
            cells = np.bincount(group_at[own] * 5 + code_at[own], minlength=5 * len(values)).reshape(-1, 5)
            for k, counts in zip(whole_at, whole, strict=True):
                cells[k] += counts[:, r]
            if not cells.any():
                continue
            pos, neg = cells[:, 3] + cells[:, 4], cells[:, 1] + cells[:, 2]
            won = float((pos * (np.cumsum(neg) - neg / 2)).sum())
            out.append((table.column("block")[0].as_py(), r, int(pos.sum()), int(neg.sum()), int(cells[:, 4].sum()), int(cells[:, 2].sum()), int(cells[:, 0].sum()), won))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

    return count


def bootstrap_metrics(
    df: DataFrame,
    keys: Sequence[str],
    replicates: int = 100,
    seed: int = 42,
    label: str = LABEL,
    probability: str = PROBABILITY,
    prediction: str = PREDICTION,
    method: str = "xxhash64",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Metrics of the fixed scores on the out-of-bag rows of each replicate.

    A row is out of the bag of a replicate with probability 1/e, decided by the hash of its key and
    the replicate (Poisson bootstrap). ``n`` is the number of its rows; a replicate without rows is absent.

    Rows travel once, with a bit for each replicate, to blocks of neighbouring scores. A block counts all its
    replicates; the area under the curve adds up from blocks and the counts of those below. Rows without a score
    stand below all others.
    """
    y, p = as_column(label), F.coalesce(as_column(probability).cast("double"), F.lit(float("-inf")))
    positive = F.coalesce((as_column(prediction) == 1).cast("int"), F.lit(0))
    code = F.when(y == 0, positive + 1).when(y == 1, positive + 3).otherwise(0)
    out_of_bag = lambda r: uniform(keys, r + F.lit(seed), method) < F.lit(math.exp(-1.0))
    draws = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), out_of_bag)
    rows = df.select(p.alias("score"), code.cast("tinyint").alias("code"), draws.alias("draws")).mapInArrow(_packed_draws, _DRAWN)
    edges = score_edges(df.select(p.alias("score")), "score", rows_per_task)
    blocks = rows.withColumn("block", bucket_index(F.col("score"), edges)).groupBy("block").applyInArrow(_block_counts(replicates), _BLOCK)
    # At most one row for each block and replicate.
    below = Window.partitionBy("replicate").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("won", F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0)))
    per = blocks.groupBy("replicate").agg(
        F.sum("hit").alias("tp"),
        F.sum("false").alias("fp"),
        (F.sum("pos") - F.sum("hit")).alias("fn"),
        (F.sum("neg") - F.sum("false")).alias("tn"),
        F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"),
    )
    figures = metric_columns()
    rows = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return per.select("replicate", rows.alias("n"), *[figures[m].alias(m) for m in METRICS[:-1]], "roc_auc")


def bootstrap_intervals(per_replicate: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Mean, population std and percentile interval of each metric, with the number of its values."""
    tail = (1 - confidence) / 2
    wide = per_replicate.agg(
        *[
            F.struct(F.avg(m), F.stddev_pop(m), F.percentile(m, F.lit([tail, 1 - tail])), F.count(m)).alias(m)
            for m in METRICS
        ]
    )
    per = {
        m: {
            "mean": F.col(f"{m}.col1"),
            "std": F.col(f"{m}.col2"),
            "ci_lower": F.col(f"{m}.col3")[0],
            "ci_upper": F.col(f"{m}.col3")[1],
            "n": F.col(f"{m}.col4"),
        }
        for m in METRICS
    }
    return to_long(wide, [], per, "metric")


# --- perturbation ------------------------------------------------------------------------------------


def perturbation(
    df: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    scorer: Scorer,
    levels: Sequence[float] = NOISE_LEVELS,
    seed: int = 42,
    method: str = "xxhash64",
) -> DataFrame:
    """Share of unchanged predictions, mean |change| and correlation of the probability per noise level.

    Each feature gets normal noise of ``level`` times its sample std, drawn from the hash of the key.
    """
    rows = complete_cases(df, features)
    std = rows.agg(*[F.stddev_samp(as_column(c).cast("double")).alias(c) for c in features]).first()
    base = scorer(rows).withColumnsRenamed({PROBABILITY: "_p0", PREDICTION: "_y0"})
    noisy = base.withColumn("level", F.explode(F.lit([float(v) for v in levels])))
    noisy = noisy.withColumns(
        {
            c: as_column(c).cast("double")
            + F.lit(float(std[c] or 0.0)) * F.col("level") * standard_normal([*keys, F.lit(c), F.col("level")], seed, method)
            for c in features
        }
    )
    scored = scorer(noisy)
    a, b = F.col("_p0"), F.col(PROBABILITY)
    return scored.groupBy("level").agg(
        F.avg((F.col("_y0") == F.col(PREDICTION)).cast("int")).alias("stability"),
        F.avg(F.abs(a - b)).alias("probability_mae"),
        F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias("probability_correlation"),
    )


def overall_stability(per_level: DataFrame) -> DataFrame:
    return per_level.agg(F.avg("stability").alias("overall_stability"))


def stability_grade(score: Column) -> Column:
    return F.when(score >= 0.9, F.lit("high")).when(score >= 0.7, F.lit("medium")).otherwise(F.lit("low"))


# --- refits of a fixed model --------------------------------------------------------------------------


def _fixed_model(params: dict | None) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="label", **{**FIXED_MODEL, **(params or {})})


def ablation(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    k: int = 5,
    params: dict | None = None,
    parallelism: int | None = None,
) -> DataFrame:
    """Macro F1 over k folds with all features and without each one: impact and relative impact (%)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = complete_cases(df.select(*dict.fromkeys([*keys, *features, label])), [*features, label])
    rows = checkpointed(folds(rows, label, keys, k))
    rows = few_partitions(rows, rows.count())
    sets = [list(features), *([f for f in features if f != c] for c in features if len(features) > 1)]

    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows).select("features", as_column(label).alias("label"), "fold")
    tasks = [("fold", fold, [features.index(c) for c in s]) for s in sets for fold in range(k)]
    found = refits(ready, _fixed_model(params), tasks, parallelism)
    scores = np.array([m["f1_macro"] for m in found]).reshape(len(sets), k)
    means, spreads = scores.mean(axis=1).tolist(), scores.std(axis=1).tolist()
    base = means[0]
    out = [("(all)", base, spreads[0], None, None)]
    for c, mean, std in zip(features, means[1:], spreads[1:]):
        out.append((c, mean, std, base - mean, (base - mean) / base * 100 if base > 0 else 0.0))
    return spark.createDataFrame(
        out, "left_out string, f1_macro double, f1_std double, impact double, relative_impact_pct double"
    ).orderBy(F.abs("impact").desc_nulls_first(), "left_out")


def repeated_cv(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    k: int = 5,
    repeats: int = 2,
    params: dict | None = None,
    seed: int = 42,
) -> DataFrame:
    """Repeated stratified folds of a fixed model: mean, std, coefficient, min, max, range of four metrics."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = complete_cases(df.select(*dict.fromkeys([*keys, *features, label])), [*features, label])
    for r in range(repeats):
        rows = folds(rows, label, keys, k, seed + r, name=f"_fold{r}")
    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    ready = ready.select("features", as_column(label).alias("label"), *[f"_fold{r}" for r in range(repeats)])
    ready = checkpointed(ready)
    ready = few_partitions(ready, ready.count())
    tasks = [(f"_fold{r}", f, list(range(len(features)))) for r in range(repeats) for f in range(k)]
    found = refits(ready, _fixed_model(params), tasks)
    names = METRICS[:-1]
    per_run = [(i, *(float(m[c]) for c in names)) for i, m in enumerate(found)]
    return cv_summary(df.sparkSession.createDataFrame(per_run, "run int, " + ", ".join(f"{c} double" for c in names)))


def refits(ready: DataFrame, estimator, tasks: Sequence[tuple[str, int, list[int]]], parallelism: int | None = None) -> list[dict[str, float]]:
    """Figures of a fit on all folds but one, over the rows of that one, for each (fold column, fold, features).

    The fits go on together (``growth``); those with settings that it does not know are Spark's, one by one.
    """
    plans = [planned(estimator, {}, fold, column, tuple(among)) for column, fold, among in tasks]
    together = all(plans) and two_classes(ready)
    forests, counted = grow(ready.withColumn("weight", F.lit(1.0)), plans, True) if together else ([None] * len(tasks), {})

    def run(task: tuple[tuple[str, int, list[int]], Forest | None]) -> dict[str, float]:
        (column, fold, among), forest = task
        if forest is None:
            some = VectorSlicer(inputCol="features", outputCol="_some", indices=among)
            model = estimator.copy({estimator.featuresCol: "_some"}).fit(some.transform(ready.filter(F.col(column) != fold)))
            held = model.transform(some.transform(ready.filter(F.col(column) == fold)))
            return metrics(held.select("label", F.col("prediction").cast("int").alias("prediction"))).first().asDict()
        prediction = staged_scores(forest, [len(forest.roots)], True, F.col("features"))[1][0]
        held = counted[column].filter(F.col(column) == fold).select("label", "n", prediction.alias("prediction"))
        return metrics(held, n="n").first().asDict()

    return in_parallel(run, list(zip(tasks, forests, strict=True)), ready, parallelism or (PARALLEL_FITS[0] if together else None))


def cv_summary(per_run: DataFrame) -> DataFrame:
    """Spread of each metric over the runs; std is the population one."""
    names = METRICS[:-1]
    wide = per_run.agg(*[F.struct(F.avg(m), F.stddev_pop(m), F.min(m), F.max(m)).alias(m) for m in names])
    per = {
        m: {
            "mean": F.col(f"{m}.col1"),
            "std": F.col(f"{m}.col2"),
            "cv_coefficient": F.when(F.col(f"{m}.col1") > 0, F.col(f"{m}.col2") / F.col(f"{m}.col1")).otherwise(F.lit(0.0)),
            "min": F.col(f"{m}.col3"),
            "max": F.col(f"{m}.col4"),
            "range": F.col(f"{m}.col4") - F.col(f"{m}.col3"),
        }
        for m in names
    }
    return to_long(wide, [], per, "metric")


# --- decision boundary ---------------------------------------------------------------------------------


def boundary(
    df: DataFrame, widths: Sequence[float] = BOUNDARY_WIDTHS, label: str = LABEL, probability: str = PROBABILITY
) -> DataFrame:
    """Rows within each width of 0.5, their share (%), and the accuracy inside and outside.

    Both accuracies are null when one side is empty.
    """
    p, y = as_column(probability), as_column(label)
    right = ((p >= 0.5).cast("int") == y).cast("int")
    aggs = [F.count("*").alias("n")]
    for i, w in enumerate(widths):
        near = F.abs(p - 0.5) < w
        aggs.append(
            F.struct(F.count_if(near), F.avg(F.when(near, right)), F.avg(F.when(~near, right))).alias(f"w{i}")
        )
    cells = []
    for i, w in enumerate(widths):
        inside, outside = F.col(f"w{i}.col2"), F.col(f"w{i}.col3")
        both = inside.isNotNull() & outside.isNotNull()
        cells.append(
            F.struct(
                F.lit(float(w)).alias("width"),
                F.col(f"w{i}.col1").alias("n"),
                ratio(F.col(f"w{i}.col1") * 100, F.col("n")).alias("percent"),
                F.when(both, inside).alias("accuracy_inside"),
                F.when(both, outside).alias("accuracy_outside"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


#: Distances from 0.5 are counted in intervals of 0.05.
UNCERTAINTY_INTERVALS = 10


def uncertainty(df: DataFrame, probability: str = PROBABILITY) -> DataFrame:
    """Rows, mean probability, and least, median and largest distance from 0.5, per interval of that distance."""
    p = as_column(probability)
    rows = df.filter(p.isNotNull()).select(p.alias("_p"), F.abs(p - 0.5).alias("distance"))
    place = F.least(F.floor(F.col("distance") * (2 * UNCERTAINTY_INTERVALS)), F.lit(UNCERTAINTY_INTERVALS - 1)).cast("int")
    rows = rows.withColumn("interval", place)
    table = rows.groupBy("interval").agg(
        F.count("*").alias("n"), F.avg("_p").alias("mean_probability"), F.min("distance").alias("min_uncertainty"), F.max("distance").alias("max_uncertainty")
    )
    median = exact_quantiles(rows, ["distance"], [0.5], by=["interval"]).select("interval", F.col("q")[0].alias("median_uncertainty"))
    return table.join(median, "interval")


# --- thresholds ----------------------------------------------------------------------------------------


def threshold_robustness(
    df: DataFrame,
    thresholds: Sequence[float] = ROBUSTNESS,
    by: Sequence[str] = (),
    label: str = LABEL,
    probability: str = PROBABILITY,
) -> DataFrame:
    """Best F1, the threshold range within 95 % of it, F1 at 0.5, and the spread of F1 over the grid."""
    sweep = threshold_sweep(df, thresholds, by, label, probability)
    rows = F.collect_list(F.struct("threshold", "f1"))  # one short list per group
    g = sweep.groupBy(*by).agg(
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("optimal_threshold"),
        F.max("f1").alias("optimal_f1"),
        F.min_by("f1", F.struct(F.abs(F.col("threshold") - 0.5), F.col("threshold"))).alias("f1_at_half"),
        F.var_pop("f1").alias("f1_variance"),
        F.stddev_pop("f1").alias("f1_std"),
        rows.alias("_rows"),
    )
    good = F.transform(
        F.filter("_rows", lambda x: x["f1"] >= F.col("optimal_f1") * 0.95), lambda x: x["threshold"]
    )
    return (
        g.withColumn("robust_low", F.array_min(good))
        .withColumn("robust_high", F.array_max(good))
        .withColumn("robust_width", F.col("robust_high") - F.col("robust_low"))
        .drop("_rows")
    )


# --- summary -------------------------------------------------------------------------------------------


def sensitivity_summary(
    stability: DataFrame, similarity: DataFrame, cv: DataFrame, intervals: DataFrame, robustness: DataFrame
) -> DataFrame:
    """One row per label from the long tables of the single analyses, each with a ``label`` column."""
    levels = [
        F.max(F.when(F.abs(F.col("level") - v) < 1e-9, F.col("stability"))).alias(f"stability_{round(v * 100)}pct")
        for v in NOISE_LEVELS
    ]
    s = stability.groupBy("label").agg(*levels, F.avg("stability").alias("overall_stability"))
    s = s.withColumn("grade", stability_grade(F.col("overall_stability")))
    of = lambda metric, c: F.max(F.when(F.col("metric") == metric, F.col(c)))
    c = cv.groupBy("label").agg(of("f1_macro", "cv_coefficient").alias("cv_coefficient"))
    z = lambda m: ratio_or_zero(1 - of(m, "mean"), of(m, "std"))
    b = intervals.groupBy("label").agg(
        of("f1_macro", "ci_lower").alias("f1_ci_lower"),
        of("f1_macro", "ci_upper").alias("f1_ci_upper"),
        z("f1_macro").alias("z_f1"),
        z("accuracy").alias("z_accuracy"),
        of("f1_macro", "n").alias("n_replicates"),
    )
    r = robustness.select("label", "optimal_threshold", "robust_width")
    m = similarity.select("label", F.col("cosine_mean").alias("cohesion"))
    return reduce(lambda x, y: x.join(y, "label", "left"), [s, m, c, b, r])
