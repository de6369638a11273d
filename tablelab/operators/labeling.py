"""Text matching and keyword labels: everything is a Column, every report one aggregate."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.groups import to_long
from ..functions.keywords import FEW_KEYWORDS, keyword_hits, keyword_occurrences
from ..functions.nulls import as_column


@dataclass(frozen=True)
class MatchOptions:
    """``use_regex`` wins over ``match_whole_word``; the default is substring matching."""

    match_whole_word: bool = False
    use_regex: bool = False
    case_sensitive: bool = False
    minimum_keyword_matches: int = 1


@dataclass(frozen=True)
class Label:
    name: str
    keywords: tuple[str, ...] = ()
    enabled: bool = True

    @staticmethod
    def of(name: str, spec: Mapping[str, Any]) -> Label:
        return Label(name, tuple(spec.get("keywords", ())), bool(spec.get("enabled", True)))


@dataclass
class LabelPlan:
    """The label columns that will be added, and the patterns that had to be left out."""

    labels: list[Label]
    columns: dict[str, Column] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def combined_text(df: DataFrame, columns: Sequence[str], lower: bool = True) -> Column:
    """The existing text columns joined with one space, a missing one counting as empty text."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return F.lit("")
    text = F.concat_ws(" ", *[F.coalesce(as_column(c).cast("string"), F.lit("")) for c in present])
    return F.lower(text) if lower else text


def _any(parts: Sequence[Column]) -> Column:
    return reduce(operator.or_, parts) if parts else F.lit(False)


def invalid_pattern(spark: SparkSession, pattern: str) -> str | None:
    """Why the JVM refuses the pattern, or None if it compiles."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as err:  # py4j wraps the Java exception
        cause = getattr(err, "java_exception", None)
        return cause.getDescription() if cause is not None else str(err)
    return None


def keyword_test(text: Column, keyword: str, options: MatchOptions) -> Column:
    """Does one keyword occur in the text? The text is already in lower case unless case counts."""
    if options.use_regex:
        return text.rlike(keyword if options.case_sensitive else f"(?i){keyword}")
    if options.match_whole_word:
        flags = "(?U)" if options.case_sensitive else "(?iU)"
        return text.rlike(rf"{flags}\b\Q{keyword}\E\b")
    return text.contains(keyword if options.case_sensitive else keyword.lower())


def _written(keywords: Iterable[str], options: MatchOptions, each: bool = False) -> list[str]:
    """Keywords as they stand in the text, each once, or ``each`` of them."""
    found = [k if options.case_sensitive else k.lower() for k in keywords]
    return found if each else list(dict.fromkeys(found))


def _in_one_pass(keywords: Sequence[str], options: MatchOptions) -> bool:
    """Whether one automaton of all keywords takes the place of a search for each."""
    return len(keywords) > FEW_KEYWORDS and all(keywords) and not (options.use_regex or options.match_whole_word)


def match(text: Column, keywords: Sequence[str], options: MatchOptions = MatchOptions()) -> Column:
    """0/1: at least ``minimum_keyword_matches`` distinct keywords occur. Null text gives 0."""
    keywords = list(dict.fromkeys(keywords))
    if not keywords:
        return F.lit(0)
    if options.minimum_keyword_matches > 1:
        hits = reduce(operator.add, [keyword_test(text, k, options).cast("int") for k in keywords])
        found = hits >= options.minimum_keyword_matches
    elif options.match_whole_word and not options.use_regex:
        flags = "(?U)" if options.case_sensitive else "(?iU)"
        words = "|".join(rf"\Q{k}\E" for k in keywords)
        found = text.rlike(rf"{flags}\b(?:{words})\b")
    else:
        found = _any([keyword_test(text, k, options) for k in keywords])
    return F.coalesce(found.cast("int"), F.lit(0))


def plan_labels(
    df: DataFrame, labels: Sequence[Label], text: Column, options: MatchOptions = MatchOptions()
) -> LabelPlan:
    plan = LabelPlan([lab for lab in labels if lab.enabled])
    every = _written([w for lab in plan.labels for w in lab.keywords], options)
    if _in_one_pass(every, options):
        # The same search for all labels, so it runs once a row.
        hits, number = keyword_hits(text, every), {w: k for k, w in enumerate(every)}
        for lab in plan.labels:
            if not lab.keywords:
                plan.columns[lab.name] = F.lit(0)
                continue
            # Keywords that differ in case alone count one by one, as they do where each is searched.
            own = [number[w] for w in _written(dict.fromkeys(lab.keywords), options, each=True)]
            found = F.size(F.array_intersect(hits, F.lit(sorted(set(own)))))
            for k in (k for i, k in enumerate(own) if k in own[:i]):
                found = found + F.array_contains(hits, k).cast("int")
            plan.columns[lab.name] = F.coalesce((found >= max(options.minimum_keyword_matches, 1)).cast("int"), F.lit(0))
        return plan
    for lab in plan.labels:
        words = list(lab.keywords)
        if options.use_regex:
            reasons = {w: invalid_pattern(df.sparkSession, w) for w in words}
            plan.warnings += [f"{lab.name}: pattern {w!r} skipped: {r}" for w, r in reasons.items() if r]
            words = [w for w in words if not reasons[w]]
        plan.columns[lab.name] = match(text, words, options)
    return plan


def label_rows(
    df: DataFrame,
    labels: Sequence[Label],
    text_columns: Sequence[str],
    options: MatchOptions = MatchOptions(),
    keep_text: str | None = None,
) -> tuple[DataFrame, LabelPlan]:
    """Add one 0/1 column per enabled label. The text is combined once and dropped unless asked for."""
    name = keep_text or "_combined_text"
    with_text = df.withColumn(name, combined_text(df, text_columns, lower=not options.case_sensitive))
    plan = plan_labels(with_text, labels, F.col(name), options)
    out = with_text.select("*", *[c.alias(n) for n, c in plan.columns.items()])
    return (out if keep_text else out.drop(name)), plan


def occurrences(text: Column, keyword: str) -> Column:
    """Non-overlapping occurrences of a keyword."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(keyword), F.lit("")))) / len(keyword)).cast("long")


def keyword_counts(df: DataFrame, text: Column, keywords: Sequence[str]) -> DataFrame:
    """Total occurrences of every keyword over all rows."""
    words = list(dict.fromkeys(keywords))
    if len(words) > FEW_KEYWORDS and all(words):
        found = df.select(F.inline(keyword_occurrences(text, words))).groupBy("k").agg(F.sum("n").alias("n"))
        return _named(df.sparkSession, [(k, w) for k, w in enumerate(words)], "k int, keyword string", found, "keyword", "occurrences")
    wide = df.agg(*[F.sum(occurrences(text, w)).alias(f"k{i}") for i, w in enumerate(words)])
    return to_long(wide, [], {w: {"occurrences": F.coalesce(F.col(f"k{i}"), F.lit(0))} for i, w in enumerate(words)}, "keyword")


def keyword_statistics(
    df: DataFrame, text: Column, labels: Sequence[Label], options: MatchOptions = MatchOptions()
) -> DataFrame:
    """Rows containing each keyword of each label, over the whole table in one aggregate."""
    pairs = [(lab.name, w) for lab in labels if lab.enabled for w in dict.fromkeys(lab.keywords)]
    every = _written([w for _, w in pairs], options)
    if _in_one_pass(every, options):
        number = {w: k for k, w in enumerate(every)}
        found = df.select(F.explode(keyword_hits(text, every)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
        listed = [(number[v], n, w) for (n, w), v in zip(pairs, _written([w for _, w in pairs], options, each=True), strict=True)]
        return _named(df.sparkSession, listed, "k int, label string, keyword string", found, "label keyword", "rows")
    wide = df.agg(*[F.count_if(keyword_test(text, w, options)).alias(f"k{i}") for i, (_, w) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(n).alias("label"), F.lit(w).alias("keyword"), F.col(f"k{i}").alias("rows"))
        for i, (n, w) in enumerate(pairs)
    ]
    return wide.select(F.inline(F.array(*rows)))


def _named(spark: SparkSession, listed: list[tuple], schema: str, found: DataFrame, names: str, count: str) -> DataFrame:
    """The figures of numbered keywords with their names; a keyword that no row holds has 0."""
    table = spark.createDataFrame(listed, schema).join(found, "k", "left")
    return table.select(*names.split(), F.coalesce("n", F.lit(0)).alias(count))


def label_counts(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Members and share (%, 2 places) of each label."""
    wide = df.agg(
        *[F.coalesce(F.sum(as_column(n)), F.lit(0)).alias(f"s{i}") for i, n in enumerate(labels)],
        *[F.avg(as_column(n)).alias(f"m{i}") for i, n in enumerate(labels)],
    )
    return to_long(
        wide,
        [],
        {n: {"n": F.col(f"s{i}"), "percent": F.round(F.col(f"m{i}") * 100, 2)} for i, n in enumerate(labels)},
        "label",
    )


def label_overlap(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Co-occurrence count of every ordered pair of labels; the diagonal is the label's own count."""
    idx = range(len(labels))
    pairs = [(i, j) for i in idx for j in idx if i <= j]
    wide = df.agg(
        *[F.coalesce(F.sum(as_column(labels[i]) * as_column(labels[j])), F.lit(0)).alias(f"p{i}_{j}") for i, j in pairs]
    )
    rows = [
        F.struct(
            F.lit(labels[i]).alias("label_a"),
            F.lit(labels[j]).alias("label_b"),
            F.col(f"p{min(i, j)}_{max(i, j)}").alias("n"),
        )
        for i in idx
        for j in idx
    ]
    return wide.select(F.inline(F.array(*rows)))


def set_count(labels: Sequence[str]) -> Column:
    """Number of labels set on the row."""
    return reduce(operator.add, [F.coalesce(as_column(n), F.lit(0)) for n in labels])


def label_coverage(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    n = set_count(labels)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(n == 0).alias("unlabelled"),
        F.count_if(n > 1).alias("multi_label"),
    )


def display_name(label: str) -> str:
    return label.replace("_related", "").replace("_", " ").title()


def combination(labels: Sequence[str], none: str = "Unlabeled") -> Column:
    """Display names of the set labels joined with ' + '."""
    names = F.concat_ws(" + ", *[F.when(as_column(n) == 1, F.lit(display_name(n))) for n in labels])
    return F.coalesce(F.nullif(names, F.lit("")), F.lit(none))


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*ids, *[as_column(c).cast("double").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), name, value
    )
