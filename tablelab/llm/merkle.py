"""Document fingerprints as Merkle trees, in DataFrame functions alone.

A text is cut into sections (after an empty line), paragraphs (after a line end) and sentences (after stops, at
the latest after 64 characters); nothing is lost by the cuts. A sentence's node is its SHA-256, every other
node the SHA-256 of its children's, so equal roots mean equal texts, and branches that differ locate edits.

The fingerprint is written as ``root:sections``, sections joined by ``;``, their paragraphs by ``|`` and the
sentences of a paragraph by ``,``, each sentence by the first eight hex digits of its node.

Defined cases: a null text counts as empty; an empty text has no sentence, and its likeness is 1 to itself and 0
to any other; repeated rows are fingerprinted one by one; rows of equal or null id follow one another by a hash of
their text, null ids last; in a table of one row the row is its own successor; columns beyond the named ones are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTENCE = r"[^.!?\n]{0,64}[.!?\n ]*"
HEX = 8


def _tree(text: Column) -> Column:
    """Nodes of the sentences: array of sections of paragraphs of sentences."""
    sentences = lambda p: F.transform(
        F.filter(F.regexp_extract_all(p, F.lit(SENTENCE), F.lit(0)), lambda s: s != ""), lambda s: F.sha2(s, 256)
    )
    paragraphs = lambda s: F.transform(F.split(s, r"(?<=\n)(?!\n)", -1), sentences)
    return F.transform(F.split(text, r"(?<=\n\n)(?!\n)", -1), paragraphs)


def _written(tree: Column) -> Column:
    """The fingerprint of a tree of sentence nodes."""
    node = lambda children: F.sha2(F.array_join(children, ""), 256)
    root = node(F.transform(tree, lambda s: node(F.transform(s, node))))
    short = lambda p: F.array_join(F.transform(p, lambda x: F.substring(x, 1, HEX)), ",")
    return F.concat(root, F.lit(":"), F.array_join(F.transform(tree, lambda s: F.array_join(F.transform(s, short), "|")), ";"))


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column. The tree is bound once, so that it is not evaluated for every use."""
    trees = F.transform(F.array(F.coalesce(text, F.lit(""))), _tree)
    return F.element_at(F.transform(trees, _written), 1)


def root(mark: Column) -> Column:
    return F.substring_index(mark, ":", 1)


def _sentences(mark: Column) -> Column:
    found = F.split(F.substring_index(mark, ":", -1), "[,|;]", -1)
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of sentences that two fingerprints have in common, 0 to 1 (Dice)."""
    x, y = _sentences(a), _sentences(b)
    both = F.size(F.array_intersect(x, y)).cast("double")
    return F.when(root(a) == root(b), 1.0).otherwise(F.coalesce(F.lit(2.0) * both / F.nullif(F.size(x) + F.size(y), F.lit(0)), F.lit(0.0)))


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of b that a has not got."""
    paragraphs = lambda m: F.split(F.substring_index(m, ":", -1), "[|;]", -1)
    numbered = F.transform(paragraphs(b), lambda p, i: F.struct(i.alias("at"), F.array_contains(paragraphs(a), p).alias("known")))
    return F.transform(F.filter(numbered, lambda x: ~x["known"]), lambda x: x["at"])


def with_successor(df: DataFrame, key: str, columns: list[str], order: Column, per_partition: int = 4) -> DataFrame:
    """Add ``_next``, a struct of ``columns`` of the row with the next smaller key; the first one's for the last row.

    Keys are cut into ranges at estimated quantiles, rows meet their successor inside a range, and only one row a
    range is looked up elsewhere, so no task holds more than a range.
    """
    spark = df.sparkSession
    n = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).head()[0] or []
    bounds = sorted(set(found))
    range_of = F.size(F.filter(F.lit(bounds), lambda b: b < F.col(key))) if bounds else F.lit(0)
    rows = df.withColumn("_range", F.when(F.col(key).isNull(), -1).otherwise(range_of))
    # The first row of each range, at most n + 1 of them.
    firsts = {r["_range"]: r["key"] for r in rows.groupBy("_range").agg(F.max(key).alias("key")).collect()}
    ranges = sorted(firsts, reverse=True)
    follows = [(a, b) for a, b in zip(ranges, ranges[1:] + ranges[:1], strict=True)]
    heads = rows.filter(F.col(key).isin([k for k in firsts.values() if k is not None]) | F.col(key).isNull())
    by_range = Window.partitionBy("_range").orderBy(F.desc_nulls_last(key), order)
    heads = heads.withColumn("_place", F.row_number().over(by_range)).filter("_place = 1")
    links = spark.createDataFrame(follows or [(0, 0)], "_range int, _after int")
    edge = heads.select(F.col("_range").alias("_after"), F.struct(*columns).alias("_edge")).join(F.broadcast(links), "_after").select("_range", "_edge")
    inner = rows.withColumn("_lead", F.lead(F.struct(*columns)).over(by_range))
    return inner.join(edge, "_range", "left").withColumn("_next", F.coalesce("_lead", "_edge")).drop("_lead", "_edge", "_range")


def report(docs: DataFrame) -> DataFrame:
    """One row per document with the columns of the contract."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text")))
    rows = with_successor(rows, "doc_id", ["text", "fingerprint"], F.xxhash64("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", F.col("_next.fingerprint").alias("_next"), edited.alias("_edited"))
    rows = rows.select("*", F.sha2("_edited", 256).alias("edited_sha256"), fingerprint(F.col("_edited")).alias("edited_fingerprint"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )
