"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that has a link; a component is named by its smallest id.

    Every round takes the smallest label among an id's neighbours and then the label of that label, so chains
    shorten by half a round. Rounds are written to the shared folder. Null ids have no link.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    both = stored(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("component")), "labels")
    while True:
        # Only ids whose label differs from their neighbour's can still change.
        sent = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(sent, labels["id"] == sent["a"], "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("jump"))
        now = stored(low.join(jump, "low", "left").select("id", F.least("low", F.coalesce("jump", "low")).alias("component"), F.col("component").alias("was")), "labels")
        changed = now.filter("component <> was").limit(1).count()
        labels = now.select("id", "component")
        if not changed:
            return labels
