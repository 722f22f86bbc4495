"""Connected components of a table of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.common import Scope


def components(links: DataFrame, scope: Scope) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all ends of the links (a, b).

    Every round takes the smallest label of the neighbours and then the label
    of the label, so distances shrink quickly. A round is written to the shared
    folder. Only minima are gathered, so a node with very many links is no burden.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = scope.staged(both.distinct(), "links")
    labels = scope.staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("a"), "component"), "a").groupBy(F.col("b").alias("node"))
        near = labels.withColumnRenamed("component", "old").join(seen.agg(F.min("component").alias("near")), "node")
        near = near.select("node", "old", F.least("old", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        moved = scope.staged(near.join(jump, "via").select("node", "old", F.least("via", "far").alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.filter("component < old").isEmpty():
            return labels
