"""Connected components of a graph of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import discard, release, written


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes in ``links`` (a, b): comp is the smallest node reachable.

    Every round gives each node the smallest label among its neighbours, combined in
    each task before the shuffle, and then the label of its label, so that chains halve.
    Labels are written to the shared folder in each round; it ends when none changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "component-links")
    labels = written(
        both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"), "component-labels"
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("other")), "b")
            .groupBy("a")
            .agg(F.min("other").alias("other"))
        )
        lower = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("comp").alias("was"), F.least("comp", "other").alias("comp")
        )
        lower = written(lower, "component-labels")
        new = written(
            lower.join(lower.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select(
                "node", F.least(F.coalesce("root", "comp"), "comp").alias("comp"), F.col("was")
            ),
            "component-labels",
        )
        changed = new.filter("comp <> was").limit(1).count()
        discard(labels)
        discard(lower)
        release(both.sparkSession)
        labels = new.select("node", "comp")
        if not changed:
            return labels
