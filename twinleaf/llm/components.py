"""Connected components of a large, sparse graph, by smallest labels and pointer jumping.

Labels live in tables in the shared folder; only two counts a round reach the driver. A node's label is the smallest it has seen
among its neighbours; then labels are replaced by the labels of the nodes they name, so long chains shrink by half each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, kept, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, label: the smallest node of its component, for every node of an edge."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    held = labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        step = labels.join(near, "node").select("node", F.least("label", "seen").alias("next"), F.col("label").alias("was"))
        target = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        moved = materialise(step.join(target, "next").select("node", F.least("next", "jump").alias("label"), "was"), "labels")
        changed = moved.where("label <> was").limit(1).count()
        discard(held)
        held = moved
        labels = moved.select("node", "label")
        if not changed:
            discard(both)
            return kept(labels, held)
