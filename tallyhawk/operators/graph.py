"""Graph jobs on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.plans.session import cut


EDGES_PER_PARTITION = 100_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Columns ``node, component``: for each node of an edge its component's smallest node.

    Each round takes the smallest label among the neighbours and then the label of that label, so labels
    travel along a chain by leaps; it ends when a round changes nothing. Labels never leave the cluster: the
    driver sees only whether something changed. Null ends and loops are dropped, repeated edges do no harm,
    an empty table gives an empty table.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    pairs = cut(pairs)
    # as many partitions as the edges need, so that a small graph's rounds don't write thousands of tiny files
    parts = max(8, pairs.count() // EDGES_PER_PARTITION)
    pairs = pairs.coalesce(parts)
    both = cut(pairs.union(pairs.select("b", "a")).distinct().coalesce(parts))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")).coalesce(parts))
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        step = cut(step.coalesce(parts))
        root = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        step = cut(step.join(root, "component").select("node", F.col("root").alias("component"), "before").coalesce(parts))
        labels = step.select("node", "component")
        if step.where("component <> before").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
