"""Connected components of a graph held as an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm.common import stored


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, label): the smallest node each node of an edge (a, b) is connected with. Nodes without edges don't occur.

    Every round takes the least label among neighbours and then the label of that label, so paths halve. Labels are
    written to the shared folder each round; only a count of changes comes to the driver. Groups are never gathered:
    the least is taken with map-side combining, and joins on a hub's key are plain ones that adaptive execution splits.
    """
    both = edges.select("a", "b").where("a != b")
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("_near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("_near", "label")).alias("_new"))
        step = stored(step, "labels")
        jump = step.select(F.col("node").alias("_n"), F.col("_new").alias("_far"))
        after = step.join(jump, F.col("_new") == F.col("_n")).select("node", F.col("_far").alias("label"), (F.col("_far") != F.col("label")).alias("_changed"))
        after = stored(after, "labels")
        labels = after.select("node", "label")
        if after.where("_changed").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
