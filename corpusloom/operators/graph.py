"""Graph jobs by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Each round takes the least label among a node and its neighbours and then that label's own label, so chains
    halve; a round ends in a written table, and the loop when no label changes. Components need no bound.
    """
    both = cut(edges.select("a", "b").filter("a != b").unionAll(edges.selectExpr("b as a", "a as b").filter("a != b")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        least = labels.join(near.select(F.col("a").alias("node"), "m"), "node").select("node", "root", F.least("root", "m").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = cut(least.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("root"), (F.coalesce(F.least("low", "far"), F.col("low")) != F.col("root")).alias("moved")))
        moved = new.filter("moved").limit(1).count()
        labels = new.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError("the components did not settle")
