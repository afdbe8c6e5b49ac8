"""Connected components of an undirected graph of long ids, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` to ``(node, component)``, component = smallest id reachable.

    Every node points at a parent; a round hooks each node and its parent onto
    the smallest grandparent among the neighbours and halves the paths, which
    ends after about log(longest path) rounds. All keys, hubs included, meet in
    joins that adaptive execution splits or in minima that are combined before
    the shuffle. No edges: no rows. Edges with a null end and loops are left out.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    edges = materialize(both)
    state = materialize(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("f")))
    for _ in range(max_rounds):
        parent = state.select(F.col("node").alias("f"), F.col("f").alias("gf"))
        grand = materialize(state.join(parent, "f").select("node", "f", "gf"))
        near = (
            edges.join(grand.select(F.col("node").alias("dst"), "gf"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("gf").alias("low"))
        )
        known = grand.join(near, "node", "left").withColumn("low", F.least("gf", "low"))
        old, state = state, materialize(
            known.select(F.explode(F.array(
                F.struct(F.col("node"), F.col("low"), F.col("f").alias("old")),
                F.struct(F.col("f").alias("node"), F.col("low"), F.lit(None).cast("long").alias("old")),
            )).alias("x"))
            .select("x.*")
            .groupBy("node")
            .agg(F.min("low").alias("f"), F.max("old").alias("old"))
        )
        discard(old, grand)
        if state.where("f < old").isEmpty():
            discard(edges)
            found = state.select("node", F.col("f").alias("component"))
            found.written_to = state.written_to
            return found
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
