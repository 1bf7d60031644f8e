"""Connected components as Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.base import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b: long): root is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour if that is smaller, shortens the chains so made by doubling, and draws the edges anew
    between the chains' ends; edges within a chain vanish. Every edge's larger end is hooked, so each round at least halves the nodes that still
    have edges. Each table is written to the shared folder, so no lineage grows and lost executors cost no more than a stage.
    """
    # both directions from one reading of the edges: read twice, they could differ, and an edge known from one end only would never go
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(edges.filter("a != b").select(F.explode(ends).alias("e")).select("e.*").distinct(), "edges")
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    left, rounds = both.limit(1).count(), 0
    while left:
        hooks = stored(both.groupBy("a").agg(F.min("b").alias("b")).filter("b < a"), "hooks")
        while True:
            nxt = hooks.selectExpr("a as b", "b as c")
            longer = stored(hooks.join(nxt, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "hooks")
            moved = longer.filter("moved").limit(1).count()
            forget(hooks)
            hooks = longer.select("a", "b")
            if not moved:
                break
        to = hooks.selectExpr("a as root", "b as top")
        new_labels = stored(labels.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        left_end = hooks.selectExpr("a", "b as top_a")
        right_end = hooks.selectExpr("a as b", "b as top_b")
        drawn = both.join(left_end, "a", "left").join(right_end, "b", "left").select(F.coalesce("top_a", "a").alias("a"), F.coalesce("top_b", "b").alias("b"))
        new_both = stored(drawn.filter("a != b").distinct(), "edges")
        left = new_both.limit(1).count()
        forget(hooks)
        forget(both)
        if rounds:
            forget(labels)
        labels, both, rounds = new_labels, new_both, rounds + 1
    return labels if rounds else stored(labels, "labels")
