"""Connected components by alternating large-star and small-star steps (log-many rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neume.storage import drop, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the smallest member of the node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node is tied to one smaller node only, and that one to none."""
    per_node = edges.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    if not per_node.where("low <> high or low > a").isEmpty():
        return False
    return edges.select("b").join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge list; component is the smallest node reached.

    Edges may repeat, run either way or loop.  Null ends are dropped.  Each round is written to the
    shared folder, so that a lost executor costs one round and the plan stays short.  Hubs are
    met by partial aggregation (minimum) and by a join whose hub partition AQE can split.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes_alone = pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    state = materialize(pairs.where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        if _is_star_forest(state):
            break
        after = materialize(_small_star(_large_star(state)), "edges")
        drop(state)
        state = after
    else:
        raise RuntimeError("components did not settle")
    found = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return found.unionByName(roots).unionByName(nodes_alone).groupBy("node").agg(F.min("component").alias("component"))
