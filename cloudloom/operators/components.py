"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.workspace import materialise, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, root)`` for every node of an undirected edge table; root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour (pre-aggregated on the
    map side), follows the hook once more, and contracts the edges; nodes with
    edges at least halve, so the rounds grow with the logarithm of the nodes.
    Every round reads tables in the shared folder, so lineage stays short, and
    deletes those that it supersedes.
    Self-loops keep a node in the result, null ends are dropped, an empty table
    gives an empty table.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = both.select(F.col("a").alias("node")).union(both.select("b")).distinct()
    live = materialise(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not live.isEmpty():
        around = live.union(live.select("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
        hook = materialise(around.select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "hook")
        jump = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = materialise(hook.join(jump, "up").select("node", F.col("top").alias("up")), "step")
        before, labels = labels, step if labels is None else materialise(_follow(labels, step), "labels")
        ends = step.select(F.col("node").alias("a"), F.col("up").alias("a2"))
        old, met = live, live.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("a2").alias("b2")), "b")
        live = met.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        live = materialise(live.distinct(), "edges")
        release(hook, before, old, None if labels is step else step)
    release(live)
    if labels is None:
        return nodes.select("node", F.col("node").alias("root"))
    # a root of a component is its smallest node: hooks only ever point to smaller nodes
    return nodes.join(labels, "node", "left").select("node", F.coalesce("up", "node").alias("root"))


def _follow(labels: DataFrame, step: DataFrame) -> DataFrame:
    """Move every label one contraction further; labels whose component is complete stay."""
    move = step.select(F.col("node").alias("up"), F.col("up").alias("next"))
    return labels.join(move, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
