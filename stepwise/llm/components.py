"""Connected components of an edge table, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage


def _follow(rows: DataFrame, column: str, step: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its parent in ``step`` (node, parent), where it has one."""
    to = step.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    out = rows.join(to, rows[column] == F.col("_node"), "left")
    return out.withColumn(column, F.coalesce("_parent", column)).drop("_node", "_parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (src, dst: long); root is its component's smallest node.

    Distributed union-find.  In a round every node hooks onto its smallest
    neighbour, two pointer jumps shorten the chains, and the edges are rewritten
    to the new roots; loops and repeats go.  A node stays a root only if all its
    neighbours are larger, so each round at least halves the nodes that still
    have edges.  Minima are pre-aggregated before each shuffle, and every table
    is staged, so that no join inherits a layout by a hot root.  Loops and null
    ends are ignored; an empty table gives an empty result.
    """
    live = stage(
        edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(),
        "edges",
    )
    labels = None
    while True:
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(live.select("b", "a"))
        hook = ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent"))
        hook = stage(hook, "hook")
        for _ in range(2):
            hook = stage(_follow(hook, "parent", hook), "jump")
        labels = hook if labels is None else stage(_follow(labels, "parent", hook), "labels")
        live = _follow(_follow(live, "a", hook), "b", hook).where("a <> b")
        live = stage(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if live.isEmpty():
            return labels.select("node", F.col("parent").alias("root"))


def extended_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (node, root: of ``connected_components``) with further ``edges`` (src, dst): only what these join is worked through."""
    to = lambda c, end: roots.select(F.col("node").alias(c), F.col("root").alias(end))
    ends = edges.join(to("src", "a"), "src", "left").join(to("dst", "b"), "dst", "left")
    joined = connected_components(ends.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")))
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stage(old.unionByName(joined.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")
