"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, staged


def contracted(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], drop: Callable[..., None]) -> DataFrame:
    """(node, component): the components of an undirected graph with edges (a, b), a component named by its smallest node.

    Each round every node chooses its smallest neighbour. Along the choices every second node is no larger than the one before
    it, so the only cycles are two nodes that choose each other; the smaller of these is a root. The trees are flattened by
    pointer jumping and contracted to their roots. A tree has two nodes or more, so each round at least halves the nodes that
    have an edge left: n nodes take at most log2(n) rounds of at most log2(n) + 1 jumps whatever the order of the ids, and
    groups of near copies one or two. Edges from a node to itself are left out.

    keep writes a table and reads it back, drop deletes such a table.
    """
    live = keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    marks = None
    while marks is None or live.limit(1).count():
        nearest = keep(live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
        back = nearest.select(F.col("node").alias("parent"), F.col("parent").alias("back"))
        is_root = (F.col("back") == F.col("node")) & (F.col("node") < F.col("parent"))
        forest = keep(nearest.join(back, "parent").select("node", F.when(is_root, F.col("node")).otherwise(F.col("parent")).alias("parent")))
        drop(nearest)
        moved = True
        while moved:
            up = forest.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            after = keep(forest.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
            moved = after.where("moved").limit(1).count() > 0
            drop(forest)
            forest = after
        roots = lambda c: forest.select(F.col("node").alias(c), F.col("parent").alias(f"root_{c}"))
        if marks is None:
            marks = keep(forest.select("node", F.col("parent").alias("root")))
        else:
            further = keep(marks.join(roots("root"), "root", "left").select("node", F.coalesce("root_root", "root").alias("root")))
            drop(marks)
            marks = further
        joined = live.join(roots("a"), "a").join(roots("b"), "b").where("root_a <> root_b")
        fewer = keep(joined.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
        drop(live, forest)
        live = fewer
    names = keep(marks.groupBy("root").agg(F.min("node").alias("component")))
    out = keep(marks.join(names, "root").select("node", "component"))
    drop(live, marks, names)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph of two long columns a and b; tables of a round are written and then deleted."""
    return contracted(edges, lambda df: staged(df, "cc"), discard)
