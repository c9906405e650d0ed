"""Distributed connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of an undirected graph given as ``(a, b)`` longs.

    Returns ``(id, root)`` for each vertex that has an edge, where root is a
    vertex of the same component.  Every round hooks each vertex onto its
    least neighbour, shortens the chains and rewrites the edges between the
    roots that remain, so the vertices left at least halve and the number of
    rounds is logarithmic.  Each round is written; nothing comes to the
    driver but counts.  Self loops and repeated edges are harmless, no edges
    give no rows.
    """
    live = scratch.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    found = None
    while live.count():
        both = live.select("a", "b").union(live.select(F.col("b"), F.col("a")))
        hook = scratch.table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("up")), "hook")
        for _ in range(2):
            above = hook.select(F.col("id").alias("up"), F.col("up").alias("top"))
            hook_next = scratch.table(hook.join(above, "up").select("id", F.col("top").alias("up")), "hook")
            scratch.drop(hook)
            hook = hook_next
        end_a = hook.select(F.col("id").alias("a"), F.col("up").alias("ra"))
        end_b = hook.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        rest = live.join(end_a, "a").join(end_b, "b").where("ra <> rb")
        rest = scratch.table(rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if found is None:
            new = hook.select("id", F.col("up").alias("root"))
        else:
            moved = found.join(hook.select(F.col("id").alias("root"), "up"), "root", "left")
            new = scratch.table(moved.select("id", F.coalesce("up", "root").alias("root")), "found")
            scratch.drop(found, hook)
        if found is None:
            new._wordloom_at = hook._wordloom_at
        found = new
        scratch.drop(live)
        live = rest
    return found if found is not None else live.select(F.col("a").alias("id"), F.col("b").alias("root"))
