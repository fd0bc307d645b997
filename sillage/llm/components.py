"""Connected components of a graph given as an edge table; nothing of it reaches the driver but whether a table is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillage.llm.common import forget, stored


def _rooted(now: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b): each points to the least of itself and its neighbours, and that pointer is
    followed to its end by doubling, so a path of n pointers takes about log2(n) joins."""
    both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    to = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "pointers")
    while True:
        # Roots point to themselves; only nodes whose pointer isn't a root yet move on.
        beyond = stored(to.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next")).join(to.where("node <> root").select("root").distinct(), "root", "left_semi"), "beyond")
        if beyond.isEmpty():
            forget(beyond)
            return to
        last, to = to, stored(to.join(beyond, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "pointers")
        forget(last, beyond)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b).

    Each round gives every node a root (see _rooted) and contracts the edges by that. A tree that still has an edge holds two nodes
    at least, so that rounds halve what is left whatever the order of ids; a chain of ascending ids takes one round. Edges to
    itself or with a null end are ignored; an empty table gives an empty result. Every step is stored, so a lost executor costs one step.
    """
    now = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    levels: list[DataFrame] = []
    while not now.isEmpty():
        to = _rooted(now)
        levels.append(to)
        left, right = to.select(F.col("node").alias("a"), F.col("root").alias("p")), to.select(F.col("node").alias("b"), F.col("root").alias("q"))
        later = now.join(left, "a").join(right, "b").where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        last, now = now, stored(later, "edges")
        forget(last)
    if not levels:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    forget(now)
    # Nodes of a level are roots of the one before; the last level's roots are the components.
    mapping = levels.pop()
    while levels:
        before, last = levels.pop(), mapping
        above = last.select(F.col("node").alias("root"), F.col("root").alias("top"))
        mapping = stored(before.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "pointers")
        forget(before, last)
    named = mapping.withColumnRenamed("root", "component")
    named.stored_at = mapping.stored_at  # type: ignore[attr-defined]
    return named
