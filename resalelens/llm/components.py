"""Connected components of a graph by repeated contraction.

Every node looks at itself and its neighbours and points to the one with the smallest
hash, and then to where that one points; edges are drawn between the nodes pointed to.
Two rounds contract a star or clique, and each contracts long paths by a constant factor,
so the number of rounds grows with the logarithm of the longest path. A node of any degree
is one aggregate with partial sums and one join on a key that is unique on the other side.
Each round's tables are written to the shared folder, so a lost executor costs one round
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from resalelens.operators.storage import is_small, written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``, whole numbers); the
    component is a node of it that all its nodes share. No edges give no rows."""
    left = _clean(edges)
    where = None
    turn = 0
    while True:
        left = written(left, f"edges-{turn}")
        if is_small(left, 0):
            break
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("node"))
        once = both.groupBy("a").agg(F.min(rank("b")).alias("_best")).select(
            F.col("a").alias("node"), F.least(F.col("_best"), rank("a"))["node"].alias("to"))
        once = written(once, f"first-points-{turn}")
        twice = once.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        points = written(once.join(twice, "to").select("node", F.col("_next").alias("to")), f"points-{turn}")
        if where is None:
            where = points.select("node", F.col("to").alias("component"))
        else:
            step = points.select(F.col("node").alias("component"), "to")
            where = written(
                where.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")),
                f"where-{turn}")
        of = lambda c: points.select(F.col("node").alias(c), F.col("to").alias(f"_{c}"))
        left = _clean(left.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        turn += 1
    return where if where is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _clean(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return edges.filter(F.col("a") != F.col("b")).select(low.alias("a"), high.alias("b")).distinct()
