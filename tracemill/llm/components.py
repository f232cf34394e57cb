"""Connected components by stars: every node ends up joined to the least node of its component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours; combined before the shuffle, so a hub costs no more than others."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("__u"), F.least("u", "m").alias("m")
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that edges (a, b) name, root being the least node of its component.

    Large stars tie each node's larger neighbours to its least one, small stars the smaller ones; both keep the
    components. The edges never grow beyond two for each first edge. Ends when nothing changes; an error if that
    takes more than `rounds` rounds.
    """
    edges = settle(
        edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), F.col("u") == F.col("__u")).filter("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        small = large.join(_least(large), F.col("u") == F.col("__u"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))
        )
        edges = settle(small.filter("u != v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    own = edges.join(roots.select(F.col("node").alias("__n")), F.col("v") == F.col("__n"), "left_anti")
    own = own.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.union(own)
