"""Connected components by alternating large-star and small-star steps.

Edges live in a distributed table; each round is two shuffles on node ids with
partial sums of minima, and lineage is cut in the shared checkpoint folder. Stars
are built with a minimum per node joined back to the edges, never by gathering a
node's neighbours in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _minimum_star(e: DataFrame, by: str) -> DataFrame:
    """Edges (u, v): link every neighbour of ``by`` to the smallest of the neighbours and itself."""
    least = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
    j = e.join(least, e.u == least.w)
    keep = j.where("v > u") if by == "large" else j
    own = least.select(F.col("w").alias("u"), "m") if by == "small" else None
    out = keep.select(F.col("v").alias("u"), "m")
    return (out if own is None else out.unionByName(own)).where("u <> m").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs -> (node, component): the smallest id that each node reaches.

    Nodes without edges don't appear. Raises if ``rounds`` do not suffice.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minimum_star(both, "large").select(F.greatest("u", "m").alias("u"), F.least("u", "m").alias("v"))
        small = _minimum_star(large, "small").select(F.greatest("u", "m").alias("u"), F.least("u", "m").alias("v")).distinct()
        e = cut_lineage(small)
        now = tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            # A forest of stars: each node's only smaller neighbour is its component.
            leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle within {rounds} rounds")
