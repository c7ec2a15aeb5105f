"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captext.session import cut


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """One row (node, component) per node of an edge, component the smallest node reachable.

    Each round points the larger neighbours of a node at its smallest neighbour
    (large star), then a node and its smaller neighbours at the smallest of them
    (small star). Minima are pre-aggregated before the shuffle and rounds are cut
    by checkpoints. Edges with a null end and loops are ignored; an empty table
    gives an empty one. Raises RuntimeError if `rounds` don't suffice.
    """
    u, v = F.col("u"), F.col("v")
    step = cut(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(rounds):
        both = step.select("u", "v").union(step.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(u != v)
            .distinct()
        )
        step = cut(small)
        # The star is stable once a round leaves the set of edges as it was.
        now = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = step.select(v.alias("node"), v.alias("component")).distinct()
            return step.select(u.alias("node"), v.alias("component")).union(roots)
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
