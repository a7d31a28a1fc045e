"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.plans.lineage import cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is linked to the least of u and u's neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and u's smaller neighbours are linked to the least of those neighbours; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reached.

    Minima are combined before the shuffle, so that a node with very many neighbours costs one row a
    task; each round is cut by a table in the shared folder, and two rounds without change end the
    loop. Null ends and self links are ignored; no edges give no rows. Raises when `max_rounds` are
    not enough.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        # two independent 64-bit sums of the edges, which are distinct: equal for equal sets of edges only
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(2), "v", "u"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        step = cut(_small_star(_large_star(e)).distinct(), "edges")
        drop(e)
        e = step
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
