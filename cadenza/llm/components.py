"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum and a join back; each round's edges are written to the shared folder. A node with very
many edges is met by partial aggregation and by Spark's splitting of skewed joins, never by gathering its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, materialize


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), apart("u").alias("key"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both)
    return both.join(low, apart("u") == F.col("key")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    to_low = down.join(low, apart("u") == F.col("key")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_low.union(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node of its component) for every node that an edge of ``edges`` (u, v bigint) touches.

    Loops, repeated edges and edges with a null are as if absent. Raises when ``most_rounds`` don't settle it; rounds grow
    with the logarithm of the longest path.
    """
    now = materialize(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign["n"] == 0 or sign == seen:
            pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return pairs.union(pairs.select(F.col("component").alias("node"), "component")).distinct()
        seen = sign
        now = materialize(_small_star(_large_star(now)), "edges")
    raise RuntimeError("components did not settle")
