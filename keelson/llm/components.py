"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.session import materialise


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable, for every node of (u, v) but the roots.

    Each round points nodes at smaller neighbours and writes the links; it ends when a round changes
    nothing.  Minima are partial aggregates and the joins are on the node, one row on one side, so a
    node with very many links is split by AQE.
    """
    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        return r[0], r[1]

    edges = materialise(edges.filter("u <> v").select("u", "v").distinct())
    seen = mark(edges)
    while True:
        edges = materialise(_small(_large(edges).distinct()).distinct())
        now = mark(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
