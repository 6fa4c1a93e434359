"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, written_at


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root): every node of the edges and the smallest node it reaches.

    Large-star hangs a node's larger neighbours on its smallest one,
    small-star the smaller ones; after O(log^2 n) rounds every node hangs on
    its root.  Minima are combined before the shuffle, and edges are joined to
    one row per node, so a hub's edges may be split.  Each round is written to
    the shared folder.  Nodes are non-null longs; loops are ignored; an empty
    table gives an empty one.
    """
    e = edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).filter("u < v").distinct()
    spark = edges.sparkSession
    e, path = written_at(e, "components")
    before = None
    while before != (now := _state(e)) and now[0]:
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        # here u < v: seen from v, its smaller neighbours u
        least = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), "m")
        small = large.join(least, F.col("v") == F.col("w"))
        old = path
        e, path = written_at(small.select(F.col("m").alias("u"), F.col("u").alias("v")).filter("u < v")
                             .union(least.select(F.col("m").alias("u"), F.col("w").alias("v"))).distinct(), "components")
        delete_path(spark, old)
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.select("u", "u").distinct())
