"""Connected components of an edge table, distributed: no link or component ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): the smallest node reachable from each node that has a link.

    Alternates large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014) until the links stop changing: each round points every node's larger (then smaller)
    neighbours at the smallest neighbour. Rounds grow with the logarithm of the longest path, the number of
    links never grows, and a hub with very many neighbours is only a minimum (pre-aggregated) and a join
    whose skew Spark splits. Null nodes and self links are ignored. Every round is cut to the shared folder.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = cut(e)
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_v"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["_v"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.filter("a <> b").distinct())
        # Small star: a's smaller neighbours, and a itself, point at the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_v"), "m")
        small = large.join(least, large["a"] == least["_v"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(least.select(F.col("_v").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
