"""Connected components without collecting any part of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.lineage import kept


def connected_components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has two columns of one orderable type, ``a`` and ``b``. Returns ``node`` and ``root``, the
    smallest node of the component, for every node that has an edge to another one. Rows that hold a null
    and loops are left out, repeated edges count once. Alternating large-star and small-star steps
    (Kiveris and others, 2014) need O(log^2 n) rounds and go on until nothing changes; minima are taken by partial
    aggregates and joined back, so that a hub's edges are never gathered in one task (adaptive execution splits
    the join).
    """
    edges = edges.select(F.col("a").alias("a"), F.col("b").alias("b"))
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = kept(now)
    before = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not sums[0] or before == tuple(sums):
            break
        before = tuple(sums)
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # Large star: every neighbour above u is tied to the smallest node around u.
        big = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: u and its smaller neighbours are tied to the smallest of these.
        low = big.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        tied = big.join(low, big.a == low.u)
        now = kept(tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m")).where("a <> b").distinct())
    stars = now.groupBy("a").agg(F.min("b").alias("root"))
    return stars.select(F.col("a").alias("node"), "root").union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
