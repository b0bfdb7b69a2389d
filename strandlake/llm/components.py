"""Distributed connected components of an undirected graph, in DataFrame operations only.

Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014) until every vertex but the least of a group has one edge, to that one. Each step takes the least neighbour of each
vertex, with partial sums before the shuffle, and joins it back to the edges; these joins are plain equi-joins, so a hub with very
many edges is split by adaptive execution. Every round is written to
the shared folder, so lineage stays short and a lost executor repeats one round at most.

Edge cases: no edges give no rows; loops, repeated and reversed edges change nothing; edges with a null end
are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, drop_at_exit, fresh_path, reclaim


def _settled(now: DataFrame) -> bool:
    """Whether the distinct edges (u, v), u > v, are stars: no vertex has two lesser neighbours, or lesser and greater ones."""
    ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """(node, component) of every vertex with an edge; component is its group's least vertex."""
    spark = edges.sparkSession
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u is not null and v is not null and u <> v")
    now, old = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), None
    for _ in range(rounds):
        path = fresh_path(spark, "star")
        # Large star: with the least of u's neighbours and u, m, each larger neighbour v of u is linked to m.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # Small star: u and its smaller neighbours are linked to the least of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        small.filter("u <> v").distinct().write.parquet(path)
        drop_at_exit(spark, path)
        now = spark.read.schema(pairs.schema).parquet(path)
        if old:
            delete(spark, old)
        old = path
        reclaim(spark)
        if _settled(now):
            break
    else:
        raise RuntimeError(f"not settled after {rounds} rounds")
    # Every larger vertex now has one edge, to the least of its group.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
