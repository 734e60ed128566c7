"""Connected components over an edge table, by alternating star contractions.

A large-star step links every larger neighbour of a node to the smallest node of
its neighbourhood, a small-star step does the same with the smaller ones; the
edge table shrinks to one star per component in about log(diameter) rounds. Each
round is two aggregations and joins (``min`` is combined before the shuffle, a
hot node's rows can be split by the skew join), and its edges are checkpointed,
so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.llm.skew import apart


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("hi", "lo").unionAll(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(apart(F.col("hi")).alias("key"), F.least("hi", "m").alias("m"))
    return (both.withColumn("key", apart(F.col("hi"))).join(least, "key").filter(F.col("lo") > F.col("hi"))
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    keyed = least.select(apart(F.col("hi")).alias("key"), "m")
    moved = (edges.withColumn("key", apart(F.col("hi"))).join(keyed, "key").filter(F.col("lo") != F.col("m"))
             .select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: ``edges`` has two long columns,
    root is the smallest node of the component. No edges: no rows."""
    a, b = edges.columns
    edges = (edges.filter(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct().checkpoint())
    mark = _mark(edges)
    while mark[0]:
        edges = _small_star(_large_star(edges)).checkpoint()
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionAll(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _mark(edges: DataFrame):
    """Count and hash sum of the edges: equal marks mean that nothing moved."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
