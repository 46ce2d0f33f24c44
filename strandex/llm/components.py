"""Distributed union-find: connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandex.llm.common import cut, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _state(edges: DataFrame) -> tuple:
    mix = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mix), F.sum(mix.bitwiseAND(0xFFFFFFFF))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has an edge in ``edges(a, b)``; root is the least node of the component.

    Each step keeps at most as many edges as it was given, sums are taken before they are shuffled, and a node with
    many neighbours only meets them in joins that adaptive execution splits. Loops and repeated edges are allowed;
    an edge with a null end is ignored. The driver sees three numbers a step.
    """
    now = cut(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    was, state = None, _state(now)
    while state[0] and state != was:
        now = cut(_small_star(_large_star(now)))
        release(now.sparkSession)
        was, state = state, _state(now)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
