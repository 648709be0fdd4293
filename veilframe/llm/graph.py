"""Connected components of a link table, without the driver and without a hot node's
neighbours ever meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import materialise

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes of ``links(a, b)``; component is the smallest node.

    Alternating large-star and small-star contraction: every round first hangs each node's
    larger neighbours on its smallest neighbour, then each node's smaller neighbours, and
    ends when all links form stars. Minima are partial aggregates and the joins are plain
    equi-joins, which adaptive execution can split, so a star centre is no hot spot. Links
    are cut from their lineage each round by a reliable checkpoint. Null nodes and loops are
    ignored; no links give an empty table.
    """
    edges = materialise(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        edges = materialise(_small_star(_large_star(edges)))
        after = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                      .first())
        if after == before:
            stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            centres = stars.select(F.col("component").alias("node"), "component").distinct()
            return stars.unionByName(centres)
        before = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than its node goes to the smallest of node and neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("w"), F.least("u", "m").alias("m"))
    larger = both.filter("v > u")
    return (larger.join(low, larger["u"] == low["w"])
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest of these neighbours."""
    low = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("w"), "m")
    joined = edges.join(low, edges["a"] == low["w"])
    return (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select(F.col("w").alias("a"), F.col("m").alias("b")))
            .filter("a <> b").distinct())
