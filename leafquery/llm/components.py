"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafquery.functions.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest node around u."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.filter("b > a").join(stage(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them; a > b in every edge."""
    least = stage(edges.groupBy("a").agg(F.min("b").alias("m")))
    return (edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).distinct())


def components(links: DataFrame) -> DataFrame:
    """(id, component): each linked id with the smallest id it reaches; ``links`` has long a, b.

    Each step keeps no more edges than it got, groups are only reduced to minima before they are
    shuffled, and each round is written to the shared folder, so its length doesn't add to the plan.
    """
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        edges = stage(_small_star(stage(_large_star(edges))))
    return (edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .union(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct())


def extend(known: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links behind ``known`` and of ``links``: only components that meet are joined anew."""
    pairs = links.filter("a <> b")
    for side in ("a", "b"):
        own = known.select(F.col("id").alias(side), F.col("component").alias(f"_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    pairs = stage(pairs)
    meet = pairs.select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b")
    if meet.isEmpty():
        return known
    lower = stage(components(meet)).select(F.col("id").alias("component"), F.col("component").alias("low"))
    # nodes that no link had before are components of their own
    nodes = known.union(pairs.select("a", "_a")).union(pairs.select("b", "_b")).distinct()
    return nodes.join(lower, "component", "left").select("id", F.coalesce("low", "component").alias("component"))
