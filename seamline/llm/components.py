"""Connected components of a table of links, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.plans.staging import stage


def _directed(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _toward_least(neighbours: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them and the node itself.

    ``larger``: only neighbours larger than the node are moved, else the smaller ones
    and the node itself.  The least is a sum made before shuffling, and rows of a node
    with many neighbours can be split in the join.
    """
    if not larger:
        neighbours = neighbours.filter("b < a")
    least = neighbours.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = neighbours.filter("b > a") if larger else neighbours
    linked = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        linked = linked.union(least.select("a", F.col("m").alias("b")))
    return linked.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the least node names it.

    Each round replaces links by links to smaller nodes; after a number of rounds
    logarithmic in the longest chain all links are stars.  Rounds are stored, so that a
    lost executor repeats little.  Without links the result is empty.
    """
    stars = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = stars.filter("a <> b").distinct()
    while True:
        large = _toward_least(_directed(stars), larger=True)
        stars = stage(_toward_least(large, larger=False), "stars")
        # All stars: a node has one link at most, and none if others link to it.
        centres = stars.select(F.col("b").alias("a"), F.lit(True).alias("centre")).distinct()
        unfinished = stars.groupBy("a").agg(F.count("*").alias("n")).join(centres, "a", "left")
        if unfinished.filter("n > 1 OR centre").isEmpty():
            break
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())
