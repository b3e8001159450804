"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelwise.llm.scratch import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node reached.

    Alternates two contractions until only stars are left: every node hands its larger
    neighbours, then its smaller ones, to the least of them. Rounds grow with the logarithm
    of the longest chain, and links that are stars take none; a node with many neighbours is
    a hot join key, which Spark splits. Links of a node to itself and repeated links are
    harmless; a link with a null end is left out.
    """
    links = settle(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _are_stars(links):
        links = settle(_small_star(settle(_large_star(links))))
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(links.select("v", "v")).groupBy("node").agg(
        F.min("component").alias("component")
    )


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link to a smaller node, or only links to larger ones."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(
        F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select("v", "u"))
    least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.join(least, "u").filter("v > u").select(
        F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = settle(links.groupBy("u").agg(F.min("v").alias("m")))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).filter("u <> v").distinct()
