"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours link to its smallest one (or itself)."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours link to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: each v is then the smallest node of its component."""
    end = lambda name, below: F.struct(F.col(name).alias("node"), F.lit(below).alias("below"), F.lit(1 - below).alias("above"))
    nodes = edges.select(F.inline(F.array(end("u", 1), end("v", 0)))).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not nodes.where("below > 1 OR below > 0 AND above > 0").take(1)


def components(edges: DataFrame) -> DataFrame:
    """u, v with v the smallest node that u reaches, for every node u that has a smaller one in reach.

    edges has columns u and v in any order; loops and repeats do no harm. Rounds, about the logarithm of
    the longest chain, end when the edges are stars; each is written to the checkpoint folder, and no
    node's neighbours are gathered in one row.
    """
    edges = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(edges):
        edges = cut(_small_star(_large_star(edges)))
    return edges


def extended(stars: DataFrame, links: DataFrame) -> DataFrame:
    """The components of stars, as components() gives them, and more links."""
    return components(stars.unionByName(links.select("u", "v"))) if links.take(1) else stars
