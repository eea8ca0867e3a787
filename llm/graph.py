"""Union of linked nodes in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of these. Edges go from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node without any."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return not seen.where("out > 1 or out = 1 and least = 0").head(1)


def components(links: DataFrame) -> DataFrame:
    """links: pairs a, b of long node numbers. Returns node, root for every node of a link that isn't the smallest of its
    component; root is the smallest. No links: no rows.

    Large and small stars by turns, until all edges lead to roots; the rounds grow with the logarithm of the longest chain.
    Minima are taken before rows are dealt out, and only joins bring a node's neighbours together, which Spark can split."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _settled(edges):
        following = stored(_small_star(_large_star(edges)), "edges")
        discard(edges)
        edges = following
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
