"""Connected components of a link table by alternating star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.llm.common import staged


def _settled(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is itself a u: then all components are stars around their smallest id."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    found = ends.groupBy("u").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 or down = 1 and up > 0")
    return found.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) of ids -> (u, v) with v the smallest id reachable from u, for every u that is not itself the smallest.

    Each round points all larger neighbours of a node to the smallest one, then
    all smaller ones; it ends when only stars are left. Nothing but that answer
    reaches the driver. Self links and repeats are ignored.
    """
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _settled(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(pair).alias("e")).select("e.*").where("u <> v").distinct()
        edges = staged(small, "edges")
    return edges
