"""Connected components by alternating large and small stars, written to the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, remove


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Does every edge (u, v) lead from a leaf with no other edge to a root?"""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("u").alias("node"), one.alias("up"), none.alias("down")).unionByName(edges.select(F.col("v").alias("node"), none.alias("up"), one.alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").count() == 0


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    pairs = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
    small = pairs.select("u", F.col("m").alias("v")).unionByName(pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return small.distinct()


def components(links: DataFrame) -> DataFrame:
    """links(u, v), either way round and repeated at will, as (node, root): each node that has a link, and the least node of its component.

    A round replaces the neighbours' edges of every node by edges to the least of them; both steps are
    an aggregate with partial sums and a join whose hot side adaptive execution splits. Rows with a null
    end and links of a node to itself are left out.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_forest_of_stars(edges):
        after = materialize(_round(edges), "edges")
        remove(edges.sparkSession, edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
