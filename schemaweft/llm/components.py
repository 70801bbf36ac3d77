"""Connected components by alternating large and small stars.

Every round is a few aggregations and joins on edges; a node of any degree is pre-aggregated
map-side, and its edges are joined back by a plain join, whose hot keys Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweft.llm.common import settle


def _toward_least(edges: DataFrame) -> DataFrame:
    """u, v, m: the least neighbour of u (or u itself) beside each edge from u."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    stars = _toward_least(both).filter(F.col("v") > F.col("u"))
    return stars.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _toward_least(down)
    moved = stars.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """u, v (bigint) -> node, component: the least node that is reachable, for all linked nodes.

    Repeated links, links both ways and loops do no harm; no links give no rows.
    """
    edges, seen = settle(links.filter("u <> v").select("u", "v").distinct()), None
    while True:
        edges = settle(_large_star(settle(_small_star(edges))))
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
