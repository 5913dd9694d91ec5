"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a minimum by node and a join, so a node with very many links is spread like any other
skewed key; each round is written to the shared folder.  Nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbours and itself."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return around.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def near_components(links: DataFrame) -> DataFrame:
    """(node, component) after one round: nodes of one component are connected, those of two may be too."""
    edges = _small_star(_large_star(links.select("a", "b").filter("a <> b").distinct()).distinct())
    stars = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()).groupBy("node").agg(F.min("component").alias("component"))


def connected_components(links: DataFrame, path: str) -> DataFrame:
    """(node, component) of every node of links (a, b), whose types can be ordered; component is its least node.

    Links of a node to itself and repeated links are allowed; null ends are not.
    """
    edges = written(links.select("a", "b").filter("a <> b").distinct(), f"{path}/round0")
    before, n = None, 0
    spark = links.sparkSession
    while True:
        n += 1
        if n > 1:
            remove(spark, f"{path}/round{n - 2}")
        edges = written(_small_star(_large_star(edges).distinct()).distinct(), f"{path}/round{n}")
        # done when every edge is a star's: equal edges give equal sums
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
