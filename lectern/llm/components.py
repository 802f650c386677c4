"""Connected components of a graph given by its links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.session import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for links ``a, b`` of any ordered type; the component is its least node.

    Each round links larger neighbours to the least neighbour, then smaller ones, until no
    link changes. Minima are aggregated before they are shuffled, and rounds are stored in
    the shared folder, so lost executors read them again. No links give no rows.
    """
    edges = cut_lineage(links.select("a", "b").filter("a <> b").distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = cut_lineage(small.filter("a <> b").distinct())
        moved = new.join(edges, ["a", "b"], "left_anti").limit(1).count() + edges.join(new, ["a", "b"], "left_anti").limit(1).count()
        edges = new
        if not moved:
            break
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
