"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node of its component) for the nodes of edges (a, b).

    Each round writes its edges to the shared folder, which cuts lineage; the number of rounds grows with the
    logarithm of the longest path. Loops, repeated edges and no edges at all are fine.
    """
    at = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    sign = None
    while True:
        both = at.union(at.select("v", "u"))
        # written first: a join of two tables, of which Spark can split a hub's rows
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = materialize(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        now = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == sign:
            return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select("v", "v")).distinct()
        sign = now
