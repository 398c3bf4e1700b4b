"""Connected components of an edge table, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b); the component is its smallest node.

    Alternating large-star and small-star rounds: each rewrites the edges toward smaller nodes, and the rounds needed grow
    as the logarithm of the component's size. Only minima are aggregated by node, with a map-side combine, so a hub is never a
    collected list; a hub's edges meet its minimum in a join that AQE can split. Each round is written to the shared folder, and
    the one before removed. Repeated edges and loops count once and not at all, edges with a null end are left out, and without
    edges there are no rows.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    signature = None
    while True:
        # large star: larger neighbours of each node go to its smallest neighbour
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        # small star: smaller neighbours of each node, and the node, go to the smallest of them
        large = materialize(large, "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()
        before, now = now, materialize(small, "small-star")
        discard(before, large)
        after = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if (after.n, after.h) == signature:
            break
        signature = (after.n, after.h)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
