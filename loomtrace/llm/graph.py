"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) for the nodes of ``edges(a, b)``.

    Each round links every node's larger neighbours to the smallest node it knows
    (large star), then its smaller neighbours likewise (small star); edges never grow in
    number and rounds grow with the logarithm of a component.  Every round is cut off
    with a checkpoint, so a lost executor costs one round.  Minima are partial
    aggregates: a hub's neighbours are never gathered.  Null nodes are dropped, loops
    and repeated edges do nothing, no edges give no rows.
    """
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        before = _state(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = checkpoint(small.where("u <> v").distinct())
        if _state(edges) == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
