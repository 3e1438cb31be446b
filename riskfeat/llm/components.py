"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfeat.runtime import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours as ``m``; a hot u is summed before it moves."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b); the root is the least id that links reach.

    Every round ties larger neighbours, then smaller ones, to the least id around (large star, small
    star), until nothing changes.  Only edges are moved, and each round is stored.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(ends, "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        w = _with_least(large)
        small = w.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(w.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
