"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node (larger ones, or smaller ones and itself) to the least of all its neighbours."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # In small-star rounds every u exceeds its v, so the neighbours at hand are the smaller ones.
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(least, "u")
    if large:
        out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) -> u, root: every node that has an edge to another, with the least node of its component.

    Each round is a few aggregates and joins over the edges and ends in a written table; the number of rounds grows with
    the logarithm of the longest chain. Node sums decide when nothing changes.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .filter("u != v").distinct(), "edges")
    mark = None
    while True:
        now = written(_star(_star(now, large=True), large=False), "edges")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == mark:
            return now.select("u", F.col("v").alias("root"))
        mark = (row[0], row[1])
