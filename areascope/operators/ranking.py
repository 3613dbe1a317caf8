"""Distributed percentile rank with average ties (pandas ``rank(pct=True)``).

A global ``Window.orderBy`` would pull every row into one task. Instead:
count rows per distinct value (partially aggregated, so a value shared by a
third of all rows is one row), range-partition the distinct values, total each
range partition (one number per partition: the only driver-side data), turn
the totals into prefix offsets, and finish with a running sum inside each
range. rank_pct = (rows below + (ties + 1) / 2) / n.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ._util import MAX_BROADCAST_ROWS

# Distinct values of a range, which is the work of one task.
RANGE_VALUES = 250_000


def value_ranks(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """(value, ties, rows_below, rank_pct) for every distinct non-null value."""
    return _ranks(df, col, partitions)[0]


def _ranks(df: DataFrame, col: str, partitions: int | None) -> tuple[DataFrame, int, int]:
    """``value_ranks``, the number of values, and the number of rows without one."""
    spark = df.sparkSession
    every = df.groupBy(col).agg(F.count(F.lit(1)).alias("_ties"))
    if partitions is None:
        every = cut_lineage(every)
        partitions = max(1, -(-every.count() // RANGE_VALUES))
    # Range bounds come from sampling, so the partition ids are pinned by a
    # reliable checkpoint before they are used twice (totals and running sums).
    ranged = cut_lineage(every.repartitionByRange(partitions, col).withColumn("_pid", F.spark_partition_id()))
    known = F.col(col).isNotNull()
    totals = ranged.groupBy("_pid").agg(
        F.sum(F.when(known, F.col("_ties"))).alias("_tot"), F.min(col).alias("_lo"), F.count_if(known).alias("_values"),
        F.coalesce(F.sum(F.when(~known, F.col("_ties"))), F.lit(0)).alias("_missing")).collect()
    missing = sum(int(r["_missing"]) for r in totals)
    totals = sorted((r for r in totals if r["_values"]), key=lambda r: r["_lo"])
    ranged = ranged.filter(known)
    offsets = [0] + list(accumulate(int(r["_tot"]) for r in totals))
    n = offsets[-1]
    off_df = spark.createDataFrame([(int(r["_pid"]), offsets[i]) for i, r in enumerate(totals)],
                                   "_pid int, _offset long")
    w = Window.partitionBy("_pid").orderBy(col)
    within = ranged.withColumn("_below_in", F.coalesce(
        F.sum("_ties").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = within.join(F.broadcast(off_df), "_pid")  # one row per range partition
    out = out.withColumn("rows_below", F.col("_offset") + F.col("_below_in"))
    out = out.select(col, F.col("_ties").alias("ties"), "rows_below",
                     ((F.col("rows_below") + (F.col("_ties") + 1) / 2.0) / F.lit(float(max(n, 1))))
                     .alias("rank_pct"))
    return out, sum(int(r["_values"]) for r in totals), missing


def rank_pct(df: DataFrame, col: str, out: str = "rank_pct", partitions: int | None = None) -> DataFrame:
    """Attach the average-tie percentile rank of ``col`` to every row.

    Up to ``MAX_BROADCAST_ROWS`` values are broadcast and rows stay where they are; more are joined on the value.
    Null stays null: such rows need no rank and stay out of that join, where they would all meet in one task.
    """
    ranks, values, missing = _ranks(df, col, partitions)
    ranks = ranks.select(col, F.col("rank_pct").alias(out))
    if values <= MAX_BROADCAST_ROWS:
        return df.join(F.broadcast(ranks), col, "left")
    if not missing:
        return df.join(ranks, col, "left")
    known = df.filter(F.col(col).isNotNull()).join(ranks, col, "left")
    return known.unionByName(df.filter(F.col(col).isNull()).withColumn(out, F.lit(None).cast("double")))
