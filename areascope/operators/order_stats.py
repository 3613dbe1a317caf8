"""Exact order statistics of many columns and groups at once (A4, P12, F9, A17, A39, ML8).

One scan counts how often each value of each column occurs in each group; equal
values are combined before the shuffle, so a value shared by a third of all
rows is one row. The counted values are dealt to tasks by range, every range's
total gives the ranks at which it begins, and a wanted rank is looked up only
in the range that holds it. No task holds a group's value map, nothing is
sketched, and only figures per range are combined.

Values are doubles; null and NaN are missing. Positions are those of linear
interpolation: ``p * (n - 1)`` between the two neighbouring values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Counted values of a range, which is the work of one task.
RANGE_VALUES = 250_000


def value_counts(df: DataFrame, cols: dict | Sequence[str], by: Sequence[str] = (), missing: bool = True) -> DataFrame:
    """``by``, column, value, n: rows with each value of each column, missing values as null; one scan, lineage cut.

    ``cols``: names, or name -> Column. Without ``missing`` they are left out before they are counted.
    """
    cols = cols if isinstance(cols, dict) else {c: F.col(c) for c in cols}

    def value(c: Column) -> Column:
        x = c.cast("double")
        return F.when(~F.isnan(x), x)

    cells = F.array(*[F.struct(F.lit(name).alias("column"), value(c).alias("value")) for name, c in cols.items()])
    cells = df.select(*by, F.explode(cells).alias("_cell")).select(*by, "_cell.column", "_cell.value")
    if not missing:
        cells = cells.filter(F.col("value").isNotNull())
    return cut_lineage(cells.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n")))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null equal to null, keeping the left keys."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_right_{k}" for k in keys])


def counted_quantiles(counts: DataFrame, probs: Sequence[float], by: Sequence[str] = (),
                      range_values: int = RANGE_VALUES) -> DataFrame:
    """``by``, column, q (array<double> in the order of ``probs``) of every group with a value, from ``value_counts``."""
    keys = [*by, "column"]
    known = counts.filter(F.col("value").isNotNull())
    ranges = max(1, -(-known.count() // range_values))
    if ranges == 1:
        known = known.withColumn("_range", F.lit(0))
    else:
        # Range bounds are sampled: the ranges are pinned before they are used twice.
        known = cut_lineage(known.repartitionByRange(ranges, *keys, "value").withColumn("_range", F.spark_partition_id()))
    totals = known.groupBy(*keys, "_range").agg(F.sum("n").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(totals.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0))))

    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    wanted = (starts.groupBy(*keys).agg(F.sum("_total").alias("_n")).select(*keys, "_n", F.explode(at).alias("_at"))
              .select(*keys, F.col("_at.i").alias("_i"), (F.col("_at.p") * (F.col("_n") - 1)).alias("_place"))
              .withColumns({"_low": F.floor("_place"), "_high": F.ceil("_place")}))
    ranks = wanted.select(*keys, F.explode(F.array("_low", "_high")).alias("_rank")).distinct()
    held = _same(starts, ranks, keys).filter("_rank >= _start and _rank < _start + _total")
    held = held.groupBy(*keys, "_range", "_start").agg(F.collect_set("_rank").alias("_ranks"))
    inside = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    values = (_same(known, held, [*keys, "_range"])
              .withColumn("_below", F.col("_start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
              .select(*keys, "value", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_below"))
                                                         & (r < F.col("_below") + F.col("n")))).alias("_rank")))
    out = _same(wanted, values.withColumnsRenamed({"value": "_a", "_rank": "_low"}), [*keys, "_low"])
    out = _same(out, values.withColumnsRenamed({"value": "_b", "_rank": "_high"}), [*keys, "_high"])
    out = out.withColumn("_q", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_place") - F.col("_low")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"])
    return out.groupBy(*keys).agg(listed.alias("q"))


def quantiles(df: DataFrame, cols: dict | Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by``, column, q: the quantiles ``probs`` of each column in each group."""
    return counted_quantiles(value_counts(df, cols, by, missing=False), probs, by)


def quantile_values(df: DataFrame, cols: dict | Sequence[str], probs: Sequence[float]) -> dict:
    """column -> list of its quantiles over all rows, on the driver; a column without values is left out."""
    return {r["column"]: list(r["q"]) for r in quantiles(df, cols, probs).collect()}
