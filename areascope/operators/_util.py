"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dimension / lookup tables broadcast to every task must stay below this.
MAX_BROADCAST_ROWS = 100_000
# Tasks over which one group's rows are spread where they must be shuffled by group.
SALTS = 32


def fingerprint(*cols: str) -> Column:
    """128 bits of the columns' values: two hashes over the values in either order, with other beginnings.

    Missing values are marked, so that a null in one column is not one in the next. Equal values have equal
    fingerprints; n different ones share one with a chance of about n * n / 2 ** 129 (1e-15 for 1e12 rows).
    """
    cells = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    return F.struct(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit("other"), *reversed(cells)).alias("b"))


def evaluate_once(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed once a row, however often later steps refer to them.

    A filter on a parsed column is otherwise moved below it and parses each row again, once for every mention. No
    filter is moved below a row number; the number itself is dropped. A stream knows no row numbers and stays as it is.
    """
    if df.isStreaming:
        return df
    return df.withColumn("_row", F.monotonically_increasing_id()).filter(F.col("_row") >= 0).drop("_row")


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a lookup table whose size is checked first.

    The check reads at most ``max_rows + 1`` rows. A larger table is returned
    unhinted: the join then shuffles and AQE handles skew.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def attach_groups(df: DataFrame, groups: DataFrame, by, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Left join of ``groups`` (one row for each value of ``by``) to every row of ``df``.

    Up to ``max_rows`` groups are broadcast and rows stay where they are. Beyond
    that both sides meet on the key and a salt drawn from the row's content, so
    a group with a third of all rows is spread over ``SALTS`` tasks.
    """
    by = list(by)
    if groups.limit(max_rows + 1).count() <= max_rows:
        return df.join(F.broadcast(groups), by, "left")
    rest = [c for c in df.columns if c not in by]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(SALTS)))
    each = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(each, [*by, "_salt"], "left").drop("_salt")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate (exactly one row, no grouping
    keys) to every row of ``df``: a scalar broadcast, each row meets one row,
    no pairs are emitted."""
    return df.crossJoin(F.broadcast(one_row))
