"""Data-quality profile of raw feeds.

Every profile is one or two aggregations over a single scan; examples are
bounded (``slice`` of a sorted distinct set) and never collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import parse_date, pincode_region, strip, visible_blanks, whitespace_issue
from ._util import fingerprint, with_scalars
from .order_stats import counted_quantiles, value_counts

PERCENTILES = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def _named(df: DataFrame, cols) -> DataFrame:
    """A row for each column, so that columns of an empty table have one too."""
    return df.sparkSession.createDataFrame([(c,) for c in cols], "column string")


def numeric_profile(df: DataFrame, cols) -> DataFrame:
    """A3 + A4 + A5 + F9: one row per column, all from the counted values of one scan; percentiles are exact."""
    counts = value_counts(df, cols)
    x, n = F.col("value"), F.col("n")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    base = counts.groupBy("column").agg(
        total(x.isNull()).alias("nulls"), F.min(x).alias("min"), F.max(x).alias("max"),
        (F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))).alias("mean"),
        total(x < 0).alias("negatives"), total(x == 0).alias("zeros"),
        (total(x == 0) * 100.0 / F.sum(n)).alias("zero_pct"), total(x > 1000).alias("above_1000"))
    far = (counts.join(F.broadcast(base.select("column", "mean")), "column").groupBy("column").agg(
        F.sqrt(F.sum((x - F.col("mean")) * (x - F.col("mean")) * n)
               / F.nullif(F.sum(F.when(x.isNotNull(), n)) - 1, F.lit(0))).alias("std")))
    q = counted_quantiles(counts, [0.5, *PERCENTILES])
    q = q.select("column", F.col("q")[0].alias("median"),
                 *[F.col("q")[i + 1].alias(f"p{int(p * 100)}") for i, p in enumerate(PERCENTILES)])
    out = _named(df, cols).join(base, "column", "left").join(far, "column", "left").join(q, "column", "left")
    out = out.fillna(0, ["nulls", "negatives", "zeros", "above_1000"])
    return out.select("column", "nulls", "min", "max", "mean", "median", "std", "negatives", "zeros", "zero_pct", "above_1000",
                      *[f"p{int(p * 100)}" for p in PERCENTILES])


def outlier_counts(df: DataFrame, cols) -> DataFrame:
    """rows above each column's exact p95 and p99, from the counted values of one scan."""
    counts = value_counts(df, cols)
    q = counted_quantiles(counts, [0.95, 0.99]).select("column", F.col("q")[0].alias("p95"), F.col("q")[1].alias("p99"))
    above = lambda p: F.sum(F.when(F.col("value") > F.col(p), F.col("n")).otherwise(0))
    out = counts.join(F.broadcast(q), "column").groupBy("column", "p95", "p99").agg(  # q: a row for each column
        above("p95").alias("above_p95"), above("p99").alias("above_p99"))
    return _named(df, cols).join(out, "column", "left").fillna(0, ["above_p95", "above_p99"])


def top_values(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """The k largest distinct values."""
    return df.select(F.col(col).cast("double").alias("value")).distinct().orderBy(F.desc("value")).limit(k)


def coverage(df: DataFrame, cols=("state", "district", "pincode"), approx_rsd: float | None = None) -> DataFrame:
    """Distinct non-null counts (exact; ``approx_rsd`` opts into HyperLogLog++)."""
    if approx_rsd:
        return df.agg(*[F.approx_count_distinct(c, approx_rsd).alias(f"unique_{c}") for c in cols])
    return df.agg(*[F.countDistinct(c).alias(f"unique_{c}") for c in cols])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows (all columns), counted by 128-bit fingerprint: narrow shuffles however wide the rows."""
    g = df.select(fingerprint(*df.columns).alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
                 F.sum(F.col("_n") - 1).alias("duplicate_rows"))


def key_duplicates(df: DataFrame, keys) -> DataFrame:
    """A8 + A9: rows whose key repeats (all copies), groups with >1 rows, and the largest group; by fingerprint."""
    g = df.select(fingerprint(*keys).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("duplicated_rows"),
                 F.count(F.lit(1)).alias("duplicated_groups"),
                 F.max("_n").alias("max_occurrences"))


def column_duplicates(df: DataFrame, cols=None) -> DataFrame:
    """A10: per column, rows whose value occurs more than once (all copies); one scan, cells compared by fingerprint."""
    cols = list(cols or df.columns)
    cells = F.array(*[F.struct(F.lit(i).alias("at"), fingerprint(c).alias("cell")) for i, c in enumerate(cols)])
    often = (df.select(F.explode(cells).alias("x")).groupBy("x.at", "x.cell").agg(F.count(F.lit(1)).alias("n"))
             .filter("n > 1").groupBy("at").agg(F.sum("n").alias("duplicated_rows")))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "at int, column string")
    return names.join(often, "at", "left").fillna(0, ["duplicated_rows"]).select("column", "duplicated_rows")


def case_variants(df: DataFrame, col: str) -> DataFrame:
    """Spellings that differ only by case or edge blanks (groups with > 1 spelling)."""
    g = df.filter(F.col(col).isNotNull()).groupBy(strip(F.lower(F.col(col))).alias("canonical")).agg(
        F.sort_array(F.collect_set(col)).alias("variations"))
    return g.filter(F.size("variations") > 1)


def area_pairs(df: DataFrame) -> DataFrame:
    """Record count per (state, district) pair."""
    return df.groupBy("state", "district").agg(F.count(F.lit(1)).alias("count"))


def date_coverage(df: DataFrame, date_col: str = "date", parse: bool = True) -> DataFrame:
    """First and last date and the span in days."""
    d = parse_date(date_col) if parse else F.col(date_col).cast("date")
    x = df.select(d.alias("_d")).filter("_d IS NOT NULL")
    return x.agg(F.min("_d").alias("first_date"), F.max("_d").alias("last_date"),
                 F.datediff(F.max("_d"), F.min("_d")).alias("span_days"))


def date_counts(df: DataFrame, date_col: str = "date", parse: bool = True) -> DataFrame:
    """Records per calendar date."""
    d = parse_date(date_col) if parse else F.col(date_col).cast("date")
    return df.select(d.alias("date")).filter("date IS NOT NULL").groupBy("date").agg(
        F.count(F.lit(1)).alias("records"))


def date_extremes(df: DataFrame, n: int = 3, date_col: str = "date", parse: bool = True) -> DataFrame:
    """The n earliest and n latest dates with their record counts."""
    c = date_counts(df, date_col, parse)
    first = c.orderBy("date").limit(n).withColumn("end", F.lit("earliest"))
    last = c.orderBy(F.desc("date")).limit(n).withColumn("end", F.lit("latest"))
    return first.unionByName(last)


def missing_dates(df: DataFrame, date_col: str = "date", parse: bool = True) -> DataFrame:
    """Calendar days between the first and last date without any record.

    The calendar (one row per day of the span) is generated from the one-row
    min/max; the anti join against distinct observed dates shuffles only dates.
    """
    d = parse_date(date_col) if parse else F.col(date_col).cast("date")
    seen = df.select(d.alias("date")).filter("date IS NOT NULL").distinct()
    cal = seen.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date"))
    return cal.join(seen, "date", "left_anti")


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, long form."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"))
                                           for c in df.columns])).alias("x")).select("x.*")


def region_counts(df: DataFrame, col: str = "pincode") -> DataFrame:
    """A47 + P36: rows per pincode region (leading digit)."""
    p = F.col(col).cast("string").try_cast("bigint")
    return df.filter(p.isNotNull()).groupBy(pincode_region(p).alias("pincode_region")).agg(
        F.count(F.lit(1)).alias("records"))


def key_violations(df: DataFrame, examples: int = 10) -> DataFrame:
    """empty/null districts, null pincodes, pincodes not 6 long, out of
    range, with up to ``examples`` distinct examples of each pincode problem.

    Examples come from a distributed top-k over the distinct bad values
    (TakeOrderedAndProject), never from a set of all bad values in one buffer.
    """
    p = F.col("pincode")
    num = p.cast("string").try_cast("bigint")
    bad_fmt = F.length(p.cast("string")) != 6
    bad_rng = (num < 100000) | (num > 999999)
    counts = df.agg(
        F.count_if(F.col("district").isNull() | (F.col("district") == "")).alias("empty_districts"),
        F.count_if(p.isNull()).alias("null_pincodes"),
        F.count_if(bad_fmt).alias("bad_format_pincodes"),
        F.count_if(bad_rng).alias("out_of_range_pincodes"),
    )

    def first_k(cond, value, name):
        top = df.filter(cond).select(value.alias("v")).distinct().orderBy("v").limit(examples)
        return top.agg(F.sort_array(F.collect_list("v")).alias(name))  # at most `examples` values

    return with_scalars(with_scalars(counts, first_k(bad_fmt, p.cast("string"), "bad_format_examples")),
                        first_k(bad_rng, num, "out_of_range_examples"))


def suspicious_states(df: DataFrame, col: str = "state") -> DataFrame:
    """State values containing a city or area name (case-sensitive substring)."""
    cond = reduce(lambda a, b: a | b, [F.col(col).contains(p) for p in K.SUSPICIOUS_PLACES])
    return df.filter(cond).groupBy(col).agg(F.count(F.lit(1)).alias("records"))


def whitespace_issues(df: DataFrame, col: str = "state") -> DataFrame:
    """Values with double blanks or edge blanks, blanks shown as dots."""
    return (df.filter(F.col(col).isNotNull() & whitespace_issue(col)).groupBy(col)
            .agg(F.count(F.lit(1)).alias("records")).withColumn("visible", visible_blanks(col)))


def deprecated_names(df: DataFrame, col: str = "state") -> DataFrame:
    """Exact-case deprecated names, their replacement and counts."""
    m = F.create_map(*[F.lit(x) for kv in K.DEPRECATED_STATES.items() for x in kv])
    return (df.filter(F.col(col).isin(list(K.DEPRECATED_STATES))).groupBy(col)
            .agg(F.count(F.lit(1)).alias("records")).withColumn("replacement", F.try_element_at(m, F.col(col))))


def state_audit(feeds: dict, col: str = "state") -> DataFrame:
    """U2 + U3: every distinct state over the feeds, the feeds it appears in,
    and whether it is exclusive to one feed. One union + group-by."""
    u = _union([df.select(F.col(col).alias("state"), F.lit(name).alias("feed"))
                for name, df in feeds.items()]).filter("state IS NOT NULL")
    g = u.groupBy("state").agg(F.sort_array(F.collect_set("feed")).alias("feeds"))
    return g.withColumn("only_in", F.when(F.size("feeds") == 1, F.col("feeds")[0]))
