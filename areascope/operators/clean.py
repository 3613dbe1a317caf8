"""Cleaning operators for one raw feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import (apply_aliases, coerce_count, normalise_district, normalise_state,
                         parse_date, row_sum, valid_pincode)
from ._util import bounded_broadcast, evaluate_once
from .order_stats import counted_quantiles, quantile_values, value_counts


def measures_of(feed: str) -> list:
    return list(K.RAW_MEASURES[feed].values())


def rename_measures(df: DataFrame, feed: str) -> DataFrame:
    """Raw measure names -> common names."""
    return df.withColumnsRenamed({k: v for k, v in K.RAW_MEASURES[feed].items() if k in df.columns})


def flag_valid_states(df: DataFrame, valid_states=None, col: str = "state") -> DataFrame:
    """``valid_state`` = state in the valid list; null -> false.

    ``valid_states`` is a list (an IN-set literal, no join) or a one-column
    DataFrame of names (size-checked broadcast left join).
    """
    if valid_states is None or isinstance(valid_states, (list, tuple, set)):
        names = list(K.VALID_STATES if valid_states is None else valid_states)
        return df.withColumn("valid_state", F.coalesce(F.col(col).isin(names), F.lit(False)))
    v = valid_states.select(F.col(valid_states.columns[0]).alias("_valid_name")).distinct()
    v = v.withColumn("_is_valid", F.lit(True))
    out = df.join(bounded_broadcast(v), F.col(col) == F.col("_valid_name"), "left")
    return out.withColumn("valid_state", F.coalesce(F.col("_is_valid"), F.lit(False))).drop(
        "_valid_name", "_is_valid")


def standardise_feed(raw: DataFrame, feed: str, valid_states=None, aliases=None,
                     final_trim: bool = False) -> DataFrame:
    """Steps before the cap: typed, validated daily rows of one feed.

    P2/P3 date parse and drop, P1 rename, P4 counts, P6/P7/P9 state, P8/F3 valid
    states only, P10/P9 district, P11 pincode. All narrow: no shuffle.
    """
    ms = measures_of(feed)
    df = evaluate_once(rename_measures(raw, feed))
    df = df.withColumns({"date": parse_date("date"), **{m: coerce_count(m) for m in ms},
                         "state_original": F.col("state"), "state": normalise_state("state")})
    df = evaluate_once(df.withColumn("state", apply_aliases("state", aliases))).filter(F.col("date").isNotNull())
    df = flag_valid_states(df, valid_states).filter(F.col("valid_state"))
    df = df.withColumns({"district_original": F.col("district"),
                         "district": normalise_district("district", final_trim)})
    df = df.filter(valid_pincode("pincode")).withColumn("pincode", F.col("pincode").cast("string").try_cast("int"))
    return df.select("date", "state", "district", "pincode", *ms,
                     "state_original", "district_original", "valid_state")


def percentile_caps(df: DataFrame, cols, p: float = K.CAP_PERCENTILE) -> dict:
    """column -> its p-th percentile (exact, linear interpolation), from one scan; columns without values are left out."""
    return {c: q[0] for c, q in quantile_values(df, cols, [p]).items()}


def cap_at_percentile(df: DataFrame, cols, p: float = K.CAP_PERCENTILE, caps: dict | None = None) -> DataFrame:
    """Cap each column at its own p-th percentile, or at the ``caps`` of an earlier run.

    The caps (a number a column) become literals, nulls stay null.
    """
    caps = percentile_caps(df, cols, p) if caps is None else caps
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.col(c).cast("double"), F.lit(caps[c])))
                           if c in caps else F.col(c).cast("double") for c in cols})


def period_column(period: str = "month"):
    if period == "month":
        return "year_month", F.date_format("date", "yyyy-MM")
    if period == "week":
        # Weeks run Monday-Sunday; the key is the Monday.
        return "year_week", F.date_trunc("week", F.col("date")).cast("date")
    raise ValueError(period)


def rollup_period(df: DataFrame, measures, period: str = "month") -> DataFrame:
    """A1/A2: sum measures per (period, area); rows with a null key are dropped."""
    name, expr = period_column(period)
    keys = [name, "state", "district", "pincode"]
    df = df.withColumn(name, expr)
    df = df.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return df.groupBy(keys).agg(*[F.sum(m).alias(m) for m in measures])


def quality_metrics(df: DataFrame, measures, suffix: str = "") -> DataFrame:
    """Total, completeness (share of measures > 0) and score x100."""
    n = len(measures)
    filled = sum(((F.col(m) > 0).cast("int") for m in measures), F.lit(0))
    return df.withColumns({
        f"total_activity{suffix}": row_sum(measures),
        f"data_completeness{suffix}": filled / F.lit(float(n)),
    }).withColumn(f"data_quality_score{suffix}", F.col(f"data_completeness{suffix}") * 100)


def clean_feed(raw: DataFrame, feed: str, valid_states=None, aliases=None,
               final_trim: bool = False) -> DataFrame:
    """Whole cleaning run for one feed: the cleaned monthly table."""
    ms = measures_of(feed)
    daily = standardise_feed(raw, feed, valid_states, aliases, final_trim)
    capped = cap_at_percentile(daily, ms)
    monthly = rollup_period(capped, ms)
    return quality_metrics(monthly, ms)


def top_invalid_states(raw: DataFrame, feed: str, aliases=None, valid_states=None, k: int = 10) -> DataFrame:
    """Most frequent normalised state values that fail validation."""
    df = raw.withColumn("date", parse_date("date")).filter(F.col("date").isNotNull())
    df = df.withColumn("state", apply_aliases(normalise_state("state"), aliases))
    df = flag_valid_states(df, valid_states).filter(~F.col("valid_state"))
    return (df.groupBy("state").agg(F.count(F.lit(1)).alias("records"))
            .orderBy(F.desc("records"), F.asc_nulls_first("state")).limit(k))


def cleaning_counters(raw: DataFrame, feed: str, valid_states=None, aliases=None) -> DataFrame:
    """One row of cleaning counters from a single scan of the raw feed.

    input rows, invalid dates, valid and invalid states (among dated rows),
    invalid pincodes (among valid-state rows), and rows above each measure's
    p99 (among fully valid rows). The scan counts how far each row comes and
    the values of the measures of those that pass; all figures follow from
    these counts.
    """
    ms = measures_of(feed)
    df = raw.withColumn("_date", parse_date("date"))
    df = rename_measures(df, feed).withColumns({m: coerce_count(m) for m in ms})
    df = df.withColumn("state", apply_aliases(normalise_state("state"), aliases))
    df = flag_valid_states(df, valid_states)
    good_pin = F.coalesce(valid_pincode("pincode"), F.lit(False))
    reached = (F.when(F.col("_date").isNull(), 0).when(~F.col("valid_state"), 1).when(~good_pin, 2).otherwise(3))
    df = df.withColumn("_reached", reached)
    counts = value_counts(df, {"_reached": F.col("_reached"),
                               **{m: F.when(F.col("_reached") == 3, F.col(m)) for m in ms}})
    caps = {r["column"]: r["q"][0] for r in
            counted_quantiles(counts.filter(F.col("column") != "_reached"), [K.CAP_PERCENTILE]).collect()}
    step = (F.col("column") == "_reached")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return counts.agg(
        total(step).alias("input_rows"),
        total(step & (F.col("value") == 0)).alias("invalid_dates"),
        total(step & (F.col("value") >= 2)).alias("valid_states"),
        total(step & (F.col("value") == 1)).alias("invalid_states"),
        total(step & (F.col("value") == 2)).alias("invalid_pincodes"),
        total(step & (F.col("value") == 3)).alias("output_rows"),
        *[total((F.col("column") == m) & (F.col("value") > F.lit(caps.get(m)).cast("double"))).alias(f"above_p99_{m}")
          for m in ms])


def dedup_feed(df: DataFrame, keys=("date", "state", "district", "pincode"), order=None) -> DataFrame:
    """Keep one row per key, the smallest by ``order`` (default: the other columns).

    A group-by with ``min(struct)`` is partially aggregated before the shuffle,
    so a key holding a third of all rows does not land whole in one task.
    The original results sum repeated rows, so the cleaning run leaves this off.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = list(order or rest)
    payload = order + [c for c in rest if c not in order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*payload)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
