"""Model features from the master table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import floor_zero, row_sum, safe_ratio
from ..session import cut_lineage
from ._util import attach_groups

BIO_COLS = ["updates_age_5_17_bio", "updates_age_18_plus_bio"]
DEMO_COLS = ["updates_age_5_17_demo", "updates_age_18_plus_demo"]
ENROL_COLS = ["enrollments_age_0_5", "enrollments_age_5_17", "enrollments_age_18_plus"]
QUALITY_COLS = ["data_quality_score_bio", "data_quality_score_demo", "data_quality_score"]
TEMPORAL_METRICS = ["total_activity", "total_bio_updates", "total_demo_updates", "total_enrollments"]


def validate_master(df: DataFrame) -> DataFrame:
    """P13 negatives -> 0 in measure columns; P17 mean quality and low-quality flag."""
    measures = [c for c in df.columns if "update" in c or "enrollment" in c]
    df = df.withColumns({c: floor_zero(c) for c in measures})
    q = [c for c in df.columns if "quality_score" in c]
    if not q:
        return df
    non_null = sum((F.col(c).isNotNull().cast("int") for c in q), F.lit(0))
    avg_q = row_sum(q) / F.when(non_null > 0, non_null)
    return df.withColumn("avg_quality", avg_q).withColumn(
        "low_quality_flag", F.col("avg_quality") < K.MIN_QUALITY_SCORE)


def activity_totals(df: DataFrame) -> DataFrame:
    """Feed totals, overall total, shares and age proportions."""
    df = df.withColumns({
        "total_bio_updates": row_sum(BIO_COLS).cast("double"),
        "total_demo_updates": row_sum(DEMO_COLS).cast("double"),
        "total_enrollments": row_sum(ENROL_COLS).cast("double"),
    })
    df = df.withColumn("total_activity", F.col("total_bio_updates") + F.col("total_demo_updates")
                       + F.col("total_enrollments"))
    return df.withColumns({
        "bio_ratio": safe_ratio("total_bio_updates", "total_activity"),
        "demo_ratio": safe_ratio("total_demo_updates", "total_activity"),
        "enrol_ratio": safe_ratio("total_enrollments", "total_activity"),
        "update_to_enrol_ratio": safe_ratio(F.col("total_bio_updates") + F.col("total_demo_updates"),
                                            "total_enrollments"),
        "child_enrol_total": F.col("enrollments_age_0_5") + F.col("enrollments_age_5_17"),
    }).withColumns({
        "child_enrol_proportion": safe_ratio("child_enrol_total", "total_enrollments"),
        "bio_child_proportion": safe_ratio("updates_age_5_17_bio", "total_bio_updates"),
    })


def district_moments(df: DataFrame, by=("district",), metrics=TEMPORAL_METRICS) -> DataFrame:
    """One mergeable table of ``by``, n and, for each metric c, c_mean and c_dev (population deviation).

    Sums, sample and population deviations of any user follow from it, so one aggregate (combined before the shuffle:
    a hot district does not skew it) serves the district statistics, the features and the z-scores.
    """
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[f for c in metrics for f in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_dev"))])


def moment_stats(moments: DataFrame, by=("district",)) -> DataFrame:
    """A14 from the moments: mean, sample std and sum of total activity; feed means."""
    n = F.col("n")
    sample = F.col("total_activity_dev") * F.sqrt(n / F.nullif(n - 1, F.lit(0)))
    return moments.select(
        *by, F.col("total_activity_mean").alias("district_total_activity_mean"),
        sample.alias("district_total_activity_std"),
        (F.col("total_activity_mean") * n).alias("district_total_activity_sum"),
        *[F.col(f"{c}_mean").alias(f"district_{c}_mean") for c in
          ("total_bio_updates", "total_demo_updates", "total_enrollments")])


def district_stats(df: DataFrame, by=("district",)) -> DataFrame:
    """Per district mean, sample std and sum of total activity; feed means.

    Keyed by district name only (as the original: equal names in two states are
    pooled); pass ``by=('state','district')`` to separate them.
    """
    return moment_stats(district_moments(df, by), by)


def district_features(df: DataFrame, by=("district",), moments: DataFrame | None = None) -> DataFrame:
    """J3 + P20: join the district statistics back and relate activity to the mean.

    ``moments``: the district moments, where they were taken before.
    """
    df = attach_groups(df, moment_stats(district_moments(df, by) if moments is None else moments, by), by)
    return df.withColumn("activity_vs_district_mean",
                         safe_ratio("total_activity", "district_total_activity_mean"))


def area_window(order: str = "year_month") -> Window:
    # One area has at most one row per month, so partitions stay small.
    return Window.partitionBy(*K.AREA).orderBy(order)


def temporal_features(df: DataFrame, metrics=TEMPORAL_METRICS, window: int = K.ROLLING_WINDOW) -> DataFrame:
    """Previous present month, growth, rolling mean and sample std over
    the last ``window`` rows of each area. All columns share one window sort."""
    w = area_window()
    roll = w.rowsBetween(-(window - 1), 0)
    cols = {}
    for c in metrics:
        prev = F.lag(c, 1).over(w)
        cols[f"{c}_prev"] = prev
        cols[f"{c}_mom_growth"] = safe_ratio(F.col(c) - prev, prev)
        cols[f"{c}_rolling_avg"] = F.avg(c).over(roll)
        cols[f"{c}_volatility"] = F.stddev_samp(c).over(roll)
    return df.withColumns(cols)


def quality_weight(df: DataFrame) -> DataFrame:
    """Mean of the quality scores / 100 (1.0 when there are none)."""
    if not all(c in df.columns for c in QUALITY_COLS):
        return df.withColumn("quality_weight", F.lit(1.0))
    return df.withColumn("quality_weight", row_sum(QUALITY_COLS) / F.lit(len(QUALITY_COLS)) / 100)


def master_moments(master: DataFrame, by=("district",)) -> DataFrame:
    """The district moments of a master table, computed once: its users share the checkpoint."""
    return cut_lineage(district_moments(activity_totals(validate_master(master)), by))


def build_features(master: DataFrame, by=("district",), moments: DataFrame | None = None) -> DataFrame:
    """Stage 2 of the model run: every feature column next to the master columns.

    The area windows come first, on their own shuffle by area: behind the district
    join they would run on its partitioning, one task a district.
    """
    totals = activity_totals(validate_master(master))
    moments = district_moments(totals, by) if moments is None else moments
    df = district_features(temporal_features(totals), by, moments)
    df = df.fillna(0)
    return quality_weight(df)
