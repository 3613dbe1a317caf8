"""Result tables of the model run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..sources.files import select_existing
from ._util import with_scalars

FULL_OUTPUT_COLUMNS = [
    "year_month", "state", "district", "pincode",
    "total_activity", "total_bio_updates", "total_demo_updates", "total_enrollments",
    "bio_ratio", "demo_ratio", "enrol_ratio", "update_to_enrol_ratio", "activity_vs_district_mean",
    "cluster_id", "cluster_profile", "cluster_description", "policy_recommendation",
    "is_anomaly", "anomaly_score", "risk_category", "risk_explanation", "risk_reason",
    "trend_status", "drop_alert", "spike_alert", "insight_summary",
]
HIGH_RISK_COLUMNS = ["year_month", "state", "district", "pincode", "risk_category", "risk_reason",
                     "anomaly_score", "total_activity", "trend_status", "policy_recommendation"]
ALERT_COLUMNS = ["year_month", "state", "district", "pincode", "drop_alert", "spike_alert",
                 "is_anomaly", "trend_status", "risk_category", "risk_reason"]


def full_output(df: DataFrame) -> DataFrame:
    return select_existing(df, FULL_OUTPUT_COLUMNS)


def high_risk(df: DataFrame) -> DataFrame:
    """F4 + T3: CRITICAL and HIGH rows, most anomalous first (keys break ties)."""
    out = select_existing(df.filter(F.col("risk_category").isin("CRITICAL", "HIGH")), HIGH_RISK_COLUMNS)
    return out.orderBy("anomaly_score", *K.KEYS)


def monthly_alerts(df: DataFrame) -> DataFrame:
    """rows with a drop, a spike or an anomaly."""
    cond = (F.col("drop_alert") == 1) | (F.col("spike_alert") == 1) | (F.col("is_anomaly") == 1)
    return select_existing(df.filter(cond), ALERT_COLUMNS)


def cluster_summary(df: DataFrame) -> DataFrame:
    """Per cluster and profile, rounded half-even to 2 decimals."""
    r = lambda c: F.bround(c, 2)
    return df.groupBy("cluster_id", "cluster_profile").agg(
        F.count("pincode").alias("pincode_count"),
        F.countDistinct("state").alias("state_nunique"),
        F.countDistinct("district").alias("district_nunique"),
        r(F.avg("total_activity")).alias("total_activity_mean"),
        r(F.sum("total_activity")).alias("total_activity_sum"),
        r(F.avg("total_bio_updates")).alias("total_bio_updates_mean"),
        r(F.avg("total_demo_updates")).alias("total_demo_updates_mean"),
        r(F.avg("total_enrollments")).alias("total_enrollments_mean"),
    ).orderBy("cluster_id", "cluster_profile")


def state_summary(df: DataFrame) -> DataFrame:
    """A19 + P32: per state counts and sums; risk = anomalies + 2 drops + spikes."""
    out = df.groupBy("state").agg(
        F.countDistinct("pincode").alias("unique_pincodes"),
        F.countDistinct("district").alias("unique_districts"),
        F.sum("total_activity").alias("total_activity"),
        F.sum("is_anomaly").cast("bigint").alias("anomaly_count"),
        F.sum("drop_alert").cast("bigint").alias("drop_alerts"),
        F.sum("spike_alert").cast("bigint").alias("spike_alerts"),
    )
    out = out.withColumn("risk_score", F.col("anomaly_count") + 2 * F.col("drop_alerts") + F.col("spike_alerts"))
    return out.orderBy(F.desc("risk_score"), "state")


def distribution(df: DataFrame, col: str, levels=None) -> DataFrame:
    """Count and percent share of each value; listed levels appear with 0."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if levels:
        spark = df.sparkSession
        lv = spark.createDataFrame([(x,) for x in levels], f"{col} string")
        counts = lv.join(counts, col, "full").fillna(0, subset=["count"])
    counts = with_scalars(counts, total)
    return counts.select(col, "count", (F.col("count") * 100.0 / F.col("_n")).alias("pct"))


def _as_map(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(col), F.col("n")))).alias(f"{col}_distribution"))


def run_metadata(df: DataFrame, run_timestamp: str, feature_cols=K.FEATURE_COLUMNS) -> DataFrame:
    """A20 + S8: one nested row (configuration, statistics, distributions)."""
    stats = df.agg(
        F.countDistinct("cluster_id").alias("n_clusters"),
        F.count(F.lit(1)).alias("total_locations"),
        F.countDistinct("state").alias("unique_states"),
        F.countDistinct("district").alias("unique_districts"),
        F.countDistinct("pincode").alias("unique_pincodes"),
        F.sum("total_activity").cast("bigint").alias("total_activity"),
        F.sum("is_anomaly").cast("bigint").alias("anomaly_count"),
        F.count_if(F.col("risk_category").isin("CRITICAL", "HIGH")).alias("high_risk_count"),
        F.sum("drop_alert").cast("bigint").alias("drop_alert_count"),
        F.sum("spike_alert").cast("bigint").alias("spike_alert_count"),
    )
    # Each distribution has a handful of keys (profiles, risk levels, trends).
    dists = with_scalars(with_scalars(_as_map(df, "cluster_profile"), _as_map(df, "risk_category")),
                         _as_map(df, "trend_status"))
    row = with_scalars(stats, dists)
    return row.select(
        F.lit(run_timestamp).alias("run_timestamp"),
        F.lit(K.DATA_VERSION).alias("data_version"),
        F.lit(K.MODEL_VERSION).alias("model_version"),
        F.struct(F.col("n_clusters").cast("int").alias("n_clusters"),
                 F.lit(K.FOREST_CONTAMINATION).alias("contamination_rate"),
                 F.lit(K.ZSCORE_THRESHOLD).alias("zscore_threshold"),
                 F.lit(K.DROP_THRESHOLD).alias("drop_threshold"),
                 F.lit(K.SPIKE_THRESHOLD).alias("spike_threshold")).alias("configuration"),
        F.struct(*[F.col(c) for c in ("total_locations", "unique_states", "unique_districts",
                                      "unique_pincodes", "total_activity", "anomaly_count",
                                      "high_risk_count", "drop_alert_count", "spike_alert_count")])
        .alias("statistics"),
        F.col("cluster_profile_distribution").alias("cluster_distribution"),
        F.col("risk_category_distribution").alias("risk_distribution"),
        F.col("trend_status_distribution").alias("trend_distribution"),
        F.array(*[F.lit(c) for c in feature_cols]).alias("feature_columns"),
        F.array(*[F.lit(c) for c in K.OUTPUT_FILES]).alias("output_files"),
    )
