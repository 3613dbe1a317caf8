"""Trend deviation: district z-scores and alert flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import trend_status
from ._util import attach_groups
from .features import district_moments

Z_METRICS = ["total_activity", "total_bio_updates", "total_demo_updates", "total_enrollments"]


def zscores(df: DataFrame, cols=Z_METRICS, by=("district",), moments: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std within the district; zero std -> 0.

    A grouped aggregate joined back instead of an unbounded window, so a hot
    district is pre-aggregated map-side rather than buffered in one task.
    ``moments``: the district moments of the same rows, where they were taken before.
    """
    if moments is None:
        moments = district_moments(df, by, cols)
    stats = moments.select(*by, *[F.col(f"{c}_mean").alias(f"_m_{c}") for c in cols],
                           *[F.col(f"{c}_dev").alias(f"_s_{c}") for c in cols])
    out = attach_groups(df, stats, by)
    out = out.withColumns({
        f"{c}_zscore": F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)),
                                  F.lit(0.0))
        for c in cols})
    return out.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def trend_flags(df: DataFrame, growth: str = "total_activity_mom_growth", z: str = "total_activity_zscore") -> DataFrame:
    """P26 strict thresholds, then P27 status (drop, spike, z, stable)."""
    df = df.withColumns({
        "drop_alert": (F.col(growth) < K.DROP_THRESHOLD).cast("int"),
        "spike_alert": (F.col(growth) > K.SPIKE_THRESHOLD).cast("int"),
        "zscore_anomaly": (F.abs(F.col(z)) > K.ZSCORE_THRESHOLD).cast("int"),
    })
    return df.withColumn("trend_status", trend_status())


def analyze_trends(df: DataFrame, by=("district",), moments: DataFrame | None = None) -> DataFrame:
    return trend_flags(zscores(df, by=by, moments=moments))
