"""Explanations per row (P28-P31): all built-in expressions, no Python per row."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import insight_summary, risk_explanation, risk_reason


def generate_insights(df: DataFrame) -> DataFrame:
    """Adds risk_explanation, risk_reason and insight_summary (profiles come
    from ``models.label_profiles``)."""
    df = df.withColumn("risk_explanation", risk_explanation())
    df = df.withColumn("risk_reason", risk_reason())
    return df.withColumn("insight_summary", insight_summary())
