"""Categorical labels and explanation texts as chained ``when`` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def risk_category(is_anomaly="is_anomaly", pct="risk_percentile") -> Column:
    a, p = _col(is_anomaly), _col(pct)
    return (F.when((a == 1) & (p < K.RISK_CRITICAL_PCT), "CRITICAL")
            .when(a == 1, "HIGH")
            .when(p < K.RISK_MEDIUM_PCT, "MEDIUM")
            .when(p < K.RISK_LOW_PCT, "LOW")
            .otherwise("NORMAL"))


def trend_status(drop="drop_alert", spike="spike_alert", z="zscore_anomaly") -> Column:
    return (F.when(_col(drop) == 1, "DECLINING")
            .when(_col(spike) == 1, "SURGING")
            .when(_col(z) == 1, "UNUSUAL")
            .otherwise("STABLE"))


def risk_explanation(category="risk_category") -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in K.RISK_EXPLANATIONS.items() for x in kv])
    return F.try_element_at(lookup, _col(category))


def profile_field(profile_id="cluster_profile_id", field: int = 0) -> Column:
    """Profile id -> name (0), description (1) or policy action (2); unknown -> default."""
    lookup = F.create_map(*[F.lit(x) for pid, vals in sorted(K.CLUSTER_PROFILES.items())
                            for x in (pid, vals[field])])
    return F.coalesce(F.try_element_at(lookup, _col(profile_id)),
                      F.lit(K.CLUSTER_PROFILES[K.DEFAULT_PROFILE][field]))


def risk_reason(is_anomaly="is_anomaly", activity="total_activity",
                district_mean="district_total_activity_mean", bio="total_bio_updates",
                enrol="total_enrollments", drop="drop_alert", spike="spike_alert") -> Column:
    """'; '-joined reasons; concat_ws skips the nulls of unmet conditions."""
    anomalous = _col(is_anomaly) == 1
    text = F.concat_ws(
        "; ",
        F.when(anomalous & (_col(activity) < _col(district_mean) * K.INSIGHT_LOW), K.REASON_BELOW_DISTRICT),
        F.when(anomalous & (_col(bio) == 0), K.REASON_NO_BIO),
        F.when(anomalous & (_col(enrol) == 0), K.REASON_NO_ENROL),
        F.when(_col(drop) == 1, K.REASON_DROP),
        F.when(_col(spike) == 1, K.REASON_SPIKE),
    )
    return F.when(text == "", K.REASON_NONE).otherwise(text)


def insight_summary(profile="cluster_profile", risk="risk_category", explanation="risk_explanation",
                    trend="trend_status", vs_mean="activity_vs_district_mean") -> Column:
    """' | '-joined insight text per row."""
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Profile: "), _col(profile)),
        F.when(_col(risk) != "NORMAL",
               F.concat(F.lit("Risk: "), _col(risk), F.lit(" - "), F.coalesce(_col(explanation), F.lit("")))),
        F.when(_col(trend) != "STABLE", F.concat(F.lit("Trend: "), _col(trend))),
        F.when(_col(vs_mean) < K.INSIGHT_LOW, K.INSIGHT_BELOW)
         .when(_col(vs_mean) > K.INSIGHT_HIGH, K.INSIGHT_ABOVE),
    )
