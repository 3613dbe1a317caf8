"""DuckDB SQL of the result tables over the fixed labelling (``fixed_labels``)."""

from __future__ import annotations

from .. import constants as K
from ..operators.outputs import ALERT_COLUMNS, FULL_OUTPUT_COLUMNS, HIGH_RISK_COLUMNS

DOUBLES = ["total_activity", "total_bio_updates", "total_demo_updates", "total_enrollments", "bio_ratio", "demo_ratio",
           "enrol_ratio", "update_to_enrol_ratio", "activity_vs_district_mean", "anomaly_score"]


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(x: str, pairs: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {k} THEN {_text(v)}" for k, v in pairs.items()) + " END"


def _profile(i: int) -> str:
    return _case("pid", {pid: v[i] for pid, v in K.CLUSTER_PROFILES.items()})


_RISKS = {_text(k): v for k, v in K.RISK_EXPLANATIONS.items()}

# feat, ds and tr come from the feature and trend SQL before it.
LABELS = f""",
lab0 AS MATERIALIZED (SELECT tr.*, dmean,
    CAST(2 * least(2, floor(total_activity / 40)) + CAST(update_to_enrol_ratio >= 1 AS INTEGER) AS INTEGER) AS cluster_id,
    -0.3::DOUBLE - ((CAST(pincode AS BIGINT) * 31 + CAST(substr(year_month, 6, 2) AS BIGINT) * 17) % 997) / 2000.0::DOUBLE AS s
  FROM tr JOIN (SELECT district, dmean FROM ds) USING (district)),
off AS (SELECT quantile_cont(s, {K.FOREST_CONTAMINATION}) AS o FROM lab0),
rk AS (SELECT s, CAST(sum(n) OVER (ORDER BY s) - n + (n + 1) / 2.0 AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS p
  FROM (SELECT s, count(*) AS n FROM lab0 GROUP BY s)),
med AS (SELECT quantile_cont(update_to_enrol_ratio, 0.5) AS mr, quantile_cont(total_activity_volatility, 0.75) AS pv,
    quantile_cont(total_activity, 0.25) AS pa FROM lab0),
cm AS (SELECT cluster_id, avg(total_activity) AS a, avg(update_to_enrol_ratio) AS r, avg(total_activity_volatility) AS v
  FROM lab0 GROUP BY cluster_id),
pm AS (SELECT cluster_id, CASE
    WHEN row_number() OVER (ORDER BY a DESC, cluster_id) - 1 < count(*) OVER () * {K.PROFILE_TOP_SHARE} THEN 0
    WHEN r > mr THEN 1 WHEN v > pv THEN 4 WHEN a < pa THEN 3 ELSE 2 END AS pid FROM cm, med),
lab1 AS (SELECT lab0.*, s - o AS anomaly_score, CAST(s - o < 0 AS INTEGER) AS is_anomaly, p, pid,
    CAST(total_activity_mom_growth < {K.DROP_THRESHOLD} AS INTEGER) AS drop_alert,
    CAST(total_activity_mom_growth > {K.SPIKE_THRESHOLD} AS INTEGER) AS spike_alert
  FROM lab0 JOIN rk USING (s) JOIN pm USING (cluster_id), off),
lab2 AS (SELECT *, CASE WHEN is_anomaly = 1 AND p < {K.RISK_CRITICAL_PCT} THEN 'CRITICAL' WHEN is_anomaly = 1 THEN 'HIGH'
      WHEN p < {K.RISK_MEDIUM_PCT} THEN 'MEDIUM' WHEN p < {K.RISK_LOW_PCT} THEN 'LOW' ELSE 'NORMAL' END AS risk_category,
    CASE WHEN drop_alert = 1 THEN 'DECLINING' WHEN spike_alert = 1 THEN 'SURGING'
      WHEN abs(total_activity_zscore) > {K.ZSCORE_THRESHOLD} THEN 'UNUSUAL' ELSE 'STABLE' END AS trend_status,
    {_profile(0)} AS cluster_profile, {_profile(1)} AS cluster_description, {_profile(2)} AS policy_recommendation,
    concat_ws('; ',
      CASE WHEN is_anomaly = 1 AND total_activity < dmean * {K.INSIGHT_LOW} THEN {_text(K.REASON_BELOW_DISTRICT)} END,
      CASE WHEN is_anomaly = 1 AND total_bio_updates = 0 THEN {_text(K.REASON_NO_BIO)} END,
      CASE WHEN is_anomaly = 1 AND total_enrollments = 0 THEN {_text(K.REASON_NO_ENROL)} END,
      CASE WHEN drop_alert = 1 THEN {_text(K.REASON_DROP)} END,
      CASE WHEN spike_alert = 1 THEN {_text(K.REASON_SPIKE)} END) AS reasons FROM lab1),
lab AS MATERIALIZED (SELECT * EXCLUDE (reasons), CASE reasons WHEN '' THEN {_text(K.REASON_NONE)} ELSE reasons END AS risk_reason,
    {_case("risk_category", _RISKS)} AS risk_explanation,
    concat_ws(' | ', 'Profile: ' || cluster_profile,
      CASE WHEN risk_category <> 'NORMAL' THEN 'Risk: ' || risk_category || ' - ' || {_case("risk_category", _RISKS)} END,
      CASE WHEN trend_status <> 'STABLE' THEN 'Trend: ' || trend_status END,
      CASE WHEN activity_vs_district_mean < {K.INSIGHT_LOW} THEN {_text(K.INSIGHT_BELOW)}
        WHEN activity_vs_district_mean > {K.INSIGHT_HIGH} THEN {_text(K.INSIGHT_ABOVE)} END) AS insight_summary
  FROM lab2)
"""


def _cols(names: list) -> str:
    return ", ".join(f"round({c}, 4) AS {c}" if c in DOUBLES else c for c in names)


def _even(expr: str, name: str) -> str:
    return f"round_even({expr}, 2) AS {name}"


def _sum(col: str, name: str) -> str:
    return f"CAST(sum({col}) AS BIGINT) AS {name}"


_MEANS = ", ".join(_even(f"avg({c})", f"{c}_mean") for c in
                   ["total_activity", "total_bio_updates", "total_demo_updates", "total_enrollments"])
_ACTIVITIES = ["total_bio_updates", "total_demo_updates", "total_enrollments"]


def _levels(col: str, levels: list, pct: bool = True) -> str:
    values = ", ".join(f"({_text(x)})" for x in levels)
    share = f", round(count(lab.{col}) * 100.0 / (SELECT count(*) FROM lab), 4) AS pct" if pct else ""
    return (f"SELECT l.{col}, count(lab.{col}) AS count{share} FROM (VALUES {values}) l({col}) "
            f"LEFT JOIN lab ON lab.{col} = l.{col} GROUP BY l.{col}")


def _crosstab(row: str, col: str) -> str:
    return (f"SELECT {row}, {col}, n, round(n * 100.0 / sum(n) OVER (PARTITION BY {row}), 4) AS pct "
            f"FROM (SELECT {row}, {col}, count(*) AS n FROM lab GROUP BY ALL)")


SELECTS = {
    "fixed_full_output": f"SELECT {_cols(FULL_OUTPUT_COLUMNS)} FROM lab",
    "fixed_cluster_stats": "SELECT cluster_id, " + _MEANS + ", " + _even("sum(total_activity)", "total_activity_sum")
        + ", count(*) AS total_activity_count, " + _even("avg(update_to_enrol_ratio)", "update_to_enrol_ratio_mean")
        + " FROM lab GROUP BY cluster_id",
    "fixed_cluster_summary": "SELECT cluster_id, cluster_profile, count(pincode) AS pincode_count, "
        "count(DISTINCT state) AS state_nunique, count(DISTINCT district) AS district_nunique, " + _MEANS + ", "
        + _even("sum(total_activity)", "total_activity_sum") + " FROM lab GROUP BY cluster_id, cluster_profile",
    "fixed_high_risk_regions": f"SELECT {_cols(HIGH_RISK_COLUMNS)} FROM lab WHERE risk_category IN ('CRITICAL', 'HIGH')",
    "fixed_monthly_alerts": f"SELECT {_cols(ALERT_COLUMNS)} FROM lab WHERE drop_alert = 1 OR spike_alert = 1 OR is_anomaly = 1",
    "fixed_state_summary": "SELECT *, anomaly_count + 2 * drop_alerts + spike_alerts AS risk_score FROM (SELECT state, "
        "count(DISTINCT pincode) AS unique_pincodes, count(DISTINCT district) AS unique_districts, "
        "round(sum(total_activity), 4) AS total_activity, " + _sum("is_anomaly", "anomaly_count") + ", "
        + _sum("drop_alert", "drop_alerts") + ", " + _sum("spike_alert", "spike_alerts") + " FROM lab GROUP BY state)",
    "fixed_risk_distribution": _levels("risk_category", K.RISK_LEVELS),
    "fixed_trend_distribution": _levels("trend_status", K.TREND_LEVELS),
    "fixed_profile_distribution": "SELECT cluster_profile, count(*) AS count, "
        "round(count(*) * 100.0 / (SELECT count(*) FROM lab), 4) AS pct FROM lab GROUP BY cluster_profile",
    "fixed_risk_counts": _levels("risk_category", K.RISK_LEVELS, pct=False),
    "fixed_risk_pivot": "SELECT state, " + ", ".join(f"count(*) FILTER (WHERE risk_category = '{x}') AS {x}" for x in K.RISK_LEVELS)
        + " FROM lab GROUP BY state ORDER BY CRITICAL DESC, state LIMIT 15",
    "fixed_trend_counts": "SELECT trend_status, count(*) AS count, (SELECT CAST(sum(drop_alert) AS BIGINT) FROM lab) AS drop_alerts, "
        "(SELECT CAST(sum(spike_alert) AS BIGINT) FROM lab) AS spike_alerts FROM lab GROUP BY trend_status",
    "fixed_state_profile_crosstab": _crosstab("state", "cluster_profile"),
    "fixed_profile_risk_crosstab": _crosstab("cluster_profile", "risk_category"),
    "fixed_normalised_cluster_means": "SELECT cluster_profile, " + ", ".join(
        f"round({c} / max({c}) OVER (), 4) AS {c}_norm" for c in _ACTIVITIES) + " FROM (SELECT cluster_profile, "
        + ", ".join(f"avg({c}) AS {c}" for c in _ACTIVITIES) + " FROM lab GROUP BY cluster_profile)",
    "fixed_cluster_profiles": "SELECT cluster_profile, " + ", ".join(
        f"round(avg({c}), 4) AS {c}_mean" for c in ("bio_ratio", "demo_ratio", "enrol_ratio")) + ", " + ", ".join(
        f"round(sum({c}), 4) AS {c}_sum" for c in [*_ACTIVITIES, "total_activity"])
        + ", round(avg(total_activity_volatility), 4) AS volatility_mean, "
        "(SELECT round(avg(total_activity_volatility), 4) FROM lab) AS volatility_overall_mean FROM lab GROUP BY cluster_profile",
    "fixed_anomaly_histogram": "SELECT is_anomaly, bin, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 50, 4) AS bin_start, "
        "count(*) AS count FROM (SELECT is_anomaly, lo, hi, "
        "CAST(least(floor((anomaly_score - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin "
        "FROM lab, (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM lab)) GROUP BY is_anomaly, bin",
    "fixed_box_stats": "SELECT cluster_profile, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, "
        "min(x) AS min, max(x) AS max, min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)) AS whisker_low, "
        "max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)) AS whisker_high "
        "FROM (SELECT cluster_profile, round(total_activity, 4) AS x FROM lab) JOIN (SELECT cluster_profile, "
        "quantile_cont(total_activity, 0.25) AS q1, quantile_cont(total_activity, 0.5) AS median, "
        "quantile_cont(total_activity, 0.75) AS q3 FROM lab GROUP BY 1) USING (cluster_profile) GROUP BY ALL",
    "fixed_alert_timeline": "SELECT year_month, " + _sum("drop_alert", "drops") + ", " + _sum("spike_alert", "spikes") + ", "
        + _sum("is_anomaly", "anomalies") + " FROM lab GROUP BY year_month",
    "fixed_state_anomalies": "SELECT state, " + _sum("is_anomaly", "anomalies") + ", round(sum(total_activity), 4) AS total_activity "
        "FROM lab GROUP BY state ORDER BY anomalies DESC, state LIMIT 15",
    "fixed_top_critical_state": "SELECT state, count(*) AS critical FROM lab WHERE risk_category = 'CRITICAL' "
        "GROUP BY state ORDER BY critical DESC, state LIMIT 1",
    "fixed_risk_report": f"SELECT {_cols(HIGH_RISK_COLUMNS)} FROM lab WHERE risk_category = 'CRITICAL'",
    "fixed_full_export": "SELECT year_month, state, district, pincode, "
        "strftime(CAST(year_month || '-01' AS DATE), '%B %Y') AS month_label, risk_category, insight_summary FROM lab",
    "fixed_run_metadata": "SELECT CAST(count(DISTINCT cluster_id) AS INTEGER) AS n_clusters, count(*) AS total_locations, "
        "count(DISTINCT state) AS unique_states, count(DISTINCT district) AS unique_districts, "
        "count(DISTINCT pincode) AS unique_pincodes, CAST(trunc(sum(total_activity)) AS BIGINT) AS total_activity, "
        + _sum("is_anomaly", "anomaly_count") + ", count(*) FILTER (WHERE risk_category IN ('CRITICAL', 'HIGH')) AS high_risk_count, "
        + _sum("drop_alert", "drop_alert_count") + ", " + _sum("spike_alert", "spike_alert_count") + " FROM lab",
}


def fixed_oracles(features: str) -> dict:
    """query -> SQL; ``features``: the WITH clause up to the features and z-scores."""
    return {name: features.rstrip() + LABELS + select for name, select in SELECTS.items()}
