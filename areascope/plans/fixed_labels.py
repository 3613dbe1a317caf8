"""Result tables of the model run over a fixed labelling.

SQL cannot fit the two models, but everything behind them is arithmetic. Here
each feature row gets its cluster and its forest score from a plain rule
(``sources.testdata.fixed_labels``, a stand-in for the fitted models); from
there on the library's own steps run as in the model run: offset and anomaly
flag, percentile rank, risk level, z-scores, trends, profile mapping, texts and
all result tables and reports. ``oracle_fixed`` holds their SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .. import constants as K
from ..operators import features as FE
from ..operators import iforest as IF
from ..operators import models as MO
from ..operators import outputs as OU
from ..operators import reports as RE
from ..session import compile_stages, keep_table
from ..sources import testdata as TD
from . import runs as RU

_RESULTS: dict = {}

#: query -> (operator over the labelled rows, what it shows)
TABLES: dict = {
    "fixed_full_output": (OU.full_output, "Model output per row: P25-P31, ML8, ML9, W5, W6."),
    "fixed_cluster_stats": (MO.cluster_stats, "A15."),
    "fixed_cluster_summary": (OU.cluster_summary, "A16, A17, A18, W9."),
    "fixed_high_risk_regions": (OU.high_risk, "F4, T3."),
    "fixed_monthly_alerts": (OU.monthly_alerts, "F5, P30."),
    "fixed_state_summary": (OU.state_summary, "A19, P32."),
    "fixed_risk_distribution": (lambda d: OU.distribution(d, "risk_category", K.RISK_LEVELS), "A21."),
    "fixed_trend_distribution": (lambda d: OU.distribution(d, "trend_status", K.TREND_LEVELS), "A21."),
    "fixed_profile_distribution": (lambda d: OU.distribution(d, "cluster_profile"), "A21."),
    "fixed_risk_counts": (RE.risk_counts, "A30."),
    "fixed_risk_pivot": (RE.risk_pivot, "A31, T7."),
    "fixed_trend_counts": (RE.trend_counts, "A32."),
    "fixed_state_profile_crosstab": (lambda d: RE.crosstab_pct(d, "state", "cluster_profile"), "A33."),
    "fixed_profile_risk_crosstab": (lambda d: RE.crosstab_pct(d, "cluster_profile", "risk_category"), "A33."),
    "fixed_normalised_cluster_means": (RE.normalised_cluster_means, "A34."),
    "fixed_cluster_profiles": (RE.cluster_profiles, "A35."),
    "fixed_anomaly_histogram": (lambda d: RE.histogram(d, "anomaly_score", 50, "is_anomaly"), "A36 by group."),
    "fixed_box_stats": (lambda d: RE.box_stats(d, "cluster_profile", "total_activity"), "A39."),
    "fixed_alert_timeline": (RE.alert_timeline, "A40."),
    "fixed_state_anomalies": (RE.state_anomalies, "A41, T4."),
    "fixed_top_critical_state": (RE.top_critical_state, "T12."),
    "fixed_risk_report": (lambda d: RE.risk_report(d, None, "CRITICAL").select(*OU.HIGH_RISK_COLUMNS), "F6."),
    "fixed_full_export": (lambda d: RE.full_export(OU.full_output(d)).select(*K.KEYS, "month_label", "risk_category",
                                                                             "insight_summary"), "F7."),
    "fixed_run_metadata": (lambda d: OU.run_metadata(d, "").select("configuration.n_clusters", "statistics.*"), "A20."),
}


def labelled(master: DataFrame) -> DataFrame:
    """The model run's result columns of every master row, with clusters and scores by rule."""
    moments = FE.master_moments(master, ("district",))
    rows = TD.fixed_labels(FE.build_features(master, ("district",), moments).select(*RU.KEPT))
    rows = keep_table(rows, "labelled")
    return RU.explain_rows(IF.decision_scores(rows), moments=moments, kept="fixed")


def register(queries: dict, master_table: Callable, data_version: Callable, rounded: Callable) -> None:
    """Adds the queries; they share one labelled table per session and version of the data."""
    def result(spark, sf_dir):
        key = data_version(spark, sf_dir)
        if key not in _RESULTS:
            _RESULTS[key] = labelled(master_table(spark, sf_dir))
        return _RESULTS[key]

    for name, (table, doc) in TABLES.items():
        def run(spark, sf_dir, table=table):
            compile_stages(spark)
            return rounded(table(result(spark, sf_dir)))
        run.__doc__ = f"{doc} Over the fixed labelling."
        queries[name] = run
