"""End-to-end runs: cleaning run (raw feeds -> master) and model run
(master -> features -> k-means profiles -> isolation-forest risk -> trends ->
insights -> result tables)."""

from __future__ import annotations

import datetime as _dt
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .. import constants as K
from ..functions import risk_category
from ..operators import features as FE
from ..operators import iforest as IF
from ..operators import insights as IN
from ..operators import master as MA
from ..operators import models as MO
from ..operators import outputs as OU
from ..operators import ranking as RK
from ..operators import trends as TR
from ..session import cut_lineage, keep_table

SCALED = [f"{c}_scaled" for c in K.FEATURE_COLUMNS]
#: Feature columns that the steps behind the two models and the result tables read.
KEPT = K.KEYS + ["total_activity", "total_bio_updates", "total_demo_updates", "total_enrollments",
                 "bio_ratio", "demo_ratio", "enrol_ratio", "update_to_enrol_ratio",
                 "activity_vs_district_mean", "district_total_activity_mean",
                 "total_activity_mom_growth", "total_activity_volatility"]


@dataclass
class ModelRun:
    result: DataFrame
    best_k: int
    silhouettes: list
    kmeans: object
    forest: DataFrame
    scaler: DataFrame
    stage_seconds: dict = field(default_factory=dict)
    run_timestamp: str = field(default_factory=lambda: _dt.datetime.now().strftime("%Y-%m-%d_%H-%M-%S"))

    def tables(self) -> dict:
        return {
            "ml_full_output": OU.full_output(self.result),
            "cluster_summary": OU.cluster_summary(self.result),
            "high_risk_regions": OU.high_risk(self.result),
            "monthly_alerts": OU.monthly_alerts(self.result),
            "state_summary": OU.state_summary(self.result),
        }


def cleaning_run(raw: dict, valid_states=None, aliases=None, path: str | None = None) -> dict:
    """Raw feeds -> {'master', 'bio', 'demo', 'enrol'} (cleaned monthly tables).

    With ``path`` the master is written there once (raw feeds parsed once) and
    every returned table reads that Parquet copy."""
    if path:
        spark = next(iter(raw.values())).sparkSession
        master = spark.read.parquet(MA.write_master(raw, path, valid_states, aliases))
    else:
        master = MA.build_master(raw, valid_states, aliases)
    out = {"master": master}
    out.update({f: MA.feed_from_master(master, f) for f in MA.FEEDS})
    return out


def explain_rows(scored: DataFrame, district_by=("district",), moments: DataFrame | None = None,
                 kept: str | None = None) -> DataFrame:
    """Rows with a cluster and an anomaly score -> risk levels, trends, profiles and texts: all after the two models.

    With ``kept`` the numbers and levels are written once, as a table of that name. The texts follow from them row by
    row and are made by the readers that ask for them: as columns they would be most of the table and of its writing.
    """
    mapping = MO.profile_mapping(scored)  # of columns that the rows have from the start: ahead of the ranks' join
    ranked = RK.rank_pct(scored, "anomaly_score", "risk_percentile")
    ranked = ranked.withColumn("risk_category", risk_category())
    rows = MO.profile_ids(TR.analyze_trends(ranked, district_by, moments), mapping)
    if kept:
        rows = keep_table(rows, kept)
    return IN.generate_insights(MO.profile_texts(rows))


def model_run(master: DataFrame, n_init: int = K.KMEANS_N_INIT, k_min: int = K.MIN_CLUSTERS,
              k_max: int = K.MAX_CLUSTERS, seed: int = K.KMEANS_SEED, n_trees: int = K.FOREST_TREES,
              district_by=("district",), kmeans_engine: str = "batched") -> ModelRun:
    clock = {"t": time.time()}
    stages = {}

    def lap(name):
        now = time.time()
        stages[name] = round(now - clock["t"], 3)
        clock["t"] = now

    feature_cols = [c for c in K.FEATURE_COLUMNS if c not in KEPT]
    # The features (one window shuffle of the master) feed the scaler statistics
    # and the scaling: materialise them once instead of evaluating them twice.
    moments = FE.master_moments(master, district_by)  # for the features and the z-scores
    feats = keep_table(FE.build_features(master, district_by, moments).select(*KEPT, *feature_cols), "features")
    scaler = cut_lineage(MO.fit_scaler(feats, K.FEATURE_COLUMNS))
    scaled = MO.apply_scaler(feats, scaler, K.FEATURE_COLUMNS).select(*KEPT, *SCALED)
    par = master.sparkSession.sparkContext.defaultParallelism
    if scaled.rdd.getNumPartitions() < par:  # every k-means pass should use every core
        scaled = scaled.repartition(par)
    scaled = keep_table(scaled, "scaled")
    lap("features_and_scaling")
    if kmeans_engine == "mllib":
        vectors = cut_lineage(MO.assemble(scaled, SCALED)).persist()
        best_k, model, sil = MO.choose_k(vectors, k_min, k_max, n_init, seed)
        lap("choose_k")
        assigned = keep_table(model.transform(vectors).drop("features"), "assigned")
        vectors.unpersist()
    else:
        from ..operators.kmeans_batch import assign
        best_k, model, sil = MO.choose_k_batched(scaled, SCALED, K.KEYS, k_min, k_max, n_init, seed)
        lap("choose_k")
        assigned = assign(scaled, SCALED, model.centers_of(best_k))
    nodes, psi = IF.fit_iforest(assigned, SCALED, K.KEYS, n_trees=n_trees, seed=K.FOREST_SEED)
    nodes = cut_lineage(nodes)
    # Scored once: the offset is taken from the written scores.
    scored = IF.decision_scores(keep_table(IF.score_samples(assigned, nodes, psi, SCALED).drop(*SCALED), "scored"))
    lap("isolation_forest")
    result = explain_rows(scored, district_by, moments, "result")
    lap("risk_trends_insights")
    return ModelRun(result, best_k, sil, model, nodes, scaler, stages)


def write_model_outputs(run: ModelRun, path: str, fmt: str = "csv") -> None:
    """The five result tables, the JSON run metadata and the models."""
    from ..sources.sinks import save_models, write_outputs, write_report
    base = path.rstrip("/")
    write_outputs(run.tables(), f"{base}/outputs", fmt)
    write_report(OU.run_metadata(run.result, run.run_timestamp), f"{base}/ml_metadata")
    spark = run.result.sparkSession
    features = spark.createDataFrame([(i, c) for i, c in enumerate(K.FEATURE_COLUMNS)], "position int, feature string")
    tables = {"scaler": run.scaler, "forest": run.forest, "feature_columns": features}
    mllib = run.kmeans if hasattr(run.kmeans, "write") else None
    if mllib is None:
        from ..operators.kmeans_batch import centers_table
        tables["kmeans_centers"] = centers_table(spark, run.kmeans, run.best_k, SCALED)
    save_models(f"{base}/models", mllib, tables)
