"""Scaling, k-means profiles and profile labelling (ML1-ML5, ML9, A15-A17, J7, W9)."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import finite_or_zero, profile_field
from ._util import with_scalars
from .order_stats import quantile_values


def fit_scaler(df: DataFrame, cols) -> DataFrame:
    """ML1 fit: one-row table of mean and population std per feature
    (non-finite values count as 0, like the original's clean-up)."""
    return df.agg(*[F.avg(finite_or_zero(c)).alias(f"{c}__mean") for c in cols],
                  *[F.stddev_pop(finite_or_zero(c)).alias(f"{c}__std") for c in cols])


def apply_scaler(df: DataFrame, scaler: DataFrame, cols, suffix: str = "_scaled") -> DataFrame:
    """ML1 apply: (x - mean) / std; zero variance -> 0. One broadcast row."""
    out = with_scalars(df, scaler)
    out = out.withColumns({
        f"{c}{suffix}": F.when(F.col(f"{c}__std") > 0,
                               (finite_or_zero(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std"))
                         .otherwise(F.lit(0.0))
        for c in cols})
    return out.drop(*[f"{c}__mean" for c in cols], *[f"{c}__std" for c in cols])


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def _fit_one(vectors: DataFrame, k: int, seed: int, max_iter: int, features: str):
    # Convergence as in the original: the summed squared centre shift of all k
    # centres below 1e-4 (standardised features) <=> each centre moves less
    # than 0.01 / sqrt(k); MLlib checks every centre's own shift.
    return KMeans(k=k, seed=seed, maxIter=max_iter, tol=0.01 / math.sqrt(k), featuresCol=features, solver="block",
                  predictionCol="cluster_id").fit(vectors)


def _parallel(fn, items, threads: int):
    # Independent Spark jobs submitted from driver threads run concurrently:
    # small fits stop paying scheduling latency one after another.
    if threads <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(fn, items))


def fit_kmeans(vectors: DataFrame, k: int, n_init: int = K.KMEANS_N_INIT, seed: int = K.KMEANS_SEED,
               max_iter: int = 100, features: str = "features", threads: int = 8):
    """ML2: best of ``n_init`` seeded k-means|| runs by training cost (inertia)."""
    models = _parallel(lambda i: _fit_one(vectors, k, seed + i, max_iter, features), list(range(n_init)), threads)
    return min(models, key=lambda m: m.summary.trainingCost)


def silhouette(assigned: DataFrame, features: str = "features", prediction: str = "cluster_id") -> float:
    """ML3: mean silhouette, linear-time squared-Euclidean form."""
    return ClusteringEvaluator(featuresCol=features, predictionCol=prediction,
                               distanceMeasure="squaredEuclidean").evaluate(assigned)


def choose_k(vectors: DataFrame, k_min: int = K.MIN_CLUSTERS, k_max: int = K.MAX_CLUSTERS,
             n_init: int = K.KMEANS_N_INIT, seed: int = K.KMEANS_SEED, max_iter: int = 100,
             threads: int = 8):
    """ML4: k with the highest silhouette (smallest k on ties).

    All (k, seed) fits are independent jobs and run concurrently; the best fit
    per k (lowest inertia) is scored. Returns (best_k, best_model,
    [(k, silhouette)]). ``vectors`` should be persisted by the caller.
    """
    ks = list(range(k_min, k_max + 1))
    combos = [(k, seed + i) for k in ks for i in range(n_init)]
    fitted = _parallel(lambda ks_: (ks_[0], _fit_one(vectors, ks_[0], ks_[1], max_iter, "features")),
                       combos, threads)
    best = {}
    for k, m in fitted:
        if k not in best or m.summary.trainingCost < best[k].summary.trainingCost:
            best[k] = m
    sil = _parallel(lambda k: (k, silhouette(best[k].transform(vectors))), ks, threads)
    best_k = max(sil, key=lambda kv: (kv[1], -kv[0]))[0]
    return best_k, best[best_k], sorted(sil)


def choose_k_batched(vectors: DataFrame, cols, id_cols, k_min: int = K.MIN_CLUSTERS,
                     k_max: int = K.MAX_CLUSTERS, n_init: int = K.KMEANS_N_INIT, seed: int = K.KMEANS_SEED,
                     max_iter: int = 300, tol: float = 1e-4):
    """ML2 + ML4 with every (k, seed) run sharing each pass over the data
    (``kmeans_batch.MultiKMeans``: k-means++ seeding, Lloyd iterations, the
    original's relative tolerance). One more pass scores the best run of every k.
    Returns (best_k, fitted MultiKMeans, [(k, silhouette)])."""
    from .kmeans_batch import MultiKMeans, silhouettes
    ks = list(range(k_min, k_max + 1))
    mk = MultiKMeans(ks, n_init, seed, max_iter, tol).fit(vectors, cols, id_cols)
    sil = silhouettes(vectors, cols, mk)
    best_k = max(sil, key=lambda kv: (kv[1], -kv[0]))[0]
    return best_k, mk, sil


def cluster_stats(df: DataFrame) -> DataFrame:
    """Per cluster activity mean/sum/count and feed means, rounded half-even to 2."""
    r = lambda c: F.bround(c, 2)
    return df.groupBy("cluster_id").agg(
        r(F.avg("total_activity")).alias("total_activity_mean"),
        r(F.sum("total_activity")).alias("total_activity_sum"),
        F.count(F.lit(1)).alias("total_activity_count"),
        r(F.avg("total_bio_updates")).alias("total_bio_updates_mean"),
        r(F.avg("total_demo_updates")).alias("total_demo_updates_mean"),
        r(F.avg("total_enrollments")).alias("total_enrollments_mean"),
        r(F.avg("update_to_enrol_ratio")).alias("update_to_enrol_ratio_mean"),
    )


def profile_mapping(df: DataFrame) -> DataFrame:
    """ML9 (A16, A17, J7, W9): cluster_id -> cluster_profile_id.

    Clusters ranked by mean activity: the top 20 % -> 0; else ratio above the
    global median -> 1; volatility above the global p75 -> 4; activity below
    the global p25 -> 3; else 2. At most k rows and three exact quantiles
    reach the driver.
    """
    means = df.groupBy("cluster_id").agg(F.avg("total_activity").alias("_act"),
                                         F.avg("update_to_enrol_ratio").alias("_ratio"),
                                         F.avg("total_activity_volatility").alias("_vol")).collect()  # k rows
    q = quantile_values(df, ["update_to_enrol_ratio", "total_activity_volatility", "total_activity"], [0.25, 0.5, 0.75])
    median_ratio, p75_vol, p25_act = q["update_to_enrol_ratio"][1], q["total_activity_volatility"][2], q["total_activity"][0]
    ranked = sorted(means, key=lambda r: (-r["_act"], r["cluster_id"]))
    n = len(ranked)
    mapping = []
    for i, r in enumerate(ranked):
        if i < n * K.PROFILE_TOP_SHARE:
            pid = 0
        elif r["_ratio"] > median_ratio:
            pid = 1
        elif r["_vol"] > p75_vol:
            pid = 4
        elif r["_act"] < p25_act:
            pid = 3
        else:
            pid = 2
        mapping.append((int(r["cluster_id"]), pid))
    return df.sparkSession.createDataFrame(mapping, "cluster_id int, cluster_profile_id int")


def profile_ids(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """ML9: the cluster's profile id per row (mapping has at most k rows: broadcast)."""
    return df.join(F.broadcast(mapping), "cluster_id", "left")


def profile_texts(df: DataFrame) -> DataFrame:
    """Profile name, description and policy action of the profile id."""
    return df.withColumns({
        "cluster_profile": profile_field("cluster_profile_id", 0),
        "cluster_description": profile_field("cluster_profile_id", 1),
        "policy_recommendation": profile_field("cluster_profile_id", 2),
    })


def label_profiles(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Profile id, name, description and policy action per row."""
    return profile_texts(profile_ids(df, mapping))
