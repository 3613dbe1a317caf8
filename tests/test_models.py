"""Scaler, isolation forest and the end-to-end model run on the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from areascope import constants as K
from areascope.operators import iforest as IF
from areascope.operators import models as MO
from areascope.plans import catalog as C
from areascope.plans import runs as RU

SF = "/root/testdata/sf0.001"


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (9.0, 5.0)], "a double, b double")
    out = MO.apply_scaler(df, MO.fit_scaler(df, ["a", "b"]), ["a", "b"]).toPandas()
    assert out["a_scaled"].mean() == pytest.approx(0.0)
    assert out["a_scaled"].std(ddof=0) == pytest.approx(1.0)
    assert (out["b_scaled"] == 0).all()


def test_average_path_length():
    assert list(IF.average_path_length([0, 1, 2])) == [0.0, 0.0, 1.0]
    n = 256.0
    assert IF.average_path_length([n])[0] == pytest.approx(2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n)


def test_iforest_ranks_planted_outliers_first(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(2000, 2)))]
    rows += [(5000 + j, 12.0 + j, -12.0 - j) for j in range(5)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    nodes, psi = IF.fit_iforest(df, ["x", "y"], ["id"], n_trees=50, seed=7)
    scored = IF.decision_scores(IF.score_samples(df, nodes, psi, ["x", "y"]), 0.01)
    worst = [r.id for r in scored.orderBy("anomaly_score").limit(5).collect()]
    assert sorted(worst) == [5000, 5001, 5002, 5003, 5004]
    assert scored.filter("is_anomaly = 1").count() == pytest.approx(20, abs=2)
    # deterministic under the fixed seed
    nodes2, _ = IF.fit_iforest(df, ["x", "y"], ["id"], n_trees=50, seed=7)
    a = nodes.orderBy("tree", "node").toPandas()
    b = nodes2.orderBy("tree", "node").toPandas()
    assert a.equals(b)
    assert a.groupby("tree").size().max() <= 2 * psi - 1


def test_model_run_invariants(spark):
    master = C.master_table(spark, SF)
    run = RU.model_run(master, n_init=2, k_min=3, k_max=4, n_trees=20)
    r = run.result
    n = r.count()
    assert n == master.count()
    assert all(-1 <= s <= 1 for _, s in run.silhouettes)
    risk = {x["risk_category"]: x["count"] for x in r.groupBy("risk_category").count().collect()}
    assert sum(risk.values()) == n
    anomalies = r.filter("is_anomaly = 1").count()
    assert risk.get("CRITICAL", 0) + risk.get("HIGH", 0) == anomalies
    assert abs(anomalies - 0.1 * n) <= 0.02 * n
    trend = {x["trend_status"]: x["count"] for x in r.groupBy("trend_status").count().collect()}
    assert trend.get("SURGING", 0) == r.filter("spike_alert = 1 AND drop_alert = 0").count()
    assert trend.get("DECLINING", 0) == r.filter("drop_alert = 1").count()
    cs = OUsum = run.tables()["cluster_summary"].agg(F.sum("total_activity_sum")).first()[0]
    total = r.agg(F.sum("total_activity")).first()[0]
    assert OUsum == pytest.approx(total, rel=1e-6) and cs
    means = r.groupBy("cluster_id", "cluster_profile").agg(F.avg("total_activity").alias("m")).orderBy(F.desc("m")).first()
    assert means.cluster_profile == K.CLUSTER_PROFILES[0][0]
    reasons = r.filter("is_anomaly = 0 AND drop_alert = 0 AND spike_alert = 0").select("risk_reason").distinct().collect()
    assert [x.risk_reason for x in reasons] == [K.REASON_NONE]


def test_batched_kmeans_finds_blobs_and_beats_single_runs(spark):
    from pyspark.ml.clustering import KMeans

    from areascope.operators.kmeans_batch import MultiKMeans, assign
    rng = np.random.default_rng(3)
    centres = np.array([[0.0, 0.0], [8.0, 8.0], [-8.0, 6.0]])
    pts = np.vstack([c + rng.normal(scale=0.5, size=(300, 2)) for c in centres])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    df = df.repartition(4)
    mk = MultiKMeans([2, 3, 4], n_init=3, seed=1).fit(df, ["x", "y"], ["id"])
    got = mk.centers_of(3)
    for c in centres:
        assert np.min(np.linalg.norm(got - c, axis=1)) < 0.2
    labels = assign(df, ["x", "y"], got).groupBy("cluster_id").count().collect()
    assert sorted(r["count"] for r in labels) == [300, 300, 300]
    assert mk.inertia_of(3) < mk.inertia_of(2)
    vec = MO.assemble(df, ["x", "y"])
    mllib = KMeans(k=3, seed=1).fit(vec).summary.trainingCost
    assert mk.inertia_of(3) <= mllib * (1 + 1e-6)
    # same seed, same result
    again = MultiKMeans([3], n_init=3, seed=1).fit(df, ["x", "y"], ["id"])
    assert np.allclose(np.sort(again.centers_of(3), axis=0), np.sort(got, axis=0))


def test_vectorised_path_lengths_match_row_walk():
    import pandas as pd
    rng = np.random.default_rng(11)
    X = rng.normal(size=(300, 4))
    trees = []
    for t in range(5):
        sample = X[rng.choice(len(X), 64, replace=False)]
        feat, thr, left, right, size = IF.grow_tree(sample, np.random.default_rng([1, t]), 6)
        trees.append(pd.DataFrame({"tree": t, "node": range(len(feat)), "feature": feat, "threshold": thr,
                                   "left": left, "right": right, "size": size}))
    nodes = pd.concat(trees, ignore_index=True)
    got = IF.path_lengths(X, IF._forest_arrays(nodes))

    def walk(x, tree):
        node, depth = 0, 0
        while tree.feature[node] >= 0:
            node = tree.left[node] if x[tree.feature[node]] <= tree.threshold[node] else tree.right[node]
            depth += 1
        return depth + IF.average_path_length([tree["size"][node]])[0]

    expect = [np.mean([walk(x, t.reset_index(drop=True)) for t in trees]) for x in X]
    assert np.allclose(got, expect)


def test_lloyd_pass_matches_numpy_step(spark):
    from areascope.operators.kmeans_batch import MultiKMeans
    rng = np.random.default_rng(5)
    X = rng.normal(size=(500, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(X)], "id int, a double, b double, c double")
    data = df.select(F.xxhash64("id").alias("_h"), "a", "b", "c").repartition(3)
    mk = MultiKMeans([2, 3], n_init=1)
    centers = {0: X[:2].copy(), 1: X[10:13].copy()}
    got = mk._lloyd_pass(data, ["a", "b", "c"], centers, [0, 1])
    for r, C in centers.items():
        d = ((X[:, None, :] - C[None, :, :]) ** 2).sum(-1)
        lab = d.argmin(1)
        new = np.array([X[lab == j].mean(0) if (lab == j).any() else C[j] for j in range(len(C))])
        assert np.allclose(got[r][0], new)
        assert got[r][1] == pytest.approx(d.min(1).sum())


def test_rows_of_equal_distance_count_once_for_the_first_centre():
    """Runs are marked a group of equal size at a time: ties and repeated centres as by argmin, run by run."""
    from areascope.operators import kmeans_batch as KB
    rng = np.random.default_rng(3)
    X = rng.integers(-2, 3, size=(400, 3)).astype(float)  # many equal distances
    centers = {4: X[:3], 0: np.array([[0.0, 0, 0], [0, 0, 0], [1, 1, 1]]), 7: X[5:7], 2: X[9:12]}
    groups = KB._alike([0, 2, 4, 7], centers)
    assert groups == [(2, [7]), (3, [0, 2, 4])]
    stack = np.vstack([centers[r][j] for k, runs in groups for j in range(k) for r in runs])
    weights = np.hstack([-2.0 * stack, (stack * stack).sum(1)[:, None]])
    rows = np.hstack([X, np.ones((400, 1)), (X * X).sum(1)[:, None]])
    got, at = KB._nearest_sums(weights, [(k, len(runs)) for k, runs in groups], rows), 0
    for k, runs in groups:
        for i, r in enumerate(runs):
            lab = ((X[:, None, :] - centers[r][None, :, :]) ** 2).sum(-1).argmin(1)
            want = np.array([rows[lab == j].sum(0) for j in range(k)])
            assert np.allclose(got[at + i + np.arange(k) * len(runs)], want)
        at += k * len(runs)


def _kept(df):
    return sorted((r["tree"], r["key"], r["row"], tuple(r["x"])) for r in df.collect())


@pytest.mark.parametrize("rows", [60, 1000, 5000])
def test_forest_samples_are_the_smallest_hashes_however_rows_are_dealt(spark, rows):
    """Against a plain sort of all hashes: exactly min(psi, n) rows a tree at every size, equal under any partitioning."""
    psi, trees = 100, 7
    data = [(i // 2, float(i % 11), float(i)) for i in range(rows)]  # every id twice, with other features
    df = spark.createDataFrame(data, "id long, x double, y double")
    h = [r[0] for r in df.select(IF.F.xxhash64("id", IF.F.lit(3))).collect()]
    want = []
    for tree in range(trees):
        key = IF._tree_key(np.array(h, np.int64), tree)
        want += [(tree, *t) for t in sorted((int(k), g, (d[1], d[2])) for k, g, d in zip(key, h, data))[:psi]]
    size = min(psi, rows)
    for n in (1, 3, 17):
        got = _kept(IF.sample_trees(df.repartition(n), ["x", "y"], ["id"], trees, size, 3, rows))
        assert got == sorted(want) and len(got) == trees * size


def test_forest_sample_survives_a_bound_that_was_too_low(spark):
    df = spark.range(500).select("id", IF.F.col("id").cast("double").alias("x"))
    right = _kept(IF.sample_trees(df, ["x"], ["id"], 5, 50, 1, 500))
    assert _kept(IF.sample_trees(df, ["x"], ["id"], 5, 50, 1, 500_000)) == right  # takes a row count far too high


def test_silhouettes_of_all_k_in_one_pass_equal_the_evaluator(spark):
    """To 1e-9, with a cluster of one row; slices don't change them."""
    from areascope.operators import kmeans_batch as KB
    from areascope.operators import models as MO
    rng = np.random.default_rng(3)
    data = np.vstack([rng.normal(c, 0.6, (120, 3)) for c in (0, 3, 7)] + [[[60.0, 60.0, 60.0]]])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(data)], "id long, a double, b double, c double")
    cols = ["a", "b", "c"]
    model = KB.MultiKMeans([2, 3, 4, 5], n_init=2, seed=5).fit(df, cols, ["id"])
    got = dict(KB.silhouettes(df, cols, model))
    for k in (2, 3, 4, 5):
        want = MO.silhouette(MO.assemble(KB.assign(df, cols, model.centers_of(k)), cols))
        assert got[k] == pytest.approx(want, abs=1e-9)


def test_scoring_all_k_is_one_pass(spark):
    """One job for all k, where the evaluator needs one or more for each."""
    from areascope.operators import kmeans_batch as KB
    df = spark.range(300).select("id", (IF.F.col("id") % 7).cast("double").alias("a"))
    model = KB.MultiKMeans([3, 4, 5], n_init=1).fit(df, ["a"], ["id"])
    spark.sparkContext.setJobGroup("sil", "silhouettes")
    got = KB.silhouettes(df, ["a"], model)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("sil")
    spark.sparkContext.setJobGroup("", "")
    assert len(got) == 3 and len(jobs) <= 2  # a shuffle stage that AQE submits, and the result
