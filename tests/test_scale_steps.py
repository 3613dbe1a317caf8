"""Steps that decide how the runs grow: block passes, written results, compiled stages, counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from areascope.functions import coerce_count, parse_date
from areascope.operators import iforest as IF
from areascope.operators import kmeans_batch as KB
from areascope.plans import runs as RU
from areascope.session import compile_stages, keep_table


def test_blocks_hold_every_row_once_and_give_the_same_pass(spark, monkeypatch):
    monkeypatch.setattr(KB, "_BLOCK_ROWS", 70)
    rng = np.random.default_rng(2)
    X = rng.normal(size=(500, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(X)], "id int, a double, b double")
    data = df.select(F.xxhash64("id").alias("_h"), "a", "b").repartition(3)
    packed = KB.blocks(data, ["a", "b"])
    got = [(h, *x) for hs, rows in KB._unpacked([packed.toPandas()], ["a", "b"]) for h, x in zip(hs, rows)]
    assert sorted(got) == sorted((r["_h"], r["a"], r["b"]) for r in data.collect())
    mk = KB.MultiKMeans([2, 3], n_init=1)
    centers = {0: X[:2].copy(), 1: np.vstack([X[10:12], X[11:12]])}  # two equal centres: the first takes the rows
    plain, blocked = (mk._lloyd_pass(d, ["a", "b"], centers, [0, 1]) for d in (data, packed))
    for r in centers:
        assert np.allclose(plain[r][0], blocked[r][0]) and plain[r][1] == pytest.approx(blocked[r][1])
    assert blocked[1][2][0][2] == 0 and blocked[1][2][0].sum() == 500


def test_fit_caches_blocks_not_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(KB.MultiKMeans, "_fit", lambda self, data, cols, scale: seen.append(data.columns))
    df = spark.range(50).select("id", F.col("id").cast("double").alias("x"))
    KB.MultiKMeans([2], n_init=1).fit(df, ["x"], ["id"])
    assert seen == [["_hashes", "_rows"]]


def test_kept_tables_are_files_with_the_same_rows_and_types(spark):
    df = spark.range(20).select("id", F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("x"), F.lit("text").alias("t"))
    kept = keep_table(df, "some")
    assert kept.schema.simpleString() == df.schema.simpleString() and len(kept.inputFiles()) > 0
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_model_run_reads_its_scores_and_result_from_files(spark, monkeypatch):
    """Rows are scored once: the offset and the ranks read the written scores."""
    read = []
    scores = IF.decision_scores
    monkeypatch.setattr(RU.IF, "decision_scores", lambda df: (read.append(df.inputFiles()), scores(df))[1])
    rows = [(f"2020-{m:02d}", "s", f"d{a % 3}", 100000 + a, *[float((a * 7 + m * c) % 11) for c in range(1, 17)])
            for a in range(20) for m in range(1, 5)]
    from areascope.operators.master import master_columns
    cols = [c for c in master_columns() if c not in ("year_month", "state", "district", "pincode")]
    master = spark.createDataFrame(rows, "year_month string, state string, district string, pincode int, "
                                   + ", ".join(f"{c} double" for c in cols))
    run = RU.model_run(master, n_init=1, k_max=3, n_trees=5)
    assert read and read[0] and run.result.inputFiles() and run.result.count() == 80


def test_method_limit_is_set_unless_the_session_has_its_own(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        compile_stages(spark)
        assert spark.conf.get(key) == "8000"
        spark.conf.set(key, "20000")
        compile_stages(spark)
        assert spark.conf.get(key) == "20000"
    finally:
        spark.conf.set(key, before)


def test_counts_of_plain_digits_equal_those_of_other_texts(spark):
    want = {"7": 7, "007": 7, "123456789012345": 123456789012345, "12.7": 12, " 5 ": 5, "-3": -3, "+4": 4, "1e2": 100, "": 0,
            "x": 0, "12d": 0, "1234567890123456": 1234567890123456, "3\n": 3, "1 2": 0, "٣": 0, None: 0}
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", coerce_count("t").alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == want


def test_dates_read_without_the_pattern_parser_equal_it(spark):
    texts = ["01-02-2020", "1-2-2020", "31-02-2021", "29-02-2020", "29-02-2021", "00-01-2020", "12-13-2020", "01-01-0000",
             "01-01-0001", "01-02-2020\n", " 01-02-2020", "2020-01-02", "01-02-20201", "aa-bb-cccc", "", None, "01/02/2020"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *[c.cast("string").alias(n) for n, c in (("d", parse_date("t")), ("e", F.try_to_date("t", "d-M-yyyy")))]).collect()
    assert all(r["d"] == r["e"] for r in got)
    assert got[0]["d"] == "2020-02-01" and got[2]["d"] is None
    plan = df.select(parse_date("t").alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan


def test_cleaning_parses_each_value_once(spark):
    """The date is parsed and the state looked up where their columns are made, not again in a filter or a join."""
    from areascope.operators.clean import standardise_feed
    rows = [("01-03-2025", " GOA ", "North  *", "403001", "5", "1.9"), ("31-02-2025", "Goa", "X", "403001", "1", "1"),
            ("2-3-2025", "\u00a0Goa\t", None, "403002", "x", " 12 "), (None, "Goa", "X", "403001", "1", "1"),
            ("02-03-2025", "Orissa", "a\x0bb", "751001", "7f", "123456789012345")]
    raw = spark.createDataFrame(rows, "date string, state string, district string, pincode string, "
                                      "bio_age_5_17 string, bio_age_17_ string")
    made = raw.withColumn("date", F.concat("date", F.lit("")))  # as an adapter makes it: not a plain column
    out = standardise_feed(made, "bio", ["goa", "odisha"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp") == 1 and plan.count("uttaranchal") == 1 and plan.count("concat(date") == 1
    got = sorted((str(r["date"]), r["state"], r["district"], r["pincode"], r["updates_age_5_17"], r["updates_age_18_plus"])
                 for r in out.collect())
    assert got == [("2025-03-01", "goa", "north ", 403001, 5, 1), ("2025-03-02", "goa", None, 403002, 0, 12),
                   ("2025-03-02", "odisha", "a b", 751001, 0, 123456789012345)]


def test_kmeans_passes_read_small_pieces_from_the_shared_folder_and_leave_no_files(spark, monkeypatch):
    """No pass depends on cached partitions, whose size is that of the input's partitions; block sums stay the same."""
    import os
    from areascope.session import checkpoint_dir
    monkeypatch.setattr(KB, "_PIECE_ROWS", 64)
    monkeypatch.setattr(KB, "_BLOCK_ROWS", 256)
    df = spark.createDataFrame([(i, float(i % 7), float(i % 13)) for i in range(1000)], "id int, a double, b double").coalesce(1)
    folder = checkpoint_dir(spark).removeprefix("file:")
    cached, before, seen = set(spark.sparkContext._jsc.getPersistentRDDs()), set(os.listdir(folder)), []

    def look(self, data, cols, scale):
        rows = data.collect()
        seen.append(set(spark.sparkContext._jsc.getPersistentRDDs()) - cached)
        seen.append([len(r["_hashes"]) // 8 for r in rows])
        seen.append([len(h) for h, _ in KB._unpacked([data.toPandas()], cols)])
        seen.append(set(os.listdir(folder)) - before)

    monkeypatch.setattr(KB.MultiKMeans, "_fit", look)
    KB.MultiKMeans([2], n_init=1).fit(df, ["a", "b"], ["id"])
    held, pieces, blocks, files = seen
    assert not held and max(pieces) == 64 and sum(pieces) == 1000 and blocks == [256, 256, 256, 232]
    assert files and set(os.listdir(folder)) == before


def test_slices_of_a_pass_share_their_room(monkeypatch):
    """What a slice leaves in the shared arrays changes nothing in the next, shorter or with equal centres."""
    rng = np.random.default_rng(8)
    weights, groups = rng.normal(size=(5, 4)), [(2, 1), (3, 1)]
    weights[3] = weights[2]
    room = np.full((2, 5 * 40), np.nan)
    made = []
    empty = np.empty
    monkeypatch.setattr(KB.np, "empty", lambda *a, **k: (made.append(a), empty(*a, **k))[1])
    for n in (40, 7, 40, 1):
        x = rng.normal(size=(n, 3))
        rows = np.hstack([x, np.ones((n, 1)), (x * x).sum(1)[:, None]])
        del made[:]
        got = KB._nearest_sums(weights, groups, rows, room)
        assert not made and np.array_equal(got, KB._nearest_sums(weights, groups, rows))
        assert got[:2, 3].sum() == got[2:, 3].sum() == n and got[3, 3] == 0


def test_ranks_of_few_values_meet_the_rows_where_they_are(spark, monkeypatch, tmp_path):
    """No row is shuffled or read twice for them; many values are joined, with and without missing ones alike."""
    from areascope.operators import ranking as RK
    rows = [(i, None if i % 11 == 0 else float(i * 7 % 23)) for i in range(400)]
    spark.createDataFrame(rows, "id int, v double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    few = RK.rank_pct(df, "v", "p")
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("parquet") == 1 and "broadcast" in plan
    want = sorted((r["id"], r["p"]) for r in few.collect())
    known = sorted(v for _, v in rows if v is not None)
    assert want == [(i, None if v is None else (known.index(v) + (known.count(v) + 1) / 2) / len(known)) for i, v in rows]
    monkeypatch.setattr(RK, "MAX_BROADCAST_ROWS", 5)
    assert sorted((r["id"], r["p"]) for r in RK.rank_pct(df, "v", "p").collect()) == want
    whole = RK.rank_pct(df.filter("v is not null"), "v", "p")
    assert "Union" not in whole._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], r["p"]) for r in whole.collect()) == [x for x in want if x[1] is not None]


def test_result_table_holds_levels_and_readers_make_the_texts(spark):
    from areascope.operators import outputs as OU
    rows = [(f"2025-0{1 + i % 3}", "goa", f"d{i % 4}", 403000 + i // 3, float(i % 50), 1.0, 1.0, 1.0, 0.2, 0.3, 0.5, float(i % 3),
             1.0, 20.0, -0.4 if i % 5 == 0 else 0.1, float(i % 7), i % 3, -0.1 + i / 500, int(i < 30)) for i in range(90)]
    names = [*RU.KEPT, "cluster_id", "anomaly_score", "is_anomaly"]
    df = spark.createDataFrame(rows, names)
    kept = RU.explain_rows(df, kept="result")
    files = [f for f in kept.inputFiles() if "/result_" in f]
    stored = spark.read.parquet(files[0].rpartition("/")[0])
    texts = {"risk_explanation", "risk_reason", "insight_summary", "cluster_description", "policy_recommendation"}
    assert not texts & set(stored.columns) and {"risk_category", "trend_status", "cluster_profile_id"} <= set(stored.columns)
    plain = RU.explain_rows(df)
    assert kept.columns == plain.columns and stored.count() == 90
    assert sorted(map(tuple, OU.full_output(kept).collect())) == sorted(map(tuple, OU.full_output(plain).collect()))


def test_seeding_draws_the_rows_of_the_smallest_keys_with_few_distances(spark, monkeypatch):
    """Rows that cannot be drawn are left out by a bound; the rows drawn are those of all keys, worked out plainly."""
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(c, 1.0, (3000, 3)) for c in (0.0, 4.0, 30.0)] + [np.zeros((500, 3)), [[500.0, 0.0, 0.0]]])
    h = rng.integers(-(1 << 62), 1 << 62, len(X))
    logged = []
    log = np.log
    monkeypatch.setattr(KB.np, "log", lambda u: (logged.append(u.size), log(u))[1])

    class Rows:  # one task over many small blocks, run here so that the distances are counted
        def mapInPandas(self, fn, schema):
            import pandas as pd
            out = fn(iter([pd.DataFrame({"_h": h[i:i + 500], **{c: X[i:i + 500, j] for j, c in enumerate("abc")}})
                           for i in range(0, len(X), 500)]))
            return spark.createDataFrame(pd.concat(list(out)), schema)

    m = KB.MultiKMeans([2, 4], 3, 7)
    centers = {r: [] for r in range(6)}
    for step in range(4):
        drawn = m._seed_pass(Rows(), list("abc"), centers, step)
        for r in (r for r, (k, _) in enumerate(m.runs) if k > step):
            u = KB._uniform(h, 7 * 1_000_003 + r * 101 + step)
            w = np.min([((X - c) ** 2).sum(1) for c in centers[r]], axis=0) if step else np.ones(len(X))
            with np.errstate(divide="ignore"):
                assert np.array_equal(drawn[r], X[np.argmin(np.where(w > 1e-9, -log(u) / w, np.inf))])
            centers[r].append(drawn[r])
    assert sum(logged) < 0.5 * len(X) * 18  # 18 draws; before, all rows were worked out for each


def test_forest_walk_keeps_leaves_and_takes_one_level_a_step():
    import pandas as pd
    rng = np.random.default_rng(4)
    X = rng.normal(size=(300, 4))
    trees = [IF.grow_tree(X[:n], rng, 8) for n in (1, 2, 200)]
    nodes = pd.concat([pd.DataFrame({"tree": t, "node": range(len(c[0])), **dict(zip(["feature", "threshold", "left", "right", "size"], c))})
                       for t, c in enumerate(trees)])
    forest = IF._forest_arrays(nodes)
    want = np.zeros((len(X), 3))
    for t, (feature, threshold, left, right, size) in enumerate(trees):
        for i, x in enumerate(X):
            node = depth = 0
            while feature[node] >= 0:
                node, depth = (left if x[feature[node]] <= threshold[node] else right)[node], depth + 1
            want[i, t] = depth + IF.average_path_length(np.array([size[node]]))[0]
    assert forest["levels"] <= 8 and np.array_equal(IF.path_lengths(X, forest), want.mean(axis=1))
