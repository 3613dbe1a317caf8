"""The driver imports __spark_entry__ by path from another directory with its own
plain session: executor Python workers must still import the package."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_python_workers_from_foreign_cwd(tmp_path):
    script = textwrap.dedent(f"""
        import importlib.util
        spec = importlib.util.spec_from_file_location("entry_mod", "{REPO}/__spark_entry__.py")
        E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "4").getOrCreate())
        assert E.entry(spark).count() > 0
        from areascope.operators import iforest as IF, kmeans_batch as KB
        df = spark.range(300).selectExpr("id", "cast(id % 17 as double) as x", "cast(id % 5 as double) as y")
        nodes, psi = IF.fit_iforest(df, ["x", "y"], ["id"], n_trees=5)
        assert IF.score_samples(df, nodes, psi, ["x", "y"]).filter("iforest_score < 0").count() == 300
        mk = KB.MultiKMeans([2], n_init=2).fit(df, ["x", "y"], ["id"])
        assert KB.assign(df, ["x", "y"], mk.centers_of(2)).select("cluster_id").distinct().count() == 2
        print("CONTRACT-OK")
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "CONTRACT-OK" in out.stdout, out.stderr[-3000:]


def test_command_line_clean_and_model(tmp_path):
    env = dict(os.environ, PYTHONPATH=REPO)
    out = str(tmp_path / "run")
    for cmd in (["clean", "--tables", "/root/testdata/sf0.001"], ["model", "--n-init", "1", "--trees", "10"]):
        res = subprocess.run([sys.executable, "-m", "areascope", *cmd, "--out", out, "--master", "local[2]"],
                             cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
        assert res.returncode == 0, res.stderr[-3000:]
    for name in ("master", "bio_cleaned", "outputs/ml_full_output", "outputs/state_summary", "ml_metadata",
                 "models/forest", "models/scaler"):
        assert os.path.isdir(os.path.join(out, name)), name
