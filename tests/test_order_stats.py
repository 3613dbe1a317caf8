"""Exact order statistics against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from areascope.operators import clean as CL
from areascope.operators import order_stats as OS
from areascope.operators import profile as PR
from areascope.operators import reports as RE

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]


def _frame(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"g": rng.choice(["a", "b", "c", None], n, p=[0.6, 0.3, 0.05, 0.05]), "x": rng.normal(size=n),
                         "k": rng.integers(0, 4, n).astype(float), "hot": np.where(rng.random(n) < 0.7, 5.0, rng.random(n))})


@pytest.mark.parametrize("range_values", [250_000, 100])
def test_quantiles_equal_numpy_however_the_values_are_dealt(spark, range_values):
    pdf = _frame()
    counts = OS.value_counts(spark.createDataFrame(pdf), ["x", "k", "hot"])
    got = {r["column"]: r["q"] for r in OS.counted_quantiles(counts, PROBS, range_values=range_values).collect()}
    for c in ("x", "k", "hot"):
        assert np.allclose(got[c], np.quantile(pdf[c], PROBS), rtol=0, atol=1e-12)


@pytest.mark.parametrize("range_values", [250_000, 37])
def test_quantiles_by_group_with_a_null_group(spark, range_values):
    pdf = _frame(1500, 2)
    counts = OS.value_counts(spark.createDataFrame(pdf), ["x", "hot"], ["g"])
    rows = OS.counted_quantiles(counts, PROBS, ["g"], range_values).collect()
    assert len(rows) == 8
    for r in rows:
        own = pdf[pdf.g.isna()] if r["g"] is None else pdf[pdf.g == r["g"]]
        assert np.allclose(r["q"], np.quantile(own[r["column"]], PROBS), rtol=0, atol=1e-12)


def test_missing_values_and_empty_tables(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "x double, y double")
    assert OS.quantile_values(df, ["x", "y"], [0.5]) == {"x": [2.0]}
    assert OS.quantile_values(df.limit(0), ["x"], [0.5]) == {}
    assert [(r["column"], r["nulls"], r["mean"], r["p99"]) for r in PR.numeric_profile(df, ["y"]).collect()] == [("y", 4, None, None)]
    assert PR.numeric_profile(df.limit(0), ["x"]).first()["nulls"] == 0
    assert [tuple(r) for r in PR.outlier_counts(df.limit(0), ["x"]).collect()] == [("x", None, None, 0, 0)]
    assert [r["x"] for r in CL.cap_at_percentile(df.select("x"), ["x"], 0.5).collect()][:1] == [1.0]
    assert [r["y"] for r in CL.cap_at_percentile(df, ["y"]).collect()] == [None] * 4


def test_numeric_profile_equals_pandas(spark):
    pdf = _frame(800, 5)
    pdf.loc[::7, "x"] = np.nan
    got = PR.numeric_profile(spark.createDataFrame(pdf), ["x", "k"]).toPandas().set_index("column")
    for c in ("x", "k"):
        s = pdf[c]
        want = [s.isna().sum(), s.min(), s.max(), s.mean(), s.median(), s.std(), (s < 0).sum(), (s == 0).sum(), s.quantile(0.99)]
        assert np.allclose(got.loc[c, ["nulls", "min", "max", "mean", "median", "std", "negatives", "zeros", "p99"]]
                           .to_numpy(float), want)


def test_no_value_map_in_one_reducer(spark):
    """Equal values are combined before the shuffle, and no plan holds a percentile aggregate."""
    df = spark.range(1000).select((F.col("id") % 3).alias("x"))
    counts = OS.value_counts(df, ["x"])
    assert counts.count() == 3
    plan = OS.counted_quantiles(counts, [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower()


def test_box_stats_from_counted_values(spark):
    pdf = pd.DataFrame({"g": ["a"] * 6 + [None] * 2, "x": [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, 7.0, 9.0]})
    rows = {r["g"]: r for r in RE.box_stats(spark.createDataFrame(pdf), "g", "x").collect()}
    a = rows["a"]
    assert (a["q1"], a["median"], a["q3"], a["min"], a["max"], a["whisker_low"], a["whisker_high"]) == (2.25, 3.5, 4.75, 1, 100, 1, 5)
    assert rows[None]["median"] == 8.0


def test_quantiles_do_not_count_missing_values(spark):
    """Rows that lack a column's value (of other feeds, say) are dropped ahead of the count; the quantiles stay."""
    rows = [(float(i), None if i % 5 else float(i), float("nan")) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    counts = OS.value_counts(df, ["a", "b", "c"], missing=False)
    assert counts.filter("value is null").count() == 0 and counts.agg({"n": "sum"}).first()[0] == 60
    assert OS.quantile_values(df, ["a", "b", "c"], [0.5]) == {"a": [24.5], "b": [22.5]}
