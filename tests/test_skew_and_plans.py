"""A hot key (a third of all rows) is combined before the shuffle; plans keep
the shapes the design relies on."""

import pytest
from pyspark.sql import functions as F

from areascope.operators import order_stats as OS
from areascope.operators import features as FE
from areascope.operators import master as MA
from areascope.operators import profile as PR
from areascope.operators import ranking as RK
from areascope.operators._util import attach_groups
from areascope.plans import catalog as C


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_master_hot_key_exact_and_partially_aggregated(spark):
    hot = spark.range(3000).select(F.lit("01-03-2025").alias("date"), F.lit("Goa").alias("state"),
                                   F.lit("X").alias("district"), F.lit("403001").alias("pincode"),
                                   F.lit("1").alias("bio_age_5_17"), F.lit("2").alias("bio_age_17_"))
    cold = spark.range(6000).select(
        F.format_string("%02d-03-2025", (F.col("id") % 28 + 1).cast("int")).alias("date"), F.lit("Goa").alias("state"),
        F.lit("Y").alias("district"), (F.lit(500000) + F.col("id") % 997).cast("string").alias("pincode"),
        F.lit("1").alias("bio_age_5_17"), F.lit("0").alias("bio_age_17_"))
    bio = hot.unionByName(cold)
    empty_demo = spark.createDataFrame([], "date string, state string, district string, pincode string, "
                                           "demo_age_5_17 string, demo_age_17_ string")
    empty_enrol = spark.createDataFrame([], "date string, state string, district string, pincode string, "
                                            "age_0_5 string, age_5_17 string, age_18_greater string")
    m = MA.build_master({"bio": bio, "demo": empty_demo, "enrol": empty_enrol})
    row = m.filter("district = 'x'").first()
    assert row.updates_age_5_17_bio == 3000
    # 18+ values are 2 (a third of rows) and 0: p99 = 2, nothing capped
    assert row.updates_age_18_plus_bio == 6000
    assert m.agg(F.sum("updates_age_5_17_bio")).first()[0] == pytest.approx(9000)
    plan = _plan(m)
    assert "partial_sum" in plan                      # map-side combine before the shuffle
    assert plan.count("Exchange hashpartitioning") == 1  # one shuffle for the whole master


@pytest.fixture
def hot_district(spark):
    """3000 areas of three months; one district holds a third of them, some have none."""
    row = spark.range(9000).select((F.col("id") / 3).cast("int").alias("area"), (F.col("id") % 3 + 1).alias("month"))
    return row.select(
        F.format_string("2025-%02d", "month").alias("year_month"), F.when(F.col("area") % 2 == 0, "goa").otherwise("kerala").alias("state"),
        F.when(F.col("area") % 3 == 0, "hot").when(F.col("area") % 50 == 1, None)
        .otherwise(F.concat(F.lit("d"), F.col("area") % 40)).alias("district"),
        (F.lit(100000) + F.col("area")).alias("pincode"),
        *[(F.col("area") % (i + 3) + F.col("month")).cast("long").alias(c)
          for i, c in enumerate(FE.BIO_COLS + FE.DEMO_COLS + FE.ENROL_COLS)])


def test_windows_run_by_area_without_broadcast_joins(spark, hot_district):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(FE.build_features(hot_district).select("district", "activity_vs_district_mean",
                                                            "total_activity_volatility"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(state") == 1     # the windows, by area
    assert plan.count("Exchange hashpartitioning(district") == 1  # partial statistics of the districts
    assert "partial_avg" in plan and "SortMergeJoin" not in plan


def test_salted_group_join_equals_broadcast(spark, hot_district):
    df = FE.activity_totals(hot_district)
    stats = FE.district_stats(df)
    one = attach_groups(df, stats, ["district"])
    two = attach_groups(df, stats, ["district"], max_rows=3)
    assert one.columns == two.columns
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert "hashpartitioning(district" in _plan(two) and "_salt" in _plan(two)


def test_rank_pct_keeps_null_rows_out_of_the_join(spark):
    df = spark.range(400).select(F.when(F.col("id") % 4 > 0, F.col("id") % 10).alias("v"), "id")
    got = {r.id: r.rank_pct for r in RK.rank_pct(df, "v").collect()}
    values = [i % 10 for i in range(400) if i % 4]
    for i in range(400):
        below, ties = sum(v < i % 10 for v in values), values.count(i % 10)
        assert got[i] == (pytest.approx((below + (ties + 1) / 2) / len(values)) if i % 4 else None)


def test_profiles_scan_once(spark, tmp_path, monkeypatch):
    """Counted values are cut off by a checkpoint: the scans of what is written there count as well."""
    spark.range(100).selectExpr("id % 7 as a", "id as b", "cast(null as string) as c").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    written = []
    monkeypatch.setattr(OS, "cut_lineage", lambda d, cut=OS.cut_lineage: (written.append(_plan(d)), cut(d))[1])
    for make in (lambda: PR.numeric_profile(df, ["a", "b"]), lambda: PR.outlier_counts(df, ["a", "b"]),
                 lambda: PR.column_duplicates(df)):
        written.clear()
        last = _plan(make())
        assert sum(plan.count("FileScan") for plan in [*written, last]) == 1
    assert {r["column"]: r.duplicated_rows for r in PR.column_duplicates(df).collect()} == {"a": 100, "b": 0, "c": 100}
    assert {r["column"]: r.duplicated_rows for r in PR.column_duplicates(df.limit(0)).collect()} == {"a": 0, "b": 0, "c": 0}


def test_features_single_window_shuffle(spark):
    f = FE.build_features(C.master_table(spark, "/root/testdata/sf0.001"))
    plan = _plan(f.select(*FE.TEMPORAL_METRICS, "total_activity_volatility", "activity_vs_district_mean"))
    # one exchange by area for the windows + one for the (partial) district aggregate
    assert plan.count("Exchange hashpartitioning(state") == 1
    assert "partial_avg" in plan
