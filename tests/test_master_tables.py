"""Bucketed feeds merged without a shuffle, the master by month, and caches that follow the files."""

import os
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from areascope.operators import clean as CL
from areascope.operators import master as MA
from areascope.plans import catalog as C
from areascope.session import checkpoint_dir
from areascope.sources import files_version
from areascope.sources import testdata as TD

SF_SMALL = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(repr, df.collect()))


def _near(left, right):
    """Equal keys, and values that differ by the order of a sum at most."""
    rounded = [df.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]) for df in (left, right)]
    assert left.columns == right.columns and _rows(rounded[0]) == _rows(rounded[1])


@pytest.fixture(scope="module")
def raw(spark):
    feeds = {f: df.persist() for f, df in TD.raw_feeds(spark, SF_SMALL).items()}
    yield feeds
    for df in feeds.values():
        df.unpersist()


def test_written_feeds_merge_without_exchange(spark, raw):
    valid = TD.valid_states(spark, SF_SMALL)
    tables = MA.write_feeds(raw, checkpoint_dir(spark), "merge_test", valid, buckets=5)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        merged = MA.merge_written(spark, tables)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "SelectedBucketsCount" in plan
        feeds = [CL.clean_feed(raw[f], f, valid) for f in MA.FEEDS]
        _near(merged, MA.merge_feeds(*feeds))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert merged.count() == MA.build_master(raw, valid).count()


def test_written_feeds_hot_area_and_empty_feed(spark):
    n = 600
    day = F.format_string("%02d-%02d-2025", (F.col("id") % 28 + 1).cast("int"), (F.col("id") % 12 + 1).cast("int"))
    hot = spark.range(n).select(day.alias("date"), F.lit("Goa").alias("state"), F.lit("X").alias("district"),
                                F.when(F.col("id") % 3 == 0, "403001").otherwise(
                                    (F.lit(500000) + F.col("id")).cast("string")).alias("pincode"),
                                F.lit("1").alias("bio_age_5_17"), F.lit("2").alias("bio_age_17_"))
    none = {f: spark.createDataFrame([], ", ".join(f"{c} string" for c in ["date", "state", "district", "pincode", *cols]))
            for f, cols in (("demo", ["demo_age_5_17", "demo_age_17_"]), ("enrol", ["age_0_5", "age_5_17", "age_18_greater"]))}
    feeds = {"bio": hot, **none}
    tables = MA.write_feeds(feeds, checkpoint_dir(spark), "hot_test", buckets=3)
    _near(MA.merge_written(spark, tables), MA.build_master(feeds))
    tables = MA.write_feeds({**feeds, "bio": hot.limit(0)}, checkpoint_dir(spark), "empty_test", buckets=3)
    assert MA.merge_written(spark, tables).count() == 0


def _month_files(path):
    return {m: sorted((f, os.path.getmtime(os.path.join(path, m, f))) for f in os.listdir(os.path.join(path, m))
                      if f.endswith(".parquet")) for m in os.listdir(path) if m.startswith("year_month=")}


def test_one_new_month_rewrites_one_folder(spark, tmp_path):
    def feed(rows):
        return spark.createDataFrame(rows, "date string, state string, district string, pincode string, "
                                           "bio_age_5_17 string, bio_age_17_ string")
    none = {f: spark.createDataFrame([], ", ".join(f"{c} string" for c in ["date", "state", "district", "pincode", *cols]))
            for f, cols in (("demo", ["demo_age_5_17", "demo_age_17_"]), ("enrol", ["age_0_5", "age_5_17", "age_18_greater"]))}
    old = [("01-03-2025", "Goa", "X", "403001", "2", "1"), ("01-04-2025", "Goa", "X", "403001", "1", "1"),
           ("02-04-2025", "Goa", "Y", "403002", "2", "1")]
    path = MA.write_master_by_month({"bio": feed(old), **none}, f"{tmp_path}/master")
    _near(MA.read_master(spark, path), MA.build_master({"bio": feed(old), **none}))
    assert dict(MA.read_master(spark, path).dtypes)["year_month"] == "string"
    before = _month_files(path)
    new = old + [("03-04-2025", "Goa", "Y", "403002", "1", "1"), ("01-05-2025", "Goa", "Z", "403003", "900", "1")]
    MA.refresh_months({"bio": feed(new), **none}, path, ["2025-04", "2025-05"])
    after = _month_files(path)
    assert after["year_month=2025-03"] == before["year_month=2025-03"]
    assert after["year_month=2025-04"] != before["year_month=2025-04"] and set(after) - set(before) == {"year_month=2025-05"}
    got = {(r.year_month, r.district): r.updates_age_5_17_bio for r in MA.read_master(spark, path).collect()}
    # the caps stay those of the whole build: p99 of 1, 2, 2 is 2
    assert got == {("2025-03", "x"): 2, ("2025-04", "x"): 1, ("2025-04", "y"): 3, ("2025-05", "z"): 2}


def test_new_files_under_the_same_path_give_new_answers(spark, tmp_path):
    folder = str(tmp_path / "sf")
    shutil.copytree(SF_SMALL, folder, copy_function=shutil.copyfile)
    one = C.QUERIES["kpis"](spark, folder).collect()
    assert C.master_table(spark, folder).inputFiles() == C.master_table(spark, folder).inputFiles()
    path = f"{folder}/orders.parquet"
    version = files_version(spark, [path])
    orders = pq.read_table(path)
    pq.write_table(orders.slice(0, orders.num_rows // 2), f"{tmp_path}/half.parquet")
    os.replace(f"{tmp_path}/half.parquet", path)
    assert files_version(spark, [path]) != version
    spark.catalog.refreshByPath(path)
    assert C.QUERIES["kpis"](spark, folder).collect() != one
