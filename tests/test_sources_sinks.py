"""Feed scan (null tokens, corrupt files), inventories and writers."""

import datetime as dt
import json
import os
import tempfile

from areascope.operators import master as MA
from areascope.plans import catalog as C
from areascope.plans import runs as RU
from areascope.sources import (cached, export_report, file_inventory, refresh, require_columns, scan_feed,
                               select_existing)
from areascope.sources import testdata as TD

SF = "/root/testdata/sf0.001"


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(text)


def test_scan_feed_null_tokens_and_parts(spark):
    d = tempfile.mkdtemp(prefix="areascope-feed-")
    _write(d, "a.csv", "date,state,district,pincode,bio_age_5_17,bio_age_17_\n01-03-2025,Goa,NA,403001,1,2\n")
    _write(d, "b.csv", "date,state,district,pincode,bio_age_5_17,bio_age_17_\n02-03-2025,Goa,X,403001,nan,3\n")
    _write(d, "notes.txt", "not a feed part")
    df = scan_feed(spark, d, "bio", with_file=True)
    rows = sorted(df.collect(), key=lambda r: r.date)
    assert len(rows) == 2 and rows[0].district is None and rows[1].bio_age_5_17 is None
    inv = {r.file_name: r for r in file_inventory(df).collect()}
    assert set(inv) == {"a.csv", "b.csv"}
    assert inv["a.csv"].rows == 1 and inv["a.csv"].nulls_district == 1 and inv["a.csv"].duplicate_rows == 0


def test_require_and_select_existing(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert select_existing(df, ["b", "zz", "a"]).columns == ["b", "a"]
    try:
        require_columns(df, ["a", "c"])
        raise AssertionError("expected failure")
    except ValueError as e:
        assert "'c'" in str(e)


def test_cache_and_refresh(spark):
    df = cached(spark.range(10))
    assert df.count() == 10 and df.is_cached
    refresh(spark)
    assert not spark.range(10).is_cached


def test_export_report_date_stamp(spark):
    d = tempfile.mkdtemp(prefix="areascope-export-")
    df = spark.createDataFrame([("goa", 3)], "state string, n int")
    target = export_report(df, d, "state_report", dt.date(2025, 3, 1), {"state": "State", "n": "Records"})
    assert target.endswith("state_report_20250301")
    back = spark.read.option("header", True).csv(target).collect()
    assert back[0].State == "goa" and back[0].Records == "3"


def test_cleaning_run_writes_master_once(spark):
    d = tempfile.mkdtemp(prefix="areascope-master-")
    out = RU.cleaning_run(TD.raw_feeds(spark, SF), TD.valid_states(spark, SF), path=f"{d}/master")
    assert out["master"].count() == C.fresh_master(spark, SF).count()
    assert out["master"].columns == MA.master_columns()
    # master rows >= largest feed and <= sum of feeds (full outer merge of unique keys)
    sizes = [out[f].count() for f in MA.FEEDS]
    assert max(sizes) <= out["master"].count() <= sum(sizes)
    # per-feed tables recovered from the master conserve each feed's total
    for f in MA.FEEDS:
        s = MA.SUFFIX[f]
        tot = out["master"].agg({f"total_activity{s}": "sum"}).first()[0]
        assert abs(out[f].agg({"total_activity": "sum"}).first()[0] - tot) < 1e-6


def test_write_model_outputs(spark):
    d = tempfile.mkdtemp(prefix="areascope-out-")
    run = RU.model_run(C.master_table(spark, SF), n_init=1, k_min=3, k_max=3, n_trees=10)
    RU.write_model_outputs(run, d)
    for name in ("ml_full_output", "cluster_summary", "high_risk_regions", "monthly_alerts", "state_summary"):
        assert os.path.isdir(f"{d}/outputs/{name}")
    meta = [json.loads(line) for fn in os.listdir(f"{d}/ml_metadata") if fn.endswith(".json")
            for line in open(f"{d}/ml_metadata/{fn}")]
    assert meta[0]["statistics"]["total_locations"] == run.result.count()
    assert meta[0]["configuration"]["n_clusters"] == 3
    assert os.path.isdir(f"{d}/models/kmeans_centers") and os.path.isdir(f"{d}/models/forest")


HEAD = "date,state,district,pincode,bio_age_5_17,bio_age_17_"


def test_parts_are_united_by_column_name(spark, tmp_path):
    """Another order, a missing, an extra and a quoted column, a byte order mark: all rows arrive in their columns."""
    from areascope.sources import feed_inventory, scan_feed
    _write(tmp_path, "a.csv", f"{HEAD}\n01-01-2025,x,y,100000,1,2\n")
    _write(tmp_path, "b.csv", "bio_age_17_,pincode,district,state,date\n4,100001,\"y, z\",x,02-01-2025\n")
    _write(tmp_path, "c.csv", f"\ufeff\"extra.col\",{HEAD}\nq,03-01-2025,NA,y,100002,5,6\n")
    _write(tmp_path, "d.csv", f"{HEAD}\n04-01-2025,x,y,100003,7\n")
    rows = sorted(tuple(r) for r in scan_feed(spark, str(tmp_path), "bio").collect())
    assert rows == [("01-01-2025", "x", "y", "100000", "1", "2"), ("02-01-2025", "x", "y, z", "100001", None, "4"),
                    ("03-01-2025", None, "y", "100002", "5", "6"), ("04-01-2025", "x", "y", "100003", "7", None)]
    found = {r.file_name: r for r in feed_inventory(spark, str(tmp_path), "bio").collect()}
    assert [found[n].rows for n in ("a.csv", "b.csv", "c.csv", "d.csv")] == [1, 1, 1, 1]
    assert found["b.csv"].missing_columns == ["bio_age_5_17"] and found["c.csv"].extra_columns == ["extra.col"]
    assert {r.status for r in found.values()} == {"ok"}


def test_unreadable_parts_fail_the_run_and_are_listed(spark, tmp_path):
    import pytest
    from areascope.sources import feed_inventory, scan_feed
    _write(tmp_path, "a.csv", f"{HEAD}\n01-01-2025,x,y,100000,1,2\n")
    _write(tmp_path, "empty.csv", "")
    _write(tmp_path, "other.csv", "name,age\nx,1\n")
    with pytest.raises(ValueError, match="2 unreadable parts.*empty.csv: no header.*other.csv"):
        scan_feed(spark, str(tmp_path), "bio")
    found = {r.file_name: (r.status, r.error, r.rows) for r in feed_inventory(spark, str(tmp_path), "bio").collect()}
    assert found == {"a.csv": ("ok", None, 1), "empty.csv": ("unreadable", "no header", 0),
                     "other.csv": ("unreadable", "no column of the feed", 0)}
    assert scan_feed(spark, str(tmp_path), "bio", skip_corrupt_files=True).count() == 1


def test_rows_with_too_many_cells(spark, tmp_path):
    import pytest
    from areascope.sources import feed_inventory, scan_feed
    _write(tmp_path, "a.csv", f"{HEAD}\n01-01-2025,x,y,100000,1,2\n")
    _write(tmp_path, "b.csv", f"{HEAD}\n01-01-2025,x,y,100000,1,2\n01-01-2025,x,y,100000,1,2,3\n")
    with pytest.raises(Exception, match="more cells than columns in b.csv"):
        scan_feed(spark, str(tmp_path), "bio").select("state").collect()
    found = {r.file_name: (r.status, r.rows, r.long_rows) for r in feed_inventory(spark, str(tmp_path), "bio").collect()}
    assert found == {"a.csv": ("ok", 1, 0), "b.csv": ("unreadable", 2, 1)}
    assert scan_feed(spark, str(tmp_path), "bio", skip_corrupt_files=True).count() == 1


def test_one_scan_for_each_distinct_header(spark, tmp_path):
    from areascope.sources import scan_feed
    for i in range(4):
        _write(tmp_path, f"a{i}.csv", f"{HEAD}\n01-01-2025,x,y,100000,1,2\n")
        _write(tmp_path, f"b{i}.csv", "pincode,state\n100000,x\n")
    df = scan_feed(spark, str(tmp_path), "bio")
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2 and df.count() == 8


def test_empty_folder_of_parts(spark, tmp_path):
    from areascope.sources import feed_inventory, scan_feed
    _write(tmp_path, "notes.txt", "x")
    assert scan_feed(spark, str(tmp_path), "bio").count() == 0
    assert feed_inventory(spark, str(tmp_path), "bio").collect() == []
