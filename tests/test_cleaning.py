"""Cleaning and master semantics on hand-made raw feed rows."""

import pytest
from pyspark.sql import functions as F

from areascope.operators import clean as CL
from areascope.operators import master as MA


def bio(spark, rows):
    return spark.createDataFrame(rows, "date string, state string, district string, pincode string, "
                                       "bio_age_5_17 string, bio_age_17_ string")


def demo(spark, rows):
    return spark.createDataFrame(rows, "date string, state string, district string, pincode string, "
                                       "demo_age_5_17 string, demo_age_17_ string")


def enrol(spark, rows):
    return spark.createDataFrame(rows, "date string, state string, district string, pincode string, "
                                       "age_0_5 string, age_5_17 string, age_18_greater string")


def test_cap_at_p99(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    got = sorted(r.x for r in CL.cap_at_percentile(df, ["x"]).collect())
    assert got[-1] == pytest.approx(9.91)
    assert got[:9] == [float(i) for i in range(1, 10)]


def test_standardise_drops_bad_rows(spark):
    raw = bio(spark, [
        ("31-02-2025", "Odisha", "Puri", "752001", "1", "1"),      # bad date
        ("01-03-2025", "Jaipur", "Jaipur", "302001", "1", "1"),    # invalid state
        ("01-03-2025", None, "Puri", "752001", "1", "1"),          # null state
        ("01-03-2025", "Orissa", "Puri", "12345", "1", "1"),       # short pincode
        ("1-3-2025", "Orissa", "Dhalai  *", "752001", "x", "4.7"),  # kept
    ])
    out = CL.standardise_feed(raw, "bio").collect()
    assert len(out) == 1
    r = out[0]
    assert (r.state, r.district, r.pincode, r.updates_age_5_17, r.updates_age_18_plus) == \
        ("odisha", "dhalai ", 752001, 0, 4)
    assert r.state_original == "Orissa" and r.district_original == "Dhalai  *"


def test_rollup_sums_repeated_keys_and_drops_null_district(spark):
    raw = bio(spark, [
        ("01-03-2025", "Goa", "North Goa", "403001", "2", "3"),
        ("01-03-2025", "Goa", "North Goa", "403001", "2", "3"),
        ("02-03-2025", "Goa", "north  goa", "403001", "1", "0"),
        ("02-03-2025", "Goa", None, "403001", "5", "5"),
    ])
    d = CL.standardise_feed(raw, "bio")
    m = CL.rollup_period(d, CL.measures_of("bio")).collect()
    assert len(m) == 1
    assert (m[0].year_month, m[0].updates_age_5_17, m[0].updates_age_18_plus) == ("2025-03", 5, 6)


def test_weekly_rollup_monday(spark):
    raw = bio(spark, [("05-03-2025", "Goa", "X", "403001", "1", "0"),   # Wednesday
                      ("09-03-2025", "Goa", "X", "403001", "1", "0"),   # Sunday, same week
                      ("10-03-2025", "Goa", "X", "403001", "1", "0")])  # Monday
    d = CL.standardise_feed(raw, "bio")
    got = sorted((str(r.year_week), r.updates_age_5_17) for r in CL.rollup_period(d, ["updates_age_5_17"], "week").collect())
    assert got == [("2025-03-03", 2), ("2025-03-10", 1)]


def test_quality_metrics(spark):
    raw = enrol(spark, [("01-03-2025", "Goa", "X", "403001", "3", "0", "0")])
    m = CL.clean_feed(raw, "enrol").collect()[0]
    assert m.total_activity == 3 and m.data_completeness == pytest.approx(1 / 3)
    assert m.data_quality_score == pytest.approx(100 / 3)


def test_master_single_shuffle_equals_outer_joins(spark):
    b = bio(spark, [("01-03-2025", "Goa", "X", "403001", "2", "1"),
                    ("01-04-2025", "Goa", "X", "403001", "1", "1")])
    d = demo(spark, [("01-03-2025", "Goa", "X", "403001", "4", "0"),
                     ("01-03-2025", "Goa", "Y", "403002", "1", "1")])
    e = enrol(spark, [("01-04-2025", "Goa", "X", "403001", "0", "1", "0")])
    raw = {"bio": b, "demo": d, "enrol": e}
    one = MA.build_master(raw)
    two = MA.merge_feeds(*[CL.clean_feed(raw[f], f) for f in MA.FEEDS])
    assert one.columns == MA.master_columns() == two.columns
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)
    row = {(r.year_month, r.district): r for r in one.collect()}[("2025-03", "y")]
    # key in one feed only: other measures and scores 0, totals and completeness null
    assert row.updates_age_5_17_bio == 0 and row.data_quality_score_bio == 0
    assert row.total_activity_bio is None and row.data_completeness is None
    # each measure is capped at its own feed's p99: 18+ values (0, 1) -> cap 0.99
    assert row.total_activity_demo == pytest.approx(1.99)


def test_dedup_feed_keeps_one_per_key(spark):
    raw = bio(spark, [("01-03-2025", "Goa", "X", "403001", "2", "1"),
                      ("01-03-2025", "Goa", "X", "403001", "1", "1"),
                      ("02-03-2025", "Goa", "X", "403001", "1", "1")])
    out = sorted((r.date, r.bio_age_5_17) for r in CL.dedup_feed(raw).collect())
    assert out == [("01-03-2025", "1"), ("02-03-2025", "1")]


def test_cleaning_counters(spark):
    raw = bio(spark, [("31-02-2025", "Goa", "X", "403001", "1", "1"),
                      ("01-03-2025", "Nowhere", "X", "403001", "1", "1"),
                      ("01-03-2025", "Goa", "X", "1", "1", "1"),
                      ("01-03-2025", "Goa", "X", "403001", "1", "1")])
    r = CL.cleaning_counters(raw, "bio").collect()[0]
    assert (r.input_rows, r.invalid_dates, r.valid_states, r.invalid_states, r.invalid_pincodes,
            r.output_rows) == (4, 1, 2, 1, 1, 1)
