"""Profiler rules on hand-made raw rows (cases the derived test tables never produce)."""

import datetime as dt

from areascope.operators import profile as PR


def raw(spark, rows):
    return spark.createDataFrame(rows, "date string, state string, district string, pincode string, "
                                       "bio_age_5_17 string, bio_age_17_ string")


def test_suspicious_whitespace_deprecated_case(spark):
    df = raw(spark, [("01-03-2025", "Jaipur", "a", "302001", "1", "0"),
                     ("01-03-2025", "Delhi", "b", "110001", "1", "0"),
                     ("01-03-2025", "West  Bengal", "c", "700001", "1", "0"),
                     ("01-03-2025", "Odisha ", "d", "751001", "1", "0"),
                     ("01-03-2025", "Orissa", "e", "751001", "1", "0"),
                     ("01-03-2025", "odisha", "e", "751001", "1", "0"),
                     ("01-03-2025", "Odisha", "e", "751001", "1", "0")])
    assert {r.state for r in PR.suspicious_states(df).collect()} == {"Jaipur", "Delhi"}
    ws = {r.state: r.visible for r in PR.whitespace_issues(df).collect()}
    assert ws == {"West  Bengal": "West··Bengal", "Odisha ": "Odisha·"}
    dep = PR.deprecated_names(df).collect()
    assert [(r.state, r.records, r.replacement) for r in dep] == [("Orissa", 1, "Odisha")]
    cv = {r.canonical: list(r.variations) for r in PR.case_variants(df, "state").collect()}
    assert cv == {"odisha": ["Odisha", "Odisha ", "odisha"]}


def test_duplicates_and_missing_dates(spark):
    df = raw(spark, [("01-03-2025", "Goa", "X", "403001", "1", "0"),
                     ("01-03-2025", "Goa", "X", "403001", "1", "0"),
                     ("01-03-2025", "Goa", "X", "403001", "2", "0"),
                     ("04-03-2025", "Goa", "Y", "403002", "1", "0")])
    assert PR.duplicate_rows(df).first().duplicate_rows == 1
    k = PR.key_duplicates(df, ["date", "state", "district", "pincode"]).first()
    assert (k.duplicated_rows, k.duplicated_groups, k.max_occurrences) == (3, 1, 3)
    missing = sorted(r.date for r in PR.missing_dates(df).collect())
    assert missing == [dt.date(2025, 3, 2), dt.date(2025, 3, 3)]
    cov = PR.date_coverage(df).first()
    assert (cov.first_date, cov.last_date, cov.span_days) == (dt.date(2025, 3, 1), dt.date(2025, 3, 4), 3)


def test_key_violations_examples_bounded(spark):
    rows = [("01-03-2025", "Goa", None if i == 0 else "X", str(1000 + i), "1", "0") for i in range(30)]
    v = PR.key_violations(raw(spark, rows), examples=10).first()
    assert v.empty_districts == 1 and v.bad_format_pincodes == 30 and v.out_of_range_pincodes == 30
    assert list(v.bad_format_examples) == sorted(str(1000 + i) for i in range(30))[:10]
    assert list(v.out_of_range_examples) == list(range(1000, 1010))


def test_numeric_profile_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double")
    p = PR.numeric_profile(df, ["v"]).first()
    assert p.median == 5.5 and abs(p.p99 - 9.91) < 1e-9 and p.zeros == 0 and p.nulls == 0


def test_duplicates_by_fingerprint_tell_nulls_and_columns_apart(spark):
    rows = [("a", None), (None, "a"), ("a", None), (None, None), ("", None), (None, "")]
    df = spark.createDataFrame(rows, "x string, y string")
    r = PR.duplicate_rows(df).first()
    assert (r["rows"], r["distinct_rows"], r["duplicate_rows"]) == (6, 5, 1)
    assert PR.key_duplicates(df, ["x"]).first()["duplicated_rows"] == 5
    got = {r["column"]: r["duplicated_rows"] for r in PR.column_duplicates(df).collect()}
    assert got == {"x": 5, "y": 4}
    assert {r["duplicated_rows"] for r in PR.column_duplicates(df.limit(0)).collect()} == {0}


def test_duplicates_shuffle_no_values(spark):
    df = spark.createDataFrame([("a", "b", 1)], "x string, y string, z int")
    for out in (PR.duplicate_rows(df), PR.key_duplicates(df, ["x", "y"]), PR.column_duplicates(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert dealt and not any(f"({c}#" in line or f" {c}#" in line for line in dealt for c in "xyz")


def test_unicode_edges(spark):
    df = spark.createDataFrame([("Goa",), (" Goa",), ("goa\t",), ("Bihar",)], "state string")
    assert PR.case_variants(df, "state").first()["variations"] == ["Goa", "goa\t", " Goa"]
    assert {r["state"] for r in PR.whitespace_issues(df, "state").collect()} == {" Goa", "goa\t"}
