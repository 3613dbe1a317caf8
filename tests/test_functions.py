"""Edge rows for the column expressions (parse, counts, names, pincodes, title case)."""

import datetime as dt

from pyspark.sql import functions as F

from areascope.functions import (apply_aliases, coerce_count, normalise_district, normalise_state,
                                 parse_date, safe_ratio, title_case, valid_pincode)
from areascope.operators.clean import flag_valid_states


def one_col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_parse_date(spark):
    got = one_col(spark, ["31-02-2025", "1-3-2025", "15-08-2024", "bad", None], parse_date)
    assert got == [None, dt.date(2025, 3, 1), dt.date(2024, 8, 15), None, None]


def test_coerce_count(spark):
    assert one_col(spark, ["x", "4.7", "12", None, "-3.9", "12d", "7f", "1e2", " 5 "], coerce_count) == [0, 4, 12, 0, -3, 0, 0, 100, 5]


def test_normalise_state_and_aliases(spark):
    vals = ["Orissa", "Jammu & Kashmir", "West  Bengal", "WESTBENGAL", "Jaipur", None,
            " Tamil Nadu ", "Jammu&Kashmir", "Dadra and Nagar Haveli"]
    got = one_col(spark, vals, lambda c: apply_aliases(normalise_state(c)))
    assert got == ["odisha", "jammu and kashmir", "west bengal", "westbengal", "jaipur", None,
                   "tamil nadu", "jammuandkashmir", "dadra and nagar haveli and daman and diu"]


def test_valid_flag_null_is_false(spark):
    df = spark.createDataFrame([("odisha",), ("westbengal",), (None,)], "state string")
    got = [r.valid_state for r in flag_valid_states(df).collect()]
    assert got == [True, False, False]


def test_valid_flag_from_table(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "state string")
    valid = spark.createDataFrame([("a",)], "name string")
    got = {r.state: r.valid_state for r in flag_valid_states(df, valid).collect()}
    assert got == {"a": True, "b": False, None: False}


def test_district_keeps_blank_before_star(spark):
    got = one_col(spark, ["Dhalai  *", "North  Goa", "*Anantnag"], normalise_district)
    assert got == ["dhalai ", "north goa", "anantnag"]
    trimmed = one_col(spark, ["Dhalai  *"], lambda c: normalise_district(c, final_trim=True))
    assert trimmed == ["dhalai"]


def test_valid_pincode(spark):
    got = one_col(spark, ["12345", "110001", "999999", "1000000", "abc", None, "099999"], valid_pincode)
    assert got == [False, True, True, False, False, False, False]


def test_title_case_python_rule(spark):
    got = one_col(spark, ["y.s.r. kadapa", "north-east", "WEST bengal", "dhalai "], title_case)
    assert got == ["Y.S.R. Kadapa", "North-East", "West Bengal", "Dhalai "]


def test_safe_ratio_zero_denominator(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 0.0), (3.0, 2.0)], "x double, d double")
    assert [r[0] for r in df.select(safe_ratio("x", "d")).collect()] == [0.0, 3.0, 1.5]


def test_title_case_keeps_long_names_whole(spark):
    assert len(one_col(spark, ["a" * (1 << 20) + "bcd"], title_case)[0]) == (1 << 20) + 3
