"""Report operators: change rules, growth classes, drill-down sentinels, peaks."""

import math

from pyspark.sql import functions as F

from areascope.operators import reports as RE


def test_pct_change_zero_rules(spark):
    df = spark.createDataFrame([("2025-01", 0.0), ("2025-02", 0.0), ("2025-03", 5.0), ("2025-04", 10.0)],
                               "year_month string, v double")
    got = {r.year_month: r.v_change for r in RE.pct_change(df, ["v"]).collect()}
    assert "2025-01" not in got and "2025-02" not in got       # first row and 0 -> 0 dropped
    assert math.isinf(got["2025-03"]) and got["2025-04"] == 100.0


def test_growth_class(spark):
    df = spark.createDataFrame([
        ("a", "2025-01", 10.0), ("a", "2025-05", 13.0),   # 1.3x growing
        ("b", "2025-01", 10.0), ("b", "2025-03", 7.0),    # 0.7x declining
        ("c", "2025-01", 10.0), ("c", "2025-02", 12.0),   # 1.2x stable (strict)
        ("d", "2025-01", 10.0)], "pincode string, year_month string, total_activity double")
    got = {r.pincode: r.growth_class for r in RE.growth_class(df, by=("pincode",)).collect()}
    assert got == {"a": "growing", "b": "declining", "c": "stable", "d": "insufficient data"}


def test_drill_down_sentinels(spark):
    df = spark.createDataFrame([("s1", "d1", 1), ("s1", "d2", 2), ("s2", "d3", 3)],
                               "state string, district string, pincode int")
    assert RE.drill_down(df, "All States", "All Districts").count() == 3
    assert RE.drill_down(df, "s1").count() == 2
    assert RE.drill_down(df, "s1", "d2").count() == 1
    assert [r.district for r in RE.list_values(df, "district", state="s1").collect()] == ["d1", "d2"]


def test_overall_change_and_peaks(spark):
    m = spark.createDataFrame([("2025-03", 0.0), ("2025-04", 8.0), ("2025-05", 8.0)],
                              "year_month string, total_activity double")
    oc = RE.overall_change(m).first()
    assert oc.change_pct == 0.0 and oc.trend == "stable"         # first month 0 -> 0 %
    pk = RE.peak_months(m).first()
    assert (pk.peak_month, pk.low_month, pk.peak_label) == ("2025-04", "2025-03", "April 2025")


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 10]], "x double")
    got = {r.bin: r["count"] for r in RE.histogram(df, "x", 5).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 4: 1}


def test_risk_pivot_fills_zero(spark):
    df = spark.createDataFrame([("s1", "CRITICAL"), ("s1", "LOW"), ("s2", "HIGH")],
                               "state string, risk_category string")
    rows = RE.risk_pivot(df).collect()
    assert rows[0].state == "s1" and rows[0].CRITICAL == 1 and rows[1].CRITICAL == 0


def test_box_stats_exact(spark):
    from areascope.operators import reports as RE
    df = spark.createDataFrame([("a", float(x)) for x in [*range(1, 10), 30]], "g string, x double")
    r = RE.box_stats(df, "g", "x").first()
    assert (r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"]) == (3.25, 5.5, 7.75, 1.0, 9.0)


def test_profiles_gather_clusters(spark):
    rows = [(0, "A", 10.0, 2.0, 4.0, 16.0, 0.5, 0.25, 0.25, 1.0), (1, "A", 30.0, 2.0, 0.0, 32.0, 1.0, 0.0, 0.0, 3.0),
            (2, "B", 5.0, 8.0, 1.0, 14.0, 0.5, 0.5, 0.0, None), (2, "B", 5.0, 8.0, 1.0, 14.0, 0.5, 0.5, 0.0, 8.0)]
    df = spark.createDataFrame(rows, "cluster_id int, cluster_profile string, total_bio_updates double, total_demo_updates double, "
                                     "total_enrollments double, total_activity double, bio_ratio double, demo_ratio double, "
                                     "enrol_ratio double, total_activity_volatility double")
    means = {r.cluster_profile: tuple(r)[1:] for r in RE.normalised_cluster_means(df).collect()}
    assert means == {"A": (1.0, 0.25, 1.0), "B": (0.25, 1.0, 0.5)}
    got = {r.cluster_profile: r.asDict() for r in RE.cluster_profiles(df).collect()}
    assert set(got) == {"A", "B"} and got["A"]["bio_ratio_mean"] == 0.75 and got["A"]["total_activity_sum"] == 48.0
    assert [got["A"][f"{c}_sum"] for c in RE.ACTIVITIES] == [40.0, 4.0, 4.0]
    assert [got["B"][f"{c}_sum"] for c in RE.ACTIVITIES] == [10.0, 16.0, 2.0]
    assert (got["A"]["volatility_mean"], got["B"]["volatility_mean"]) == (2.0, 8.0)
    assert {r["volatility_overall_mean"] for r in got.values()} == {4.0}  # of rows, not of profiles


def _months(spark, rows):
    return spark.createDataFrame(
        rows, "year_month string, state string, district string, pincode int, updates_age_5_17_bio double, "
              "updates_age_18_plus_bio double, updates_age_5_17_demo double, updates_age_18_plus_demo double, "
              "enrollments_age_0_5 double, enrollments_age_5_17 double, enrollments_age_18_plus double").withColumns({
                  f"total_activity_{k}": F.col(f"updates_age_5_17_{k}") + F.col(f"updates_age_18_plus_{k}") for k in ("bio", "demo")})


MONTHS = [("2025-01", "s", "d", 100001, 1.0, 3.0, 0.0, 0.0, 2.0, 1.0, 4.0), ("2025-03", "s", "d", 100001, 1.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0),
          ("2025-02", "s", "d", 100002, 1500.0, 500.0, 0.0, 0.0, 0.0, 5.0, 2.0)]


def test_pincode_months_and_shares(spark):
    df = _months(spark, MONTHS)
    one = RE.pincode_months(df, "s", "d", 100001)
    assert set(RE.MEASURES) <= set(one.columns) and len(RE.MEASURES) == 7
    assert [(r.year_month, r.updates_age_18_plus_bio, r.total_enrollments) for r in one.collect()] == [("2025-03", 3.0, 0.0), ("2025-01", 3.0, 7.0)]
    assert [r.year_month for r in RE.pincode_months(df).collect()] == ["2025-03", "2025-02", "2025-01"]
    shares = {r.activity_type: tuple(r)[1:] for r in RE.age_shares(df.filter("pincode = 100001")).collect()}
    assert shares == {"Biometric Updates": (2.0, 6.0, 25.0, 75.0), "Demographic Updates": (0.0, 0.0, None, None)}


def test_insight_lines(spark):
    df = _months(spark, MONTHS)
    risk = spark.createDataFrame([("s", "CRITICAL", "SURGING"), ("s", "CRITICAL", "SURGING"), ("t", "CRITICAL", "DECLINING"),
                                  ("t", "LOW", "STABLE")], "state string, risk_category string, trend_status string")

    def lines(out):
        return [r.line for r in out.orderBy("position").collect()]

    bio = "Biometric updates (2,008) exceed demographic updates (0). This indicates active identity verification activity."
    child = "Child enrollments (8) are higher than adult enrollments (6)."
    assert lines(RE.key_insights(df)) == [bio, child] == lines(RE.key_insights(df, risk))
    assert lines(RE.key_insights(df, risk, "s")) == [
        bio, child, "Alert: 2 pincodes in this state require immediate attention due to unusual activity patterns."]
    assert lines(RE.key_insights(df, risk, "u")) == [
        "Demographic updates (0) exceed biometric updates (0). Address/mobile updates are more common."]
    assert lines(RE.district_observations(df, "s", "d")) == [
        "Highest Activity Pincode: 100002 with 2,007 total transactions", "Lowest Activity Pincode: 100001 with 15 total transactions",
        "This district has more biometric updates (2,008) than demographic updates (0), indicating active identity verification."]
    assert lines(RE.alert_observations(risk)) == [
        "s has the highest number of critical alerts (2 pincodes)",
        "2 pincodes show surging activity patterns. Review these for unusual spikes."]
    assert lines(RE.alert_observations(risk.filter("state = 't'")))[1].startswith("1 pincodes show declining")
    assert len(lines(RE.alert_observations(risk.limit(0)))) == 1
