"""Features, temporal windows, z-scores, trend flags and the distributed rank."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from areascope.operators import features as FE
from areascope.operators import master as MA
from areascope.operators import ranking as RK
from areascope.operators import trends as TR


def master_rows(spark, rows):
    """rows: (year_month, district, pincode, bio_5_17, demo_5_17, enrol_0_5)."""
    cols = MA.master_columns()
    data = []
    for ym, d, p, b, dm, e in rows:
        vals = dict.fromkeys(cols, 0.0)
        vals.update(year_month=ym, state="goa", district=d, pincode=p, updates_age_5_17_bio=float(b),
                    updates_age_5_17_demo=float(dm), enrollments_age_0_5=float(e))
        data.append(tuple(vals[c] for c in cols))
    schema = ", ".join(f"{c} {'string' if c in ('year_month', 'state', 'district') else 'int' if c == 'pincode' else 'double'}"
                       for c in cols)
    return spark.createDataFrame(data, schema)


def test_zero_row_ratios(spark):
    f = FE.build_features(master_rows(spark, [("2025-03", "x", 400001, 0, 0, 0)])).collect()[0]
    assert (f.bio_ratio, f.demo_ratio, f.enrol_ratio, f.update_to_enrol_ratio) == (0, 0, 0, 0)


def test_temporal_features_and_gaps(spark):
    m = master_rows(spark, [("2025-03", "x", 400001, 4, 0, 0), ("2025-06", "x", 400001, 6, 0, 0),
                            ("2025-07", "x", 400001, 0, 0, 0), ("2025-08", "x", 400001, 5, 0, 0)])
    f = {r.year_month: r for r in FE.build_features(m).collect()}
    first = f["2025-03"]
    assert first.total_activity_mom_growth == 0 and first.total_activity_rolling_avg == 4
    assert first.total_activity_volatility == 0
    assert f["2025-06"].total_activity_prev == 4          # previous present month, not May
    assert f["2025-06"].total_activity_mom_growth == pytest.approx(0.5)
    assert f["2025-08"].total_activity_mom_growth == 5.0  # prev 0 -> denominator 1
    assert f["2025-07"].total_activity_rolling_avg == pytest.approx(10 / 3)
    assert f["2025-07"].total_activity_volatility == pytest.approx(pd.Series([4, 6, 0]).std())


def test_trend_flags_strict(spark):
    m = master_rows(spark, [("2025-03", "x", 400001, 4, 0, 0), ("2025-04", "x", 400001, 6, 0, 0),
                            ("2025-05", "x", 400001, 0, 0, 0), ("2025-06", "x", 400001, 5, 0, 0)])
    t = {r.year_month: r for r in TR.analyze_trends(FE.build_features(m)).collect()}
    assert t["2025-04"].spike_alert == 0 and t["2025-04"].trend_status == "STABLE"  # growth exactly 0.5
    assert t["2025-05"].drop_alert == 1 and t["2025-05"].trend_status == "DECLINING"
    assert t["2025-06"].spike_alert == 1 and t["2025-06"].trend_status == "SURGING"


def test_constant_district_zscore_zero(spark):
    m = master_rows(spark, [("2025-03", "c", 400001, 3, 0, 0), ("2025-03", "c", 400002, 3, 0, 0)])
    t = TR.zscores(FE.build_features(m)).collect()
    assert all(r.total_activity_zscore == 0 for r in t)


def test_zscore_population_std(spark):
    m = master_rows(spark, [("2025-03", "d", 400000 + i, v, 0, 0) for i, v in enumerate([1, 2, 9])])
    t = sorted(r.total_activity_zscore for r in TR.zscores(FE.build_features(m)).collect())
    s = pd.Series([1.0, 2.0, 9.0])
    assert t == pytest.approx(sorted((s - s.mean()) / s.std(ddof=0)))


def test_rank_pct_average_ties(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 2, 5])], "i int, s double")
    got = [r.rank_pct for r in RK.rank_pct(df, "s").orderBy("i").collect()]
    assert got == pytest.approx([0.25, 0.625, 0.625, 1.0])


def test_rank_pct_matches_pandas_many_partitions(spark):
    vals = [float((i * 37) % 101) for i in range(3000)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s double")
    got = RK.rank_pct(df, "s", partitions=7).orderBy("i").toPandas()["rank_pct"]
    exp = pd.Series(vals, dtype=float).rank(pct=True)
    assert got.fillna(-1).tolist() == pytest.approx(exp.fillna(-1).tolist())


def test_district_stats_sample_std(spark):
    m = master_rows(spark, [("2025-03", "d", 400001, 1, 0, 0), ("2025-03", "d", 400002, 2, 0, 0),
                            ("2025-03", "e", 400003, 9, 0, 0)])
    s = {r.district: r for r in FE.district_stats(FE.activity_totals(m)).collect()}
    assert s["d"].district_total_activity_std == pytest.approx(pd.Series([1, 2]).std())
    assert s["e"].district_total_activity_std is None  # one row; features fill it with 0


def test_one_moment_table_serves_statistics_and_scores(spark):
    """Sample and population deviations of one aggregate agree with those taken apart, and with the shared form."""
    m = master_rows(spark, [("2025-03", "x", 400001, 5, 1, 0), ("2025-03", "x", 400002, 9, 2, 3), ("2025-04", "x", 400001, 1, 0, 8),
                            ("2025-03", "y", 400003, 4, 4, 4)])
    totals = FE.activity_totals(FE.validate_master(m))
    own = {r.district: r for r in FE.district_stats(totals).collect()}
    apart = {r.district: r for r in totals.groupBy("district").agg(
        F.stddev_samp("total_activity").alias("s"), F.sum("total_activity").alias("t")).collect()}
    for d in ("x", "y"):
        assert own[d].district_total_activity_std == pytest.approx(apart[d].s) if apart[d].s is not None else (
            own[d].district_total_activity_std is None)
        assert own[d].district_total_activity_sum == pytest.approx(apart[d].t)
    moments = FE.master_moments(m)
    shared = TR.analyze_trends(FE.build_features(m, moments=moments), moments=moments)
    alone = TR.analyze_trends(FE.build_features(m))
    key = lambda r: (r.year_month, r.pincode)
    assert sorted(map(key, shared.collect())) == sorted(map(key, alone.collect()))
    for a, b in zip(sorted(shared.collect(), key=key), sorted(alone.collect(), key=key)):
        assert a.total_activity_zscore == pytest.approx(b.total_activity_zscore) and a.trend_status == b.trend_status
