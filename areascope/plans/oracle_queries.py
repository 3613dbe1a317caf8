"""DuckDB oracle SQL per registered query name (same output column names)."""

from __future__ import annotations

from .. import constants as K
from .oracle_fixed import fixed_oracles
from .oracle_sql import _DEMO, _ENROL, RAW_CTES, _count, _state, strip, with_master

R = 4


def _r(expr: str, alias: str) -> str:
    return f"round({expr}, {R}) AS {alias}"


MASTER_DOUBLES = ("updates_age_5_17_bio updates_age_18_plus_bio total_activity_bio data_completeness_bio "
                  "data_quality_score_bio updates_age_5_17_demo updates_age_18_plus_demo total_activity_demo "
                  "data_completeness_demo data_quality_score_demo enrollments_age_0_5 enrollments_age_5_17 "
                  "enrollments_age_18_plus total_activity data_completeness data_quality_score").split()
ENR = "(enrollments_age_0_5 + enrollments_age_5_17 + enrollments_age_18_plus)"

# master with numeric nulls -> 0 (the reports' view)
BASE = ", base AS (SELECT year_month, state, district, pincode, " + ", ".join(
    f"COALESCE({c}, 0) AS {c}" for c in MASTER_DOUBLES) + " FROM master)"


def wm(select: str, extra: str = "") -> str:
    return with_master(select) if not extra else with_master("").rstrip() + extra + "\n" + select


def wb(select: str, extra: str = "") -> str:
    return wm(select, BASE + extra)


def raw_only(select: str) -> str:
    return f"WITH {RAW_CTES}\n{select}"


def _typed(feed: str, mapping: dict) -> str:
    return (f", typed_{feed} AS (SELECT date, state, district, pincode, "
            + ", ".join(f"{_count(r)} AS {o}" for r, o in mapping.items()) + f" FROM {feed}_raw)")


MASTER_SELECT = ("SELECT year_month, state, district, pincode, "
                 + ", ".join(_r(c, c) for c in MASTER_DOUBLES) + " FROM master")

# ---------------------------------------------------------------- features
FEATURES = """,
f0 AS (SELECT year_month, state, district, pincode,
    CAST(updates_age_5_17_bio + updates_age_18_plus_bio AS DOUBLE) AS tb,
    CAST(updates_age_5_17_demo + updates_age_18_plus_demo AS DOUBLE) AS td,
    CAST(enrollments_age_0_5 + enrollments_age_5_17 + enrollments_age_18_plus AS DOUBLE) AS te,
    enrollments_age_0_5 + enrollments_age_5_17 AS child, updates_age_5_17_bio AS b517,
    (data_quality_score_bio + data_quality_score_demo + data_quality_score) / 3 / 100 AS quality_weight
  FROM master),
f1 AS (SELECT *, tb + td + te AS ta FROM f0),
ds AS (SELECT district, avg(ta) AS dmean, stddev_samp(ta) AS dstd, sum(ta) AS dsum,
         avg(tb) AS dbio, avg(td) AS ddemo, avg(te) AS denrol FROM f1 GROUP BY district),
f2 AS (SELECT f1.*, dmean,
    lag(ta) OVER (PARTITION BY state, district, pincode ORDER BY year_month) AS prev,
    avg(ta) OVER (PARTITION BY state, district, pincode ORDER BY year_month
                  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ravg,
    stddev_samp(ta) OVER (PARTITION BY state, district, pincode ORDER BY year_month
                  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rstd
  FROM f1 JOIN ds USING (district)),
feat AS (SELECT year_month, state, district, pincode,
    tb AS total_bio_updates, td AS total_demo_updates, te AS total_enrollments, ta AS total_activity,
    tb / CASE WHEN ta = 0 THEN 1 ELSE ta END AS bio_ratio,
    td / CASE WHEN ta = 0 THEN 1 ELSE ta END AS demo_ratio,
    te / CASE WHEN ta = 0 THEN 1 ELSE ta END AS enrol_ratio,
    (tb + td) / CASE WHEN te = 0 THEN 1 ELSE te END AS update_to_enrol_ratio,
    ta / CASE WHEN dmean = 0 THEN 1 ELSE dmean END AS activity_vs_district_mean,
    COALESCE((ta - prev) / CASE WHEN prev = 0 THEN 1 ELSE prev END, 0) AS total_activity_mom_growth,
    ravg AS total_activity_rolling_avg, COALESCE(rstd, 0) AS total_activity_volatility,
    quality_weight,
    child / CASE WHEN te = 0 THEN 1 ELSE te END AS child_enrol_proportion,
    b517 / CASE WHEN tb = 0 THEN 1 ELSE tb END AS bio_child_proportion
  FROM f2)"""

ZS = ",\nzs AS (SELECT district, " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in
    ("total_activity", "total_bio_updates", "total_demo_updates", "total_enrollments")) + \
    " FROM feat GROUP BY district),\ntr AS (SELECT feat.*, " + ", ".join(
    f"COALESCE(({c} - m_{c}) / NULLIF(s_{c}, 0), 0) AS {c}_zscore" for c in
    ("total_activity", "total_bio_updates", "total_demo_updates", "total_enrollments")) + \
    " FROM feat JOIN zs USING (district))"

SCALER = ",\nsc AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in K.FEATURE_COLUMNS) + " FROM feat)"

ORACLE = {
    "build_master": with_master(MASTER_SELECT),
    "merge_feeds": with_master(MASTER_SELECT),
    "clean_feed_bio": with_master(
        "SELECT year_month, state, district, pincode, "
        + _r("updates_age_5_17_bio", "updates_age_5_17") + ", " + _r("updates_age_18_plus_bio", "updates_age_18_plus")
        + ", " + _r("total_activity_bio", "total_activity") + ", " + _r("data_completeness_bio", "data_completeness")
        + ", " + _r("data_quality_score_bio", "data_quality_score") + " FROM q_bio"),
    "rollup_period_week": with_master(
        "SELECT CAST(date_trunc('week', d) AS DATE) AS year_week, state, district, pincode, "
        + _r("sum(least(CAST(updates_age_5_17 AS DOUBLE), cap_updates_age_5_17))", "updates_age_5_17") + ", "
        + _r("sum(least(CAST(updates_age_18_plus AS DOUBLE), cap_updates_age_18_plus))", "updates_age_18_plus")
        + " FROM std_demo, cap_demo WHERE district IS NOT NULL GROUP BY ALL"),
    "cleaning_counters": raw_only(
        ", c AS (SELECT CAST(try_strptime(date, '%d-%m-%Y') AS DATE) AS d, " + _state("state") + " AS st, "
        "TRY_CAST(pincode AS INTEGER) AS pin, " + _count("demo_age_5_17") + " AS m1, " + _count("demo_age_17_")
        + " AS m2 FROM demo_raw), c2 AS (SELECT *, COALESCE(st IN (SELECT state FROM valid_names), false) AS vs, "
        "COALESCE(pin BETWEEN 100000 AND 999999, false) AS vp FROM c), "
        "c3 AS (SELECT *, d IS NOT NULL AND vs AND vp AS ok FROM c2), "
        "p AS (SELECT quantile_cont(m1, 0.99) FILTER (WHERE ok) AS p1, quantile_cont(m2, 0.99) FILTER (WHERE ok) AS p2 FROM c3) "
        "SELECT count(*) AS input_rows, count(*) FILTER (WHERE d IS NULL) AS invalid_dates, "
        "count(*) FILTER (WHERE d IS NOT NULL AND vs) AS valid_states, "
        "count(*) FILTER (WHERE d IS NOT NULL AND NOT vs) AS invalid_states, "
        "count(*) FILTER (WHERE d IS NOT NULL AND vs AND NOT vp) AS invalid_pincodes, "
        "count(*) FILTER (WHERE ok) AS output_rows, "
        "count(*) FILTER (WHERE ok AND m1 > p1) AS above_p99_updates_age_5_17, "
        "count(*) FILTER (WHERE ok AND m2 > p2) AS above_p99_updates_age_18_plus FROM c3, p"),
    "top_invalid_states": raw_only(
        ", c AS (SELECT " + _state("state") + " AS state FROM bio_raw WHERE try_strptime(date, '%d-%m-%Y') IS NOT NULL) "
        "SELECT state, count(*) AS records FROM c WHERE NOT COALESCE(state IN (SELECT state FROM valid_names), false) "
        "GROUP BY state ORDER BY records DESC, state NULLS FIRST LIMIT 10"),
    "dedup_feed": raw_only(
        "SELECT date, state, district, pincode, bio_age_5_17, bio_age_17_ FROM (SELECT *, row_number() OVER "
        "(PARTITION BY date, state, district, pincode ORDER BY bio_age_5_17 NULLS FIRST, bio_age_17_ NULLS FIRST) AS rn "
        "FROM bio_raw) WHERE rn = 1"),
    "cleaning_report": with_master(
        "SELECT dataset, final_records, unique_states, states_list, unique_districts, unique_pincodes, date_range, "
        "round(quality_score_mean, 4) AS quality_score_mean, total_activity FROM ("
        + " UNION ALL ".join(
            f"SELECT '{n}' AS dataset, count(*) AS final_records, count(DISTINCT state) AS unique_states, "
            f"list_sort(list(DISTINCT state)) AS states_list, count(DISTINCT district) AS unique_districts, "
            f"count(DISTINCT pincode) AS unique_pincodes, min(year_month) || ' to ' || max(year_month) AS date_range, "
            + (f"avg(data_quality_score{s}) AS quality_score_mean, CAST(sum(total_activity{s}) AS BIGINT) AS total_activity "
               if n != "master" else "CAST(NULL AS DOUBLE) AS quality_score_mean, CAST(NULL AS BIGINT) AS total_activity ")
            + f"FROM {src}"
            for n, s, src in (("bio", "_bio", "q_bio"), ("demo", "_demo", "q_demo"), ("enrol", "", "q_enrol"),
                              ("master", "", "master"))) + ")"),
    "cleaning_comparison": with_master(
        "SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT '{n}' AS dataset, '{stage}' AS stage, count(*) AS records, count(DISTINCT state) AS unique_states, "
            f"count(DISTINCT district) AS unique_districts FROM {src}"
            for n in ("bio", "demo", "enrol") for stage, src in (("before", f"{n}_raw"), ("after", f"q_{n}"))) + ")"),
    # ------------------------------------------------------------ profile
    "numeric_profile": raw_only(_typed("demo", _DEMO)[1:].join(["", ""]) if False else
        _typed("demo", _DEMO) + " " + " UNION ALL ".join(
            f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, "
            f"round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std, "
            f"count(*) FILTER (WHERE {c} < 0) AS negatives, count(*) FILTER (WHERE {c} = 0) AS zeros, "
            f"round(count(*) FILTER (WHERE {c} = 0) * 100.0 / count(*), 4) AS zero_pct, "
            f"count(*) FILTER (WHERE {c} > 1000) AS above_1000, "
            + ", ".join(f"round(quantile_cont({c}, {p}), 4) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
            + " FROM typed_demo" for c in ("updates_age_5_17", "updates_age_18_plus")).join(["SELECT * FROM (", ")"])),
    "outlier_counts": raw_only(_typed("enrol", _ENROL) + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS column, round(max(p95), 4) AS p95, round(max(p99), 4) AS p99, "
        f"count(*) FILTER (WHERE {c} > p95) AS above_p95, count(*) FILTER (WHERE {c} > p99) AS above_p99 "
        f"FROM typed_enrol, (SELECT quantile_cont({c}, 0.95) AS p95, quantile_cont({c}, 0.99) AS p99 FROM typed_enrol)"
        for c in _ENROL.values()).join(["SELECT * FROM (", ")"])),
    "top_values": raw_only(_typed("demo", _DEMO) + " SELECT DISTINCT CAST(updates_age_5_17 AS DOUBLE) AS value "
                           "FROM typed_demo ORDER BY value DESC LIMIT 5"),
    "coverage": with_master("SELECT count(DISTINCT state) AS unique_state, count(DISTINCT district) AS unique_district, "
                            "count(DISTINCT pincode) AS unique_pincode, count(DISTINCT year_month) AS unique_year_month FROM master"),
    "duplicate_rows": raw_only(", g AS (SELECT count(*) AS n FROM demo_raw GROUP BY date, state, district, pincode, demo_age_5_17, demo_age_17_) "
                               "SELECT sum(n) AS rows, count(*) AS distinct_rows, sum(n - 1) AS duplicate_rows FROM g"),
    "key_duplicates": raw_only(", g AS (SELECT count(*) AS n FROM demo_raw GROUP BY date, state, district, pincode "
                               "HAVING count(*) > 1) SELECT COALESCE(sum(n), 0) AS duplicated_rows, "
                               "count(*) AS duplicated_groups, max(n) AS max_occurrences FROM g"),
    "column_duplicates": raw_only(" SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column, COALESCE(sum(n), 0) AS duplicated_rows FROM "
        f"(SELECT count(*) AS n FROM bio_raw GROUP BY {c} HAVING count(*) > 1)"
        for c in ("date", "state", "district", "pincode", "bio_age_5_17", "bio_age_17_")) + ")"),
    "case_variants": raw_only(f" SELECT {strip('lower(state)')} AS canonical, list_sort(list(DISTINCT state)) AS variations "
                              "FROM bio_raw WHERE state IS NOT NULL GROUP BY 1 HAVING count(DISTINCT state) > 1"),
    "area_pairs": raw_only(" SELECT state, district, count(*) AS count FROM bio_raw GROUP BY ALL"),
    "date_coverage": raw_only(", d AS (SELECT CAST(try_strptime(date, '%d-%m-%Y') AS DATE) AS d FROM bio_raw) "
                              "SELECT min(d) AS first_date, max(d) AS last_date, "
                              "CAST(datediff('day', min(d), max(d)) AS INTEGER) AS span_days FROM d WHERE d IS NOT NULL"),
    "date_counts": raw_only(", d AS (SELECT CAST(try_strptime(date, '%d-%m-%Y') AS DATE) AS date FROM bio_raw) "
                            "SELECT date, count(*) AS records FROM d WHERE date IS NOT NULL GROUP BY date"),
    "missing_dates": raw_only(", d AS (SELECT DISTINCT CAST(try_strptime(date, '%d-%m-%Y') AS DATE) AS date FROM bio_raw "
                              "WHERE try_strptime(date, '%d-%m-%Y') IS NOT NULL), "
                              "cal AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d) "
                              "SELECT date FROM cal WHERE date NOT IN (SELECT date FROM d)"),
    "null_counts": raw_only(" SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM bio_raw"
        for c in ("date", "state", "district", "pincode", "bio_age_5_17", "bio_age_17_")) + ")"),
    "region_counts": raw_only(" SELECT CAST(floor(TRY_CAST(pincode AS BIGINT) / 100000) AS INTEGER) AS pincode_region, "
                              "count(*) AS records FROM enrol_raw WHERE TRY_CAST(pincode AS BIGINT) IS NOT NULL GROUP BY 1"),
    "key_violations": raw_only(
        " SELECT count(*) FILTER (WHERE district IS NULL OR district = '') AS empty_districts, "
        "count(*) FILTER (WHERE pincode IS NULL) AS null_pincodes, "
        "count(*) FILTER (WHERE length(pincode) <> 6) AS bad_format_pincodes, "
        "count(*) FILTER (WHERE TRY_CAST(pincode AS BIGINT) < 100000 OR TRY_CAST(pincode AS BIGINT) > 999999) AS out_of_range_pincodes, "
        "list_sort(list(DISTINCT pincode) FILTER (WHERE length(pincode) <> 6))[1:10] AS bad_format_examples, "
        "list_sort(list(DISTINCT TRY_CAST(pincode AS BIGINT)) FILTER (WHERE TRY_CAST(pincode AS BIGINT) < 100000 "
        "OR TRY_CAST(pincode AS BIGINT) > 999999))[1:10] AS out_of_range_examples FROM bio_raw"),
    "whitespace_issues": raw_only(" SELECT state, count(*) AS records, replace(state, ' ', '·') AS visible FROM bio_raw "
                                  f"WHERE state IS NOT NULL AND (contains(state, '  ') OR state <> {strip('state')}) GROUP BY state"),
    "suspicious_states": raw_only(" SELECT state, count(*) AS records FROM demo_raw WHERE "
                                  + " OR ".join(f"contains(state, '{p}')" for p in K.SUSPICIOUS_PLACES)
                                  + " GROUP BY state"),
    "deprecated_names": raw_only(" SELECT state, count(*) AS records, CASE state "
                                 + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.DEPRECATED_STATES.items())
                                 + " END AS replacement FROM enrol_raw WHERE state IN ("
                                 + ", ".join(f"'{a}'" for a in K.DEPRECATED_STATES) + ") GROUP BY state"),
    "state_audit": raw_only(
        ", u AS (SELECT state, 'bio' AS feed FROM bio_raw UNION ALL SELECT state, 'demo' FROM demo_raw "
        "UNION ALL SELECT state, 'enrol' FROM enrol_raw) SELECT state, list_sort(list(DISTINCT feed)) AS feeds, "
        "CASE WHEN count(DISTINCT feed) = 1 THEN min(feed) END AS only_in FROM u WHERE state IS NOT NULL GROUP BY state"),
    # ------------------------------------------------------------ features / trends
    "build_features": wm("SELECT year_month, state, district, pincode, "
                         + ", ".join(_r(c, c) for c in K.FEATURE_COLUMNS) + " FROM feat", FEATURES),
    "district_stats": wm("SELECT district, " + ", ".join(_r(a, b) for a, b in (
        ("dmean", "district_total_activity_mean"), ("dstd", "district_total_activity_std"),
        ("dsum", "district_total_activity_sum"), ("dbio", "district_total_bio_updates_mean"),
        ("ddemo", "district_total_demo_updates_mean"), ("denrol", "district_total_enrollments_mean"))) + " FROM ds",
        FEATURES),
    "analyze_trends": wm(
        "SELECT year_month, state, district, pincode, "
        + ", ".join(_r(f"{c}_zscore", f"{c}_zscore") for c in
                    ("total_activity", "total_bio_updates", "total_demo_updates", "total_enrollments"))
        + f", CAST(total_activity_mom_growth < {K.DROP_THRESHOLD} AS INTEGER) AS drop_alert"
        + f", CAST(total_activity_mom_growth > {K.SPIKE_THRESHOLD} AS INTEGER) AS spike_alert"
        + f", CAST(abs(total_activity_zscore) > {K.ZSCORE_THRESHOLD} AS INTEGER) AS zscore_anomaly"
        + f", CASE WHEN total_activity_mom_growth < {K.DROP_THRESHOLD} THEN 'DECLINING' "
          f"WHEN total_activity_mom_growth > {K.SPIKE_THRESHOLD} THEN 'SURGING' "
          f"WHEN abs(total_activity_zscore) > {K.ZSCORE_THRESHOLD} THEN 'UNUSUAL' ELSE 'STABLE' END AS trend_status"
        + " FROM tr", FEATURES + ZS),
    "scale_features": wm("SELECT year_month, state, district, pincode, " + ", ".join(
        _r(f"CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0 END", f"{c}_scaled") for c in K.FEATURE_COLUMNS)
        + " FROM feat, sc", FEATURES + SCALER),
    "rank_pct": with_master(
        ", t AS (SELECT total_activity_demo AS x, count(*) AS ties FROM master WHERE total_activity_demo IS NOT NULL GROUP BY 1), "
        "r AS (SELECT x, round((sum(ties) OVER (ORDER BY x) - ties + (ties + 1) / 2.0) / sum(ties) OVER (), 4) AS rank_pct FROM t) "
        "SELECT year_month, state, district, pincode, total_activity_demo, rank_pct "
        "FROM master LEFT JOIN r ON total_activity_demo = x"),
    # ------------------------------------------------------------ reports
    "title_case_names": with_master(
        "SELECT state, district, "
        "array_to_string(list_transform(string_split(state, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS state_title, "
        "array_to_string(list_transform(string_split(district, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS district_title "
        "FROM (SELECT DISTINCT state, district FROM master)"),
    "kpis": wb(f"SELECT {_r('sum(total_activity_bio)', 'total_bio')}, {_r('sum(total_activity_demo)', 'total_demo')}, "
               f"{_r(f'sum({ENR})', 'total_enrollments')}, count(DISTINCT pincode) AS pincodes, "
               "count(DISTINCT year_month) AS months, "
               "format('{:,.0f}', round(sum(total_activity_bio), 0)) AS total_bio_text FROM base"),
    "monthly_trend": wb("SELECT year_month, " + ", ".join(_r(f"sum({c})", c) for c in (
        "total_activity_bio", "total_activity_demo", "enrollments_age_0_5", "enrollments_age_5_17",
        "enrollments_age_18_plus")) + f", {_r(f'sum({ENR})', 'total_enrollments')} FROM base GROUP BY year_month"),
    "monthly_summary": wb("SELECT year_month, " + ", ".join(_r(f"sum({c})", c) for c in (
        "total_activity_bio", "total_activity_demo", "enrollments_age_0_5", "enrollments_age_5_17",
        "enrollments_age_18_plus", "updates_age_5_17_bio", "updates_age_18_plus_bio", "updates_age_5_17_demo",
        "updates_age_18_plus_demo")) + f", count(DISTINCT pincode) AS pincodes, {_r(f'sum({ENR})', 'total_enrollments')}, "
        + _r(f"sum(total_activity_bio) + sum(total_activity_demo) + sum({ENR})", "total_activity")
        + " FROM base GROUP BY year_month"),
    "district_summary": wb(
        "SELECT district, count(DISTINCT pincode) AS pincodes, " + _r("sum(total_activity_bio)", "biometric") + ", "
        + _r("sum(total_activity_demo)", "demographic") + ", " + _r(f"sum({ENR})", "total_enrollments") + ", "
        + _r(f"sum(total_activity_bio) + sum(total_activity_demo) + sum({ENR})", "total_activity")
        + " FROM base GROUP BY district"),
    "state_report": wb(
        "SELECT state, count(DISTINCT district) AS districts, count(DISTINCT pincode) AS pincodes, "
        + _r("sum(total_activity_bio)", "biometric") + ", " + _r("sum(total_activity_demo)", "demographic") + ", "
        + _r(f"sum({ENR})", "total_enrollments") + ", "
        + _r(f"sum(total_activity_bio) + sum(total_activity_demo) + sum({ENR})", "total_activity")
        + " FROM base GROUP BY state"),
    "pincode_summary": wb(
        "SELECT pincode, " + _r("sum(total_activity_bio)", "biometric") + ", " + _r("sum(total_activity_demo)", "demographic")
        + ", " + _r(f"sum({ENR})", "total_enrollments") + ", count(DISTINCT year_month) AS months, "
        + _r(f"sum(total_activity_bio) + sum(total_activity_demo) + sum({ENR})", "total_activity")
        + " FROM base GROUP BY pincode"),
    "age_bands": wb("SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{b}' AS age_band, {_r(f'sum({c})', 'total')} FROM base" for b, c in (
            ("Bio 5-17", "updates_age_5_17_bio"), ("Bio 18+", "updates_age_18_plus_bio"),
            ("Demo 5-17", "updates_age_5_17_demo"), ("Demo 18+", "updates_age_18_plus_demo"),
            ("Enrol 0-5", "enrollments_age_0_5"), ("Enrol 5-17", "enrollments_age_5_17"),
            ("Enrol 18+", "enrollments_age_18_plus"))) + ")"),
    "activity_split": wb(
        "SELECT activity_type, round(total, 4) AS total, round(CASE WHEN sum(total) OVER () > 0 THEN "
        "total * 100.0 / sum(total) OVER () END, 4) AS share_pct FROM ("
        "SELECT 'Biometric Updates' AS activity_type, sum(total_activity_bio) AS total FROM base UNION ALL "
        "SELECT 'Demographic Updates', sum(total_activity_demo) FROM base UNION ALL "
        f"SELECT 'New Enrollments', sum({ENR}) FROM base)"),
    "pct_change": wb(
        ", m AS (SELECT year_month, sum(total_activity_bio) AS b, sum(total_activity_demo) AS d, "
        f"sum({ENR}) AS e FROM base GROUP BY year_month), "
        "c AS (SELECT year_month, " + ", ".join(
            f"CASE WHEN lag({x}) OVER (ORDER BY year_month) = 0 THEN CASE WHEN {x} = 0 THEN NULL ELSE 'Infinity'::DOUBLE END "
            f"ELSE ({x} - lag({x}) OVER (ORDER BY year_month)) / lag({x}) OVER (ORDER BY year_month) * 100 END AS {n}"
            for x, n in (("b", "total_activity_bio_change"), ("d", "total_activity_demo_change"),
                         ("e", "total_enrollments_change"))) + " FROM m) "
        "SELECT year_month, " + ", ".join(_r(n, n) for n in (
            "total_activity_bio_change", "total_activity_demo_change", "total_enrollments_change"))
        + " FROM c WHERE total_activity_bio_change IS NOT NULL AND total_activity_demo_change IS NOT NULL "
          "AND total_enrollments_change IS NOT NULL").replace("WITH ", "WITH ", 1).replace(
        "\n, m AS", ", m AS"),
    "growth_class": wb(
        ", g AS (SELECT state, district, pincode, "
        f"arg_min(total_activity_bio + total_activity_demo + {ENR}, year_month) AS first_value, "
        f"arg_max(total_activity_bio + total_activity_demo + {ENR}, year_month) AS last_value, count(*) AS months "
        "FROM base GROUP BY ALL) SELECT state, district, pincode, round(first_value, 4) AS first_value, "
        "round(last_value, 4) AS last_value, months, CASE WHEN months < 2 THEN 'insufficient data' "
        f"WHEN last_value > first_value * {K.PINCODE_TREND_UP} THEN 'growing' "
        f"WHEN last_value < first_value * {K.PINCODE_TREND_DOWN} THEN 'declining' ELSE 'stable' END AS growth_class FROM g"),
    "overall_change": wb(
        f", m AS (SELECT year_month, sum(total_activity_bio) + sum(total_activity_demo) + sum({ENR}) AS t "
        "FROM base GROUP BY year_month), g AS (SELECT arg_min(t, year_month) AS f, arg_max(t, year_month) AS l FROM m), "
        "h AS (SELECT f, l, CASE WHEN f > 0 THEN (l - f) / f * 100 ELSE 0.0 END AS c FROM g) "
        "SELECT round(f, 4) AS first_total, round(l, 4) AS last_total, round(c, 4) AS change_pct, "
        f"CASE WHEN c > {K.OVERALL_TREND_PCT} THEN 'increased' WHEN c < -{K.OVERALL_TREND_PCT} THEN 'decreased' "
        "ELSE 'stable' END AS trend FROM h"),
    "peak_months": wb(
        f", m AS (SELECT year_month, sum(total_activity_bio) + sum(total_activity_demo) + sum({ENR}) AS t "
        "FROM base GROUP BY year_month) SELECT "
        "(SELECT year_month FROM m ORDER BY t DESC, year_month LIMIT 1) AS peak_month, round(max(t), 4) AS peak_value, "
        "(SELECT year_month FROM m ORDER BY t, year_month LIMIT 1) AS low_month, round(min(t), 4) AS low_value, "
        "round(avg(t), 4) AS mean_value, strftime(CAST((SELECT year_month FROM m ORDER BY t DESC, year_month LIMIT 1) "
        "|| '-01' AS DATE), '%B %Y') AS peak_label FROM m"),
    "linear_trend": wb(
        f", m AS (SELECT year_month, sum(total_activity_bio) + sum(total_activity_demo) + sum({ENR}) AS t "
        "FROM base GROUP BY year_month), i AS (SELECT t, CAST(row_number() OVER (ORDER BY year_month) - 1 AS DOUBLE) AS x FROM m) "
        "SELECT round(regr_slope(t, x), 4) AS slope, round(regr_intercept(t, x), 4) AS intercept, count(*) AS months FROM i"),
    "top_states": wb(
        ", s AS (SELECT state FROM base GROUP BY state ORDER BY sum(total_activity_bio + total_activity_demo) DESC, state LIMIT 15) "
        "SELECT state, count(*) AS rows, round(sum(total_activity_bio + total_activity_demo), 4) AS total_activity "
        "FROM base WHERE state IN (SELECT state FROM s) GROUP BY state"),
    "quality_histogram": with_master(
        ", h AS (SELECT min(data_quality_score_bio) AS lo, max(data_quality_score_bio) AS hi FROM q_bio), "
        "b AS (SELECT CAST(CASE WHEN (hi - lo) / 30 > 0 THEN least(floor((data_quality_score_bio - lo) / ((hi - lo) / 30)), 29) "
        "ELSE 0 END AS INTEGER) AS bin, lo, hi FROM q_bio, h WHERE data_quality_score_bio IS NOT NULL) "
        "SELECT bin, round(min(lo) + bin * (min(hi) - min(lo)) / 30, 4) AS bin_start, count(*) AS count FROM b GROUP BY bin"),
    "correlation": wm("SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 4) AS corr FROM feat"
        for i, a in enumerate(K.FEATURE_COLUMNS[:10]) for b in K.FEATURE_COLUMNS[:10][i:]) + ")", FEATURES),
    "headlines": wb(
        ", k AS (SELECT sum(total_activity_bio) AS bio, sum(total_activity_demo) AS demo, "
        "sum(enrollments_age_0_5 + enrollments_age_5_17) AS child, sum(enrollments_age_18_plus) AS adult FROM base) "
        "SELECT CASE WHEN bio > demo THEN 'Biometric updates exceed demographic updates' "
        "ELSE 'Demographic updates exceed biometric updates' END AS update_headline, "
        "CASE WHEN child > adult THEN 'Child enrolments dominate' ELSE 'Adult enrolments dominate' END AS enrolment_headline, "
        "format('{:,d} biometric and {:,d} demographic updates', CAST(trunc(bio) AS BIGINT), CAST(trunc(demo) AS BIGINT)) "
        "AS volume_text FROM k"),
    "pincode_months": wb(
        "SELECT year_month, state, district, pincode, strftime(CAST(year_month || '-01' AS DATE), '%B %Y') AS month_label, "
        + _r(ENR, "total_enrollments") + " FROM base"),
    "pincode_month_table": wb(
        "SELECT year_month, state, district, pincode, strftime(CAST(year_month || '-01' AS DATE), '%B %Y') AS month_label, "
        + ", ".join(_r(c, c) for c in (
            "updates_age_5_17_bio", "updates_age_18_plus_bio", "updates_age_5_17_demo", "updates_age_18_plus_demo",
            "enrollments_age_0_5", "enrollments_age_5_17", "enrollments_age_18_plus"))
        + ", " + _r(ENR, "total_enrollments") + " FROM base"),
    "age_shares": wb(
        ", k AS (" + " UNION ALL ".join(
            f"SELECT '{name}' AS activity_type, sum(updates_age_5_17_{c}) AS child, sum(updates_age_18_plus_{c}) AS adult FROM base"
            for name, c in (("Biometric Updates", "bio"), ("Demographic Updates", "demo")))
        + ") SELECT activity_type, round(child, 4) AS child, round(adult, 4) AS adult, "
        "CASE WHEN child + adult > 0 THEN round(child / (child + adult) * 100, 4) END AS child_share_pct, "
        "CASE WHEN child + adult > 0 THEN round(adult / (child + adult) * 100, 4) END AS adult_share_pct FROM k"),
    "temporal_coverage": with_master(
        "SELECT year_month, count(*) AS records, " + ", ".join(_r(f"sum({c})", c) for c in
        ("enrollments_age_0_5", "enrollments_age_5_17", "enrollments_age_18_plus")) + " FROM q_enrol GROUP BY year_month"),
    "display_report": wb(
        ", d AS (SELECT district, count(DISTINCT pincode) AS pincodes, sum(total_activity_bio) AS b, "
        f"sum(total_activity_demo) AS dm, sum({ENR}) AS e FROM base GROUP BY district) "
        'SELECT district AS "District", pincodes AS "Pincodes", round(b, 4) AS "Biometric", round(dm, 4) AS "Demographic", '
        'round(e, 4) AS "Total Enrollments", round(b + dm + e, 4) AS "Total Activity", '
        """format('{:,.0f}', round(b + dm + e, 0)) AS "Total Activity Text" """
        'FROM d ORDER BY b + dm + e DESC, district LIMIT 15'),
}
ORACLE["scan_feed_csv"] = ORACLE["clean_feed_bio"]
ORACLE["feed_headers"] = raw_only(
    " SELECT CASE WHEN CAST(pincode AS INTEGER) % 2 = 0 THEN 'date,state,district,pincode,bio_age_5_17,bio_age_17_' "
    "ELSE 'bio_age_17_,bio_age_5_17,pincode,district,state,date' END AS columns, count(*) AS rows, "
    "CAST(0 AS HUGEINT) AS long_rows, CAST(0 AS BIGINT) AS unreadable, CAST(0 AS HUGEINT) AS missing FROM bio_raw GROUP BY 1")
ORACLE["date_extremes"] = raw_only(
    ", c AS (SELECT CAST(try_strptime(date, '%d-%m-%Y') AS DATE) AS date, count(*) AS records FROM demo_raw "
    "WHERE try_strptime(date, '%d-%m-%Y') IS NOT NULL GROUP BY 1) "
    "SELECT * FROM (SELECT date, records, 'earliest' AS \"end\" FROM c ORDER BY date LIMIT 3) "
    "UNION ALL SELECT * FROM (SELECT date, records, 'latest' AS \"end\" FROM c ORDER BY date DESC LIMIT 3)")
ORACLE["monthly_table"] = wb(
    ", m AS (SELECT year_month, count(DISTINCT pincode) AS pincodes, "
    f"sum(total_activity_bio) + sum(total_activity_demo) + sum({ENR}) AS t FROM base GROUP BY year_month) "
    "SELECT year_month, strftime(CAST(year_month || '-01' AS DATE), '%B %Y') AS month_label, round(t, 4) AS total_activity, "
    "pincodes FROM m ORDER BY year_month DESC")
ORACLE["events_date_coverage"] = (
    "SELECT min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date, "
    "CAST(datediff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) AS INTEGER) AS span_days "
    "FROM events WHERE ts IS NOT NULL")
ORACLE["events_missing_dates"] = (
    "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE ts IS NOT NULL), "
    "cal AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d) "
    "SELECT date FROM cal WHERE date NOT IN (SELECT date FROM d)")
ORACLE["events_daily_change"] = (
    "WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS e, sum(value) AS v FROM events GROUP BY 1), "
    "c AS (SELECT day, " + ", ".join(
        f"CASE WHEN lag({x}) OVER (ORDER BY day) = 0 THEN CASE WHEN {x} = 0 THEN NULL ELSE 'Infinity'::DOUBLE END "
        f"ELSE ({x} - lag({x}) OVER (ORDER BY day)) / lag({x}) OVER (ORDER BY day) * 100 END AS {n}"
        for x, n in (("e", "events_change"), ("v", "value_change"))) + " FROM d) "
    "SELECT day, round(events_change, 4) AS events_change, round(value_change, 4) AS value_change FROM c "
    "WHERE events_change IS NOT NULL AND value_change IS NOT NULL")
ORACLE["list_states"] = with_master("SELECT DISTINCT state FROM master WHERE state IS NOT NULL ORDER BY state")
ORACLE.update(fixed_oracles(wm("", FEATURES + ZS)))
