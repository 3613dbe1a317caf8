"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver's tables (through the feed adapter in
``sources.testdata``), so its work grows with them. Double columns are rounded
to 4 decimals so engines that add in another order agree on values.
Model-run queries share one materialised run per session and data folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import title_case
from ..operators import clean as CL
from ..operators import features as FE
from ..operators import master as MA
from ..operators import models as MO
from ..operators import outputs as OU
from ..operators import profile as PR
from ..operators import ranking as RK
from ..operators import reports as RE
from ..operators import trends as TR
from ..sources import testdata as TD
from ..sources.files import feed_inventory, file_inventory, files_version, scan_feed
from ..session import checkpoint_dir, compile_stages, keep_table
from . import fixed_labels
from . import runs as RU

SCALE = 4
QUERIES: dict = {}


def rounded(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """Round every double column to ``scale`` decimals."""
    return df.select([F.round(F.col(f.name), scale).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                      else F.col(f.name) for f in df.schema.fields])


def query(name: str):
    def deco(fn):
        def run(spark, sf_dir):
            compile_stages(spark)
            return rounded(fn(spark, sf_dir))
        QUERIES[name] = run
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


# ----------------------------------------------------------------- inputs

def raw(spark, sf_dir) -> dict:
    return TD.raw_feeds(spark, sf_dir)


def valid(spark, sf_dir):
    return TD.valid_states(spark, sf_dir)


def fresh_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MA.build_master(raw(spark, sf_dir), valid_states=valid(spark, sf_dir))


#: Tables that the feeds are derived from.
FEED_TABLES = ["nation", "customer", "orders", "lineitem"]
_MASTERS: dict = {}


def data_version(spark: SparkSession, sf_dir: str) -> tuple:
    """Session, folder and listing (names, sizes, times) of the feeds' files: new files under the same path are new data."""
    return (spark.sparkContext.applicationId, sf_dir,
            files_version(spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in FEED_TABLES]))


def scratch_name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:12]}"


def master_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master as the cleaning run leaves it: built once per session and
    version of the data, written as Parquet to the shared checkpoint folder and read
    back, so downstream queries prune columns and push filters into that scan
    instead of re-running the cleaning (the original's reports likewise read
    the cleaning run's output file)."""
    key = data_version(spark, sf_dir)
    if key not in _MASTERS:
        path = f"{checkpoint_dir(spark).rstrip('/')}/{scratch_name('master')}"
        MA.write_master(raw(spark, sf_dir), path, valid_states=valid(spark, sf_dir))
        _MASTERS[key] = path
    return spark.read.parquet(_MASTERS[key])


def report_base(spark, sf_dir) -> DataFrame:
    """The master as the reports read it: numeric nulls -> 0."""
    return master_table(spark, sf_dir).fillna(0)


def typed_feed(spark, sf_dir, feed: str) -> DataFrame:
    """Raw feed with common measure names and integer counts (for profiles)."""
    df = CL.rename_measures(raw(spark, sf_dir)[feed], feed)
    return df.withColumns({m: CL.coerce_count(m) for m in CL.measures_of(feed)})


_RUNS: dict = {}


def model_result(spark, sf_dir) -> RU.ModelRun:
    """One model run per session and version of the data; later queries read its checkpoint."""
    compile_stages(spark)
    key = data_version(spark, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = RU.model_run(master_table(spark, sf_dir))
    return _RUNS[key]


# ----------------------------------------------------------------- cleaning

@query("build_master")
def q_build_master(spark, sf_dir):
    """Cleaning run: three raw feeds -> 20-column master (one shuffle), written
    once to the shared folder (raw feeds parsed once) and read back."""
    return master_table(spark, sf_dir)


@query("merge_feeds")
def q_merge_feeds(spark, sf_dir):
    """Per-feed cleaning, written bucketed by the four keys, then outer joins on them without a shuffle."""
    tables = MA.write_feeds(raw(spark, sf_dir), checkpoint_dir(spark), scratch_name("feeds"), valid(spark, sf_dir))
    return MA.merge_written(spark, tables)


@query("clean_feed_bio")
def q_clean_feed_bio(spark, sf_dir):
    """Cleaned monthly table of one feed."""
    return CL.clean_feed(raw(spark, sf_dir)["bio"], "bio", valid(spark, sf_dir))


@query("rollup_period_week")
def q_rollup_week(spark, sf_dir):
    """A2: weekly (Monday) roll-up of the capped demographic feed."""
    ms = CL.measures_of("demo")
    d = CL.standardise_feed(raw(spark, sf_dir)["demo"], "demo", valid(spark, sf_dir))
    d = keep_table(d.select("date", *K.AREA, *ms), "daily")  # read by the caps and by the roll-up
    return CL.rollup_period(CL.cap_at_percentile(d, ms), ms, "week")


@query("cleaning_counters")
def q_cleaning_counters(spark, sf_dir):
    """Cleaning counters of the demographic feed."""
    return CL.cleaning_counters(raw(spark, sf_dir)["demo"], "demo", valid(spark, sf_dir))


@query("top_invalid_states")
def q_top_invalid(spark, sf_dir):
    """Most frequent invalid state values of the biometric feed."""
    return CL.top_invalid_states(raw(spark, sf_dir)["bio"], "bio", valid_states=valid(spark, sf_dir))


@query("dedup_feed")
def q_dedup(spark, sf_dir):
    """One row per (date, area) of the raw biometric feed."""
    return CL.dedup_feed(raw(spark, sf_dir)["bio"])


@query("cleaning_report")
def q_cleaning_report(spark, sf_dir):
    """Per dataset counts, state list, month range, quality, activity."""
    m = master_table(spark, sf_dir)
    return MA.cleaning_report({f: MA.feed_from_master(m, f) for f in MA.FEEDS}, m)


@query("cleaning_comparison")
def q_cleaning_comparison(spark, sf_dir):
    """Rows, states, districts before (raw) and after cleaning."""
    r = raw(spark, sf_dir)
    m = master_table(spark, sf_dir)
    return MA.cleaning_comparison(r, {f: MA.feed_from_master(m, f) for f in MA.FEEDS})


# ----------------------------------------------------------------- profile

@query("numeric_profile")
def q_numeric_profile(spark, sf_dir):
    """A3/A4/A5: nulls, min, max, mean, median, std, zeros, percentiles."""
    return PR.numeric_profile(typed_feed(spark, sf_dir, "demo"), CL.measures_of("demo"))


@query("outlier_counts")
def q_outlier_counts(spark, sf_dir):
    """rows above p95 and p99 per measure."""
    return PR.outlier_counts(typed_feed(spark, sf_dir, "enrol"), CL.measures_of("enrol"))


@query("top_values")
def q_top_values(spark, sf_dir):
    """Five largest distinct values of a measure."""
    return PR.top_values(typed_feed(spark, sf_dir, "demo"), "updates_age_5_17", 5)


@query("coverage")
def q_coverage(spark, sf_dir):
    """Distinct states, districts, pincodes, months of the master."""
    return PR.coverage(master_table(spark, sf_dir), ("state", "district", "pincode", "year_month"))


@query("duplicate_rows")
def q_duplicate_rows(spark, sf_dir):
    """Full-row duplicates of the raw demographic feed."""
    return PR.duplicate_rows(raw(spark, sf_dir)["demo"])


@query("key_duplicates")
def q_key_duplicates(spark, sf_dir):
    """Rows and groups repeating (date, state, district, pincode)."""
    return PR.key_duplicates(raw(spark, sf_dir)["demo"], ["date", "state", "district", "pincode"])


@query("column_duplicates")
def q_column_duplicates(spark, sf_dir):
    """A10: per column, rows whose value repeats."""
    return PR.column_duplicates(raw(spark, sf_dir)["bio"])


@query("case_variants")
def q_case_variants(spark, sf_dir):
    """State spellings differing by case or edge blanks."""
    return PR.case_variants(raw(spark, sf_dir)["bio"], "state")


@query("area_pairs")
def q_area_pairs(spark, sf_dir):
    """Records per raw (state, district) pair."""
    return PR.area_pairs(raw(spark, sf_dir)["bio"])


@query("date_coverage")
def q_date_coverage(spark, sf_dir):
    """First and last date and span of the raw biometric feed."""
    return PR.date_coverage(raw(spark, sf_dir)["bio"])


@query("date_counts")
def q_date_counts(spark, sf_dir):
    """Records per calendar date."""
    return PR.date_counts(raw(spark, sf_dir)["bio"])


@query("date_extremes")
def q_date_extremes(spark, sf_dir):
    """Three earliest and three latest dates with record counts."""
    return PR.date_extremes(raw(spark, sf_dir)["demo"])


@query("list_states")
def q_list_states(spark, sf_dir):
    """Sorted distinct states of the master (pick list)."""
    return RE.list_values(master_table(spark, sf_dir), "state")


@query("events_date_coverage")
def q_events_date_coverage(spark, sf_dir):
    """A13 on the event stream table: first/last day and span."""
    return PR.date_coverage(TD.table(spark, sf_dir, "events"), "ts", parse=False)


@query("events_missing_dates")
def q_events_missing_dates(spark, sf_dir):
    """J5 on the event stream table: days without any event."""
    return PR.missing_dates(TD.table(spark, sf_dir, "events"), "ts", parse=False)


@query("events_daily_change")
def q_events_daily_change(spark, sf_dir):
    """W7 by day: day-over-day percent change of event counts and values."""
    daily = (TD.table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"))
             .agg(F.count(F.lit(1)).cast("double").alias("events"), F.sum("value").alias("value")))
    return RE.pct_change(daily, ["events", "value"], order="day").select("day", "events_change", "value_change")


@query("missing_dates")
def q_missing_dates(spark, sf_dir):
    """Calendar days without records."""
    return PR.missing_dates(raw(spark, sf_dir)["bio"])


@query("null_counts")
def q_null_counts(spark, sf_dir):
    """Nulls per column of the raw biometric feed."""
    return PR.null_counts(raw(spark, sf_dir)["bio"])


@query("region_counts")
def q_region_counts(spark, sf_dir):
    """Rows per pincode region."""
    return PR.region_counts(raw(spark, sf_dir)["enrol"])


@query("key_violations")
def q_key_violations(spark, sf_dir):
    """empty districts, null and malformed pincodes with examples."""
    return PR.key_violations(raw(spark, sf_dir)["bio"])


@query("whitespace_issues")
def q_whitespace(spark, sf_dir):
    """State values with blank problems."""
    return PR.whitespace_issues(raw(spark, sf_dir)["bio"], "state")


@query("suspicious_states")
def q_suspicious(spark, sf_dir):
    """City names in the state column."""
    return PR.suspicious_states(raw(spark, sf_dir)["demo"], "state")


@query("deprecated_names")
def q_deprecated(spark, sf_dir):
    """Deprecated state names."""
    return PR.deprecated_names(raw(spark, sf_dir)["enrol"], "state")


@query("state_audit")
def q_state_audit(spark, sf_dir):
    """Distinct raw states across feeds and the feeds holding them."""
    return PR.state_audit(raw(spark, sf_dir))


# ----------------------------------------------------------------- features / trends

@query("build_features")
def q_features(spark, sf_dir):
    """The fifteen model features per master row."""
    f = FE.build_features(master_table(spark, sf_dir))
    return f.select(*K.KEYS, *K.FEATURE_COLUMNS)


@query("district_stats")
def q_district_stats(spark, sf_dir):
    """District mean, sample std, sum of total activity, feed means."""
    f = FE.activity_totals(FE.validate_master(master_table(spark, sf_dir)))
    return FE.district_stats(f)


@query("analyze_trends")
def q_trends(spark, sf_dir):
    """District z-scores, drop/spike/z flags and trend status."""
    master = master_table(spark, sf_dir)
    moments = FE.master_moments(master)
    t = TR.analyze_trends(FE.build_features(master, moments=moments), moments=moments)
    return t.select(*K.KEYS, *[f"{c}_zscore" for c in TR.Z_METRICS], "drop_alert", "spike_alert",
                    "zscore_anomaly", "trend_status")


@query("scale_features")
def q_scale(spark, sf_dir):
    """ML1: standardised features (population std, zero variance -> 0)."""
    f = keep_table(FE.build_features(master_table(spark, sf_dir)).select(*K.KEYS, *K.FEATURE_COLUMNS), "features")
    s = MO.apply_scaler(f, MO.fit_scaler(f, K.FEATURE_COLUMNS), K.FEATURE_COLUMNS)
    return s.select(*K.KEYS, *[f"{c}_scaled" for c in K.FEATURE_COLUMNS])


@query("rank_pct")
def q_rank_pct(spark, sf_dir):
    """Average-tie percentile rank of a master measure (distributed)."""
    m = master_table(spark, sf_dir).select(*K.KEYS, "total_activity_demo")
    return RK.rank_pct(m, "total_activity_demo", "rank_pct")


# ----------------------------------------------------------------- portal reports

@query("title_case_names")
def q_title_case(spark, sf_dir):
    """Display names of every (state, district) pair."""
    m = master_table(spark, sf_dir).select("state", "district").distinct()
    return m.select("state", "district", title_case("state").alias("state_title"),
                    title_case("district").alias("district_title"))


@query("kpis")
def q_kpis(spark, sf_dir):
    """Headline totals."""
    return RE.kpis(report_base(spark, sf_dir))


@query("monthly_trend")
def q_monthly_trend(spark, sf_dir):
    """Monthly sums."""
    return RE.monthly_trend(report_base(spark, sf_dir))


@query("monthly_summary")
def q_monthly_summary(spark, sf_dir):
    """Wide monthly table."""
    return RE.monthly_summary(report_base(spark, sf_dir))


@query("district_summary")
def q_district_summary(spark, sf_dir):
    """District summary by activity."""
    return RE.district_summary(report_base(spark, sf_dir))


@query("state_report")
def q_state_report(spark, sf_dir):
    """State summary report."""
    return RE.state_report(report_base(spark, sf_dir))


@query("pincode_summary")
def q_pincode_summary(spark, sf_dir):
    """Pincode summary by activity."""
    return RE.pincode_summary(report_base(spark, sf_dir))


@query("age_bands")
def q_age_bands(spark, sf_dir):
    """Seven age-band totals, long form."""
    return RE.age_bands(report_base(spark, sf_dir))


@query("activity_split")
def q_activity_split(spark, sf_dir):
    """Three activity types and shares."""
    return RE.activity_split(report_base(spark, sf_dir))


@query("pct_change")
def q_pct_change(spark, sf_dir):
    """Month-over-month percent changes of the monthly trend."""
    m = RE.monthly_trend(report_base(spark, sf_dir))
    return RE.pct_change(m, ["total_activity_bio", "total_activity_demo", "total_enrollments"]).select(
        "year_month", "total_activity_bio_change", "total_activity_demo_change", "total_enrollments_change")


@query("growth_class")
def q_growth_class(spark, sf_dir):
    """First-to-last growth class per area."""
    b = report_base(spark, sf_dir).withColumn(
        "total_activity", F.col("total_activity_bio") + F.col("total_activity_demo") + F.col("enrollments_age_0_5")
        + F.col("enrollments_age_5_17") + F.col("enrollments_age_18_plus"))
    return RE.growth_class(b)


@query("overall_change")
def q_overall_change(spark, sf_dir):
    """First-to-last change of monthly activity."""
    return RE.overall_change(RE.monthly_summary(report_base(spark, sf_dir)))


@query("peak_months")
def q_peak_months(spark, sf_dir):
    """Peak and lowest month and mean monthly activity."""
    return RE.peak_months(RE.monthly_summary(report_base(spark, sf_dir)))


@query("monthly_table")
def q_monthly_table(spark, sf_dir):
    """Monthly table with month labels, newest first (sorted by date)."""
    m = RE.monthly_summary(report_base(spark, sf_dir))
    return RE.monthly_table(m).select("year_month", "month_label", "total_activity", "pincodes")


@query("linear_trend")
def q_linear_trend(spark, sf_dir):
    """Least-squares trend of monthly activity."""
    return RE.linear_trend(RE.monthly_summary(report_base(spark, sf_dir)))


@query("top_states")
def q_top_states(spark, sf_dir):
    """Master rows of the 15 most active states, summed per state."""
    b = report_base(spark, sf_dir).withColumn("total_activity", F.col("total_activity_bio")
                                              + F.col("total_activity_demo"))
    return RE.top_states(b, 15).groupBy("state").agg(F.count(F.lit(1)).alias("rows"),
                                                     F.sum("total_activity").alias("total_activity"))


@query("quality_histogram")
def q_quality_hist(spark, sf_dir):
    """30-bin histogram of the biometric quality score."""
    m = MA.feed_from_master(master_table(spark, sf_dir), "bio")
    return RE.histogram(m, "data_quality_score", 30)


@query("correlation")
def q_correlation(spark, sf_dir):
    """Pearson correlation of the first ten features."""
    f = FE.build_features(master_table(spark, sf_dir))
    return RE.correlation(f, K.FEATURE_COLUMNS[:10])


@query("headlines")
def q_headlines(spark, sf_dir):
    """Headline sentences."""
    return RE.headlines(report_base(spark, sf_dir))


@query("pincode_months")
def q_pincode_months(spark, sf_dir):
    """Every area's months with labels, newest first; the columns of its SQL."""
    return RE.pincode_months(report_base(spark, sf_dir)).select(
        "year_month", "state", "district", "pincode", "month_label", "total_enrollments")


@query("pincode_month_table")
def q_pincode_month_table(spark, sf_dir):
    """Every area's months, newest first, with all seven measures."""
    return RE.pincode_months(report_base(spark, sf_dir))


@query("age_shares")
def q_age_shares(spark, sf_dir):
    """Child and adult shares inside bio and inside demo."""
    return RE.age_shares(report_base(spark, sf_dir))


@query("key_insights")
def q_key_insights(spark, sf_dir):
    """Lines of the start page over all states."""
    return RE.key_insights(report_base(spark, sf_dir))


@query("district_observations")
def q_district_observations(spark, sf_dir):
    """Lines of the district page over all districts."""
    return RE.district_observations(report_base(spark, sf_dir))


@query("temporal_coverage")
def q_temporal_coverage(spark, sf_dir):
    """Rows per month and measure totals of the cleaned enrolment feed."""
    m = MA.feed_from_master(master_table(spark, sf_dir), "enrol")
    return RE.temporal_coverage(m, CL.measures_of("enrol"))


@query("display_report")
def q_display_report(spark, sf_dir):
    """The district table with display names, 15 most active."""
    d = RE.district_summary(report_base(spark, sf_dir))
    d = d.withColumn("total_activity_text", F.format_number("total_activity", 0))
    shown = RE.display(d, {"district": "District", "pincodes": "Pincodes", "biometric": "Biometric",
                           "demographic": "Demographic", "total_enrollments": "Total Enrollments",
                           "total_activity": "Total Activity", "total_activity_text": "Total Activity Text"})
    return RE.head(shown, 15, [F.desc("Total Activity"), F.asc("District")])


@query("scan_feed_csv")
def q_scan_feed_csv(spark, sf_dir):
    """The biometric feed written as CSV parts in two column orders, scanned
    back as one feed (by column name, null tokens) and cleaned to its monthly table."""
    return CL.clean_feed(scan_feed(spark, _feed_folder(spark, sf_dir), "bio"), "bio", valid(spark, sf_dir))


_FEEDS: set = set()


def _feed_folder(spark, sf_dir) -> str:
    """The biometric feed as CSV parts, written once: even pincodes in the usual column order, all others reversed."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/feeds-{abs(hash(sf_dir))}/bio"
    if (spark.sparkContext.applicationId, path) not in _FEEDS:
        rows = raw(spark, sf_dir)["bio"]
        even = F.col("pincode").cast("int") % 2 == 0
        rows.filter(even).write.mode("overwrite").option("header", True).csv(path)
        rows.filter(~even).select(*reversed(rows.columns)).write.mode("append").option("header", True).csv(path)
        _FEEDS.add((spark.sparkContext.applicationId, path))
    return path


@query("feed_headers")
def q_feed_headers(spark, sf_dir):
    """The parts of the scanned feed by column order: rows, rows with too many cells, unreadable parts."""
    parts = feed_inventory(spark, _feed_folder(spark, sf_dir), "bio").filter("rows > 0 or status != 'ok'")
    return parts.groupBy(F.array_join("columns", ",").alias("columns")).agg(
        F.sum("rows").alias("rows"), F.sum("long_rows").alias("long_rows"),
        F.count_if(F.col("status") != "ok").alias("unreadable"),
        F.sum(F.size("missing_columns")).alias("missing"))


# ----------------------------------------------------------------- model run (rows-only)

def _ml(name, fn, doc):
    def run(spark, sf_dir):
        return fn(model_result(spark, sf_dir).result)
    run.__doc__ = doc
    QUERIES[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))


_ml("ml_full_output", OU.full_output, "26-column model output per master row.")
_ml("cluster_stats", MO.cluster_stats, "A15: per cluster statistics, half-even rounding.")
_ml("cluster_summary", OU.cluster_summary, "A18: cluster summary.")
_ml("high_risk_regions", OU.high_risk, "F4/T3: CRITICAL and HIGH rows.")
_ml("monthly_alerts", OU.monthly_alerts, "F5: alert rows.")
_ml("state_summary", OU.state_summary, "A19/P32: state summary with risk score.")
_ml("risk_distribution", lambda d: OU.distribution(d, "risk_category", K.RISK_LEVELS), "A21.")
_ml("trend_distribution", lambda d: OU.distribution(d, "trend_status", K.TREND_LEVELS), "A21.")
_ml("profile_distribution", lambda d: OU.distribution(d, "cluster_profile"), "A21.")
_ml("risk_counts", RE.risk_counts, "A30.")
_ml("risk_pivot", RE.risk_pivot, "A31/T7.")
_ml("trend_counts", RE.trend_counts, "A32.")
_ml("state_profile_crosstab", lambda d: RE.crosstab_pct(d, "state", "cluster_profile"), "A33.")
_ml("profile_risk_crosstab", lambda d: RE.crosstab_pct(d, "cluster_profile", "risk_category"), "A33.")
_ml("normalised_cluster_means", RE.normalised_cluster_means, "A34.")
_ml("cluster_profiles", RE.cluster_profiles, "A35.")
_ml("anomaly_histogram", lambda d: RE.histogram(d, "anomaly_score", 50, "is_anomaly"), "A36.")
_ml("box_stats", lambda d: RE.box_stats(d, "cluster_profile", "total_activity"), "A39.")
_ml("alert_timeline", RE.alert_timeline, "A40.")
_ml("state_anomalies", RE.state_anomalies, "A41/T4.")
_ml("top_critical_state", RE.top_critical_state, "T12.")
_ml("alert_observations", RE.alert_observations, "P44: lines of the alert page.")
_ml("risk_report", lambda d: RE.risk_report(d, None, "CRITICAL"), "F6.")
_ml("full_export", lambda d: RE.full_export(OU.full_output(d)), "F7.")


def q_run_metadata(spark, sf_dir):
    run = model_result(spark, sf_dir)
    return OU.run_metadata(run.result, run.run_timestamp)


def q_choose_k(spark, sf_dir):
    run = model_result(spark, sf_dir)
    return spark.createDataFrame([(k, float(s), k == run.best_k) for k, s in run.silhouettes],
                                 "k int, silhouette double, chosen boolean")


QUERIES["run_metadata"] = q_run_metadata
QUERIES["choose_k"] = q_choose_k


def q_file_inventory(spark, sf_dir):
    """Per part file rows, size, nulls and duplicates of the scanned CSV feed."""
    return file_inventory(scan_feed(spark, _feed_folder(spark, sf_dir), "bio", with_file=True))


QUERIES["file_inventory"] = q_file_inventory
fixed_labels.register(QUERIES, master_table, data_version, rounded)


def flagship(spark, sf_dir):
    """State summary of the master: activity per state (cleaning run end to end)."""
    return QUERIES["state_report"](spark, sf_dir)
