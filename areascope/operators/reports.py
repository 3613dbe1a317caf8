"""Interactive reports over the master and the model outputs.

Each function is a small DataFrame query: filters push down to the Parquet
scan, group-bys are partially aggregated, and ordered outputs break ties on
key columns so results are deterministic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import month_label, month_start, safe_ratio, title_case
from ._util import with_scalars
from .order_stats import counted_quantiles, value_counts

ENROL = ["enrollments_age_0_5", "enrollments_age_5_17", "enrollments_age_18_plus"]
MEASURES = ["updates_age_5_17_bio", "updates_age_18_plus_bio", "updates_age_5_17_demo", "updates_age_18_plus_demo", *ENROL]
ALL_SENTINELS = ("All States", "All Districts", "All Pincodes", "All", None)


def _enrol_total():
    return reduce(lambda a, b: a + b, [F.col(c) for c in ENROL])


def portal_master(master: DataFrame) -> DataFrame:
    """Display names in title case, month start date, numeric nulls -> 0."""
    return master.fillna(0).withColumns({
        "state": title_case("state"), "district": title_case("district"),
        "month": month_start("year_month")})


def drill_down(df: DataFrame, state=None, district=None, pincode=None) -> DataFrame:
    """optional equality filters; sentinels 'All ...' and None mean no filter."""
    for c, v in (("state", state), ("district", district), ("pincode", pincode)):
        if v not in ALL_SENTINELS:
            df = df.filter(F.col(c) == F.lit(v))
    return df


def list_values(df: DataFrame, col: str, **filters) -> DataFrame:
    """Sorted distinct values for pick lists (optionally inside a drill-down)."""
    return drill_down(df, **filters).select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def kpis(df: DataFrame) -> DataFrame:
    """A27 + P40: totals of bio, demo, enrolments; distinct pincodes and months."""
    return df.agg(
        F.sum("total_activity_bio").alias("total_bio"),
        F.sum("total_activity_demo").alias("total_demo"),
        F.sum(_enrol_total()).alias("total_enrollments"),
        F.countDistinct("pincode").alias("pincodes"),
        F.countDistinct("year_month").alias("months"),
    ).withColumn("total_bio_text", F.format_number("total_bio", 0))


def monthly_trend(df: DataFrame) -> DataFrame:
    """Per month sums of the two update totals and enrolment bands."""
    g = df.groupBy("year_month").agg(
        F.sum("total_activity_bio").alias("total_activity_bio"),
        F.sum("total_activity_demo").alias("total_activity_demo"),
        *[F.sum(c).alias(c) for c in ENROL])
    return g.withColumn("total_enrollments", _enrol_total()).orderBy("year_month")


def monthly_summary(df: DataFrame) -> DataFrame:
    """Wide monthly table (9 sums, distinct pincodes, totals)."""
    sums = ["total_activity_bio", "total_activity_demo", *ENROL, "updates_age_5_17_bio",
            "updates_age_18_plus_bio", "updates_age_5_17_demo", "updates_age_18_plus_demo"]
    g = df.groupBy("year_month").agg(*[F.sum(c).alias(c) for c in sums],
                                     F.countDistinct("pincode").alias("pincodes"))
    g = g.withColumn("total_enrollments", _enrol_total())
    return g.withColumn("total_activity", F.col("total_activity_bio") + F.col("total_activity_demo")
                        + F.col("total_enrollments"))


def _area_summary(df: DataFrame, key: str) -> DataFrame:
    g = df.groupBy(key).agg(
        F.countDistinct("pincode").alias("pincodes"),
        F.sum("total_activity_bio").alias("biometric"),
        F.sum("total_activity_demo").alias("demographic"),
        F.sum(_enrol_total()).alias("total_enrollments"))
    return g.withColumn("total_activity", F.col("biometric") + F.col("demographic") + F.col("total_enrollments"))


def district_summary(df: DataFrame, state=None) -> DataFrame:
    """A24 + T13: per district (optionally inside one state), by activity."""
    return _area_summary(drill_down(df, state=state), "district").orderBy(F.desc("total_activity"), "district")


def state_report(df: DataFrame) -> DataFrame:
    """Per state distinct pincodes and districts and sums, by activity."""
    g = df.groupBy("state").agg(
        F.countDistinct("district").alias("districts"),
        F.countDistinct("pincode").alias("pincodes"),
        F.sum("total_activity_bio").alias("biometric"),
        F.sum("total_activity_demo").alias("demographic"),
        F.sum(_enrol_total()).alias("total_enrollments"))
    g = g.withColumn("total_activity", F.col("biometric") + F.col("demographic") + F.col("total_enrollments"))
    return g.orderBy(F.desc("total_activity"), "state")


def pincode_summary(df: DataFrame, state=None, district=None) -> DataFrame:
    """Per pincode sums inside a drill-down, by activity."""
    d = drill_down(df, state=state, district=district)
    g = d.groupBy("pincode").agg(
        F.sum("total_activity_bio").alias("biometric"),
        F.sum("total_activity_demo").alias("demographic"),
        F.sum(_enrol_total()).alias("total_enrollments"),
        F.countDistinct("year_month").alias("months"))
    g = g.withColumn("total_activity", F.col("biometric") + F.col("demographic") + F.col("total_enrollments"))
    return g.orderBy(F.desc("total_activity"), "pincode")


def age_bands(df: DataFrame) -> DataFrame:
    """Seven age-band totals in long form (one aggregate, then unpivot)."""
    bands = {"Bio 5-17": "updates_age_5_17_bio", "Bio 18+": "updates_age_18_plus_bio",
             "Demo 5-17": "updates_age_5_17_demo", "Demo 18+": "updates_age_18_plus_demo",
             "Enrol 0-5": "enrollments_age_0_5", "Enrol 5-17": "enrollments_age_5_17",
             "Enrol 18+": "enrollments_age_18_plus"}
    wide = df.agg(*[F.sum(c).alias(b) for b, c in bands.items()])
    return wide.unpivot([], list(bands), "age_band", "total")


def activity_split(df: DataFrame) -> DataFrame:
    """Three activity types and their share (P41: only when the sum > 0)."""
    wide = df.agg(F.sum("total_activity_bio").alias("Biometric Updates"),
                  F.sum("total_activity_demo").alias("Demographic Updates"),
                  F.sum(_enrol_total()).alias("New Enrollments"))
    long = wide.unpivot([], wide.columns, "activity_type", "total")
    tot = wide.select(sum((F.col(f"`{c}`") for c in wide.columns), F.lit(0)).alias("_tot"))
    out = with_scalars(long, tot)  # one-row total
    return out.select("activity_type", "total",
                      F.when(F.col("_tot") > 0, F.col("total") * 100.0 / F.col("_tot")).alias("share_pct"))


def age_shares(df: DataFrame) -> DataFrame:
    """Child and adult updates inside bio and inside demo and their shares in percent, null unless the sum > 0."""
    kinds = {"Biometric Updates": "bio", "Demographic Updates": "demo"}
    wide = df.agg(*[F.sum(f"updates_age_{a}_{k}").alias(f"{k}_{a}") for k in kinds.values() for a in ("5_17", "18_plus")])
    rows = F.array(*[F.struct(F.lit(name).alias("activity_type"), F.col(f"{k}_5_17").alias("child"),
                              F.col(f"{k}_18_plus").alias("adult")) for name, k in kinds.items()])
    both = F.col("child") + F.col("adult")
    return wide.select(F.inline(rows)).select("activity_type", "child", "adult", *[
        F.when(both > 0, F.col(c) / both * 100).alias(f"{c}_share_pct") for c in ("child", "adult")])


def pct_change(df: DataFrame, cols, order: str = "year_month") -> DataFrame:
    """W7 + F8: per-series percent change on a small ordered table (e.g. the
    monthly trend); prev 0 -> +inf (x > 0) or null (x = 0); null rows dropped."""
    w = Window.orderBy(order)  # months: a few dozen rows, never a base table
    out = df
    for c in cols:
        prev = F.lag(c).over(w)
        out = out.withColumn(f"{c}_change", F.when(prev == 0, F.when(F.col(c) == 0, None)
                                                   .otherwise(F.lit(float("inf"))))
                             .otherwise((F.col(c) - prev) / prev * 100))
    return out.dropna("any", subset=[f"{c}_change" for c in cols])


def growth_class(df: DataFrame, by=("state", "district", "pincode"), value: str = "total_activity") -> DataFrame:
    """P42 + W8: first and last month per group; >1.2x growing, <0.8x declining;
    groups with one month are 'insufficient data'. One aggregate with max_by/min_by."""
    g = df.groupBy(*by).agg(F.min_by(value, "year_month").alias("first_value"),
                            F.max_by(value, "year_month").alias("last_value"),
                            F.count(F.lit(1)).alias("months"))
    cls = (F.when(F.col("months") < 2, "insufficient data")
           .when(F.col("last_value") > F.col("first_value") * K.PINCODE_TREND_UP, "growing")
           .when(F.col("last_value") < F.col("first_value") * K.PINCODE_TREND_DOWN, "declining")
           .otherwise("stable"))
    return g.withColumn("growth_class", cls)


def overall_change(monthly: DataFrame, value: str = "total_activity") -> DataFrame:
    """Change % from the first to the last month (first = 0 -> 0 %), +-10 % classes."""
    g = monthly.agg(F.min_by(value, "year_month").alias("first_total"),
                    F.max_by(value, "year_month").alias("last_total"))
    pct = F.when(F.col("first_total") > 0,
                 (F.col("last_total") - F.col("first_total")) / F.col("first_total") * 100).otherwise(0.0)
    g = g.withColumn("change_pct", pct)
    return g.withColumn("trend", F.when(F.col("change_pct") > K.OVERALL_TREND_PCT, "increased")
                        .when(F.col("change_pct") < -K.OVERALL_TREND_PCT, "decreased").otherwise("stable"))


def peak_months(monthly: DataFrame, value: str = "total_activity") -> DataFrame:
    """A48 + T6: peak and lowest month (earliest on ties), mean monthly activity."""
    return monthly.agg(
        F.min_by("year_month", F.struct(-F.col(value), F.col("year_month"))).alias("peak_month"),
        F.max(value).alias("peak_value"),
        F.min_by("year_month", F.struct(F.col(value), F.col("year_month"))).alias("low_month"),
        F.min(value).alias("low_value"),
        F.avg(value).alias("mean_value"),
    ).withColumn("peak_label", month_label("peak_month"))


def pincode_months(df: DataFrame, state=None, district=None, pincode=None) -> DataFrame:
    """Months of one area (or all), newest first, with labels, all seven measures and the enrolment total."""
    d = drill_down(df, state=state, district=district, pincode=pincode)
    return d.select(*K.KEYS, month_label("year_month").alias("month_label"), *MEASURES,
                    _enrol_total().alias("total_enrollments")).orderBy(
        F.desc("year_month"), *[c for c in K.KEYS if c != "year_month"])


def monthly_table(monthly: DataFrame) -> DataFrame:
    """Month table newest first, sorted by date (not by label text)."""
    return monthly.withColumn("month_label", month_label("year_month")).orderBy(F.desc("year_month"))


def top_k(df: DataFrame, col: str, k: int, key: str) -> DataFrame:
    """T4: k rows with the largest ``col`` (ties by key): TakeOrderedAndProject."""
    return df.orderBy(F.desc(col), F.asc(key)).limit(k)


def top_states(df: DataFrame, k: int = 15, value: str = "total_activity") -> DataFrame:
    """Rows of the k most active states (left semi join to the top-k list)."""
    top = top_k(df.groupBy("state").agg(F.sum(value).alias("_v")), "_v", k, "state").select("state")
    return df.join(F.broadcast(top), "state", "left_semi")  # at most k rows


def risk_report(df: DataFrame, state=None, level=None) -> DataFrame:
    """risk rows by state and level ('All' sentinels), most anomalous first."""
    d = drill_down(df, state=state)
    if level not in ALL_SENTINELS:
        d = d.filter(F.col("risk_category") == level)
    return d.orderBy("anomaly_score", *K.KEYS)


def full_export(df: DataFrame, state=None) -> DataFrame:
    """full table, optional state, month formatted."""
    return drill_down(df, state=state).withColumn("month_label", month_label("year_month"))


def risk_counts(df: DataFrame) -> DataFrame:
    """Rows per risk level (all five levels listed)."""
    lv = df.sparkSession.createDataFrame([(x,) for x in K.RISK_LEVELS], "risk_category string")
    c = df.groupBy("risk_category").agg(F.count(F.lit(1)).alias("count"))
    return lv.join(c, "risk_category", "left").fillna(0, subset=["count"])


def risk_pivot(df: DataFrame, k: int = 15) -> DataFrame:
    """A31 + T7: state x risk level counts (nulls 0), the k states with most CRITICAL."""
    p = df.groupBy("state").pivot("risk_category", K.RISK_LEVELS).count().fillna(0)
    return p.orderBy(F.desc("CRITICAL"), "state").limit(k)


def trend_counts(df: DataFrame) -> DataFrame:
    """Rows per trend status plus drop and spike totals."""
    c = df.groupBy("trend_status").agg(F.count(F.lit(1)).alias("count"))
    t = df.agg(F.sum("drop_alert").alias("drop_alerts"), F.sum("spike_alert").alias("spike_alerts"))
    return with_scalars(c, t)


def crosstab_pct(df: DataFrame, row: str, col: str) -> DataFrame:
    """Row-normalised cross tab in percent (long form: row, col, pct)."""
    c = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(row))
    return c.withColumn("pct", F.col("n") * 100.0 / tot)


ACTIVITIES = ["total_bio_updates", "total_demo_updates", "total_enrollments"]


def normalised_cluster_means(df: DataFrame) -> DataFrame:
    """Means of three activities by cluster profile divided by each column's max (k rows)."""
    g = df.groupBy("cluster_profile").agg(*[F.avg(c).alias(c) for c in ACTIVITIES])
    mx = g.agg(*[F.max(c).alias(f"_max_{c}") for c in ACTIVITIES])  # one row
    g = with_scalars(g, mx)
    return g.select("cluster_profile", *[safe_ratio(F.col(c), F.col(f"_max_{c}")).alias(f"{c}_norm") for c in ACTIVITIES])


def cluster_profiles(df: DataFrame) -> DataFrame:
    """Ratio means, sums of each activity and mean volatility by cluster profile, beside the mean volatility of all rows."""
    g = df.groupBy("cluster_profile").agg(
        F.avg("bio_ratio").alias("bio_ratio_mean"), F.avg("demo_ratio").alias("demo_ratio_mean"),
        F.avg("enrol_ratio").alias("enrol_ratio_mean"),
        *[F.sum(c).alias(f"{c}_sum") for c in ACTIVITIES],
        F.sum("total_activity").alias("total_activity_sum"),
        F.avg("total_activity_volatility").alias("volatility_mean"))
    return with_scalars(g, df.agg(F.avg("total_activity_volatility").alias("volatility_overall_mean")))


def histogram(df: DataFrame, col: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins between the global min and max (last bin closed)."""
    mm = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    x = with_scalars(df, mm)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    keys = [by] if by else []
    x = x.filter(F.col(col).isNotNull()).withColumn("bin", b.cast("int"))
    return x.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"),
                                       F.first("_lo").alias("lo"), F.first("_hi").alias("hi")).select(
        *keys, "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"), "count")


def linear_trend(monthly: DataFrame, value: str = "total_activity") -> DataFrame:
    """Least-squares line over the month index (0, 1, ...) of a monthly table."""
    idx = F.row_number().over(Window.orderBy("year_month")) - 1  # months: small table
    m = monthly.withColumn("_i", idx.cast("double"))
    return m.agg(F.regr_slope(value, "_i").alias("slope"), F.regr_intercept(value, "_i").alias("intercept"),
                 F.count(F.lit(1)).alias("months"))


def correlation(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation of every pair of columns (one aggregate), long form."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    return long.select(F.split("pair", r"\|")[0].alias("x"), F.split("pair", r"\|")[1].alias("y"), "corr")


def box_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """Exact quartiles by group; whiskers are the furthest data points within 1.5 IQR of the box.

    All from the counted values of one scan; a group of missing values only has an empty box.
    """
    counts = value_counts(df, [col], [by])
    q = counted_quantiles(counts, [0.25, 0.5, 0.75], [by]).select(
        F.col(by).alias("_by"), *[F.col("q")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    x = F.col("value")
    inside = F.when(x.between(F.col("q1") - reach, F.col("q3") + reach), x)
    return (counts.join(q, F.col(by).eqNullSafe(F.col("_by")), "left").groupBy(by, "q1", "median", "q3")
            .agg(F.min(x).alias("min"), F.max(x).alias("max"), F.min(inside).alias("whisker_low"),
                 F.max(inside).alias("whisker_high")))


def alert_timeline(df: DataFrame) -> DataFrame:
    """Monthly totals of drops, spikes and anomalies."""
    return df.groupBy("year_month").agg(F.sum("drop_alert").alias("drops"), F.sum("spike_alert").alias("spikes"),
                                        F.sum("is_anomaly").alias("anomalies")).orderBy("year_month")


def state_anomalies(df: DataFrame, k: int = 15) -> DataFrame:
    """Anomaly count and activity per state, the k states with most anomalies."""
    g = df.groupBy("state").agg(F.sum("is_anomaly").alias("anomalies"),
                                F.sum("total_activity").alias("total_activity"))
    return top_k(g, "anomalies", k, "state")


def top_critical_state(df: DataFrame) -> DataFrame:
    """The state with most CRITICAL rows (alphabetical on ties)."""
    g = df.filter(F.col("risk_category") == "CRITICAL").groupBy("state").agg(F.count(F.lit(1)).alias("critical"))
    return top_k(g, "critical", 1, "state")


def headlines(df: DataFrame) -> DataFrame:
    """Headline sentences from one KPI row."""
    k = df.agg(F.sum("total_activity_bio").alias("bio"), F.sum("total_activity_demo").alias("demo"),
               F.sum(F.col("enrollments_age_0_5") + F.col("enrollments_age_5_17")).alias("child"),
               F.sum("enrollments_age_18_plus").alias("adult"))
    return k.select(
        F.when(F.col("bio") > F.col("demo"), F.lit("Biometric updates exceed demographic updates"))
         .otherwise(F.lit("Demographic updates exceed biometric updates")).alias("update_headline"),
        F.when(F.col("child") > F.col("adult"), F.lit("Child enrolments dominate"))
         .otherwise(F.lit("Adult enrolments dominate")).alias("enrolment_headline"),
        F.format_string("%,d biometric and %,d demographic updates", F.col("bio").cast("bigint"),
                        F.col("demo").cast("bigint")).alias("volume_text"))


def _lines(row: DataFrame, lines: list) -> DataFrame:
    """position, line: the texts that are not null over a one-row table."""
    return row.select(F.posexplode(F.array(*lines)).alias("position", "line")).filter("line is not null")


def _whole(col) -> F.Column:
    return F.format_number(col, 0)


def key_insights(df: DataFrame, risk: DataFrame | None = None, state=None) -> DataFrame:
    """Lines of the start page; enrolments only if there are any, critical areas only for a chosen state."""
    k = drill_down(df, state=state).agg(
        F.sum("total_activity_bio").alias("bio"), F.sum("total_activity_demo").alias("demo"),
        F.sum(F.col("enrollments_age_0_5") + F.col("enrollments_age_5_17")).alias("child"),
        F.sum("enrollments_age_18_plus").alias("adult"))
    k = k.fillna(0)  # no rows at all
    chosen = risk is not None and state not in ALL_SENTINELS
    k = with_scalars(k, drill_down(risk, state=state).agg(F.count_if(F.col("risk_category") == "CRITICAL").alias("critical"))
                     ) if chosen else k.withColumn("critical", F.lit(0))
    bio, demo, child, adult = (_whole(c) for c in ("bio", "demo", "child", "adult"))
    return _lines(k, [
        F.when(F.col("bio") > F.col("demo"), F.format_string(
            "Biometric updates (%s) exceed demographic updates (%s). This indicates active identity verification activity.",
            bio, demo)).otherwise(F.format_string(
                "Demographic updates (%s) exceed biometric updates (%s). Address/mobile updates are more common.", demo, bio)),
        F.when(F.col("child") + F.col("adult") > 0, F.when(F.col("child") > F.col("adult"), F.format_string(
            "Child enrollments (%s) are higher than adult enrollments (%s).", child, adult)).otherwise(F.format_string(
                "Adult enrollments (%s) are higher than child enrollments (%s).", adult, child))),
        F.when(F.col("critical") > 0, F.format_string(
            "Alert: %d pincodes in this state require immediate attention due to unusual activity patterns.",
            F.col("critical").cast("long")))])


def district_observations(df: DataFrame, state=None, district=None) -> DataFrame:
    """Busiest and quietest pincode (smallest on ties) and the larger kind of update of a drill-down."""
    g = _area_summary(drill_down(df, state=state, district=district), "pincode")
    pin = F.col("pincode")
    k = g.agg(F.min_by(pin, F.struct(-F.col("total_activity"), pin)).alias("top"), F.max("total_activity").alias("most"),
              F.min_by(pin, F.struct("total_activity", pin)).alias("low"), F.min("total_activity").alias("least"),
              F.sum("biometric").alias("bio"), F.sum("demographic").alias("demo"))
    bio, demo = _whole("bio"), _whole("demo")
    text = [F.col(c).cast("string") for c in ("top", "low")]
    return _lines(k, [
        F.when(F.col("most").isNotNull(), F.format_string("Highest Activity Pincode: %s with %s total transactions", text[0], _whole("most"))),
        F.when(F.col("least").isNotNull(), F.format_string("Lowest Activity Pincode: %s with %s total transactions", text[1], _whole("least"))),
        F.when(F.col("bio") > F.col("demo"), F.format_string(
            "This district has more biometric updates (%s) than demographic updates (%s), indicating active identity verification.",
            bio, demo)).when(F.col("bio").isNotNull(), F.format_string(
                "This district has more demographic updates (%s) than biometric updates (%s), indicating address/mobile updates are common.",
                demo, bio))])


def alert_observations(risk: DataFrame) -> DataFrame:
    """The state with most critical rows, and whether more rows surge or decline."""
    k = risk.agg(F.count_if(F.col("trend_status") == "SURGING").alias("surging"),
                 F.count_if(F.col("trend_status") == "DECLINING").alias("declining"))
    top = top_critical_state(risk).agg(F.max("state").alias("state"), F.max("critical").alias("critical"))  # one row
    k = with_scalars(k, top)
    return _lines(k, [
        F.when(F.col("critical") > 0, F.format_string(
            "%s has the highest number of critical alerts (%d pincodes)", "state", "critical")),
        F.when(F.col("surging") > F.col("declining"), F.format_string(
            "%s pincodes show surging activity patterns. Review these for unusual spikes.", _whole("surging")))
         .otherwise(F.format_string(
             "%s pincodes show declining activity. These may need service improvement.", _whole("declining")))])


def display(df: DataFrame, names: dict) -> DataFrame:
    """Select and rename columns for display, in the listed order."""
    return df.select([F.col(c).alias(a) for c, a in names.items()])


def head(df: DataFrame, n: int, order) -> DataFrame:
    """T5: first n rows in an explicit order (Spark tables have no stored order)."""
    return df.orderBy(*([order] if isinstance(order, str) else order)).limit(n)


def temporal_coverage(df: DataFrame, measures) -> DataFrame:
    """Rows per month and the month's measure totals."""
    return df.groupBy("year_month").agg(F.count(F.lit(1)).alias("records"),
                                        *[F.sum(m).alias(m) for m in measures])
