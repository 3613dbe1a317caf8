"""Master table: three cleaned monthly feeds merged on (month, area)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .clean import cap_at_percentile, measures_of, percentile_caps, quality_metrics, rollup_period, standardise_feed

FEEDS = ["bio", "demo", "enrol"]
# Block suffix of each feed in the master; the last merge has no collision.
SUFFIX = {"bio": "_bio", "demo": "_demo", "enrol": ""}


def master_columns() -> list:
    cols = list(K.KEYS)
    for f in FEEDS:
        s = SUFFIX[f]
        cols += [m + s for m in measures_of(f)]
        cols += [f"total_activity{s}", f"data_completeness{s}", f"data_quality_score{s}"]
    return cols


def master_measures() -> list:
    return [m + SUFFIX[f] for f in FEEDS for m in measures_of(f)]


def fill_master(df: DataFrame) -> DataFrame:
    """Nulls -> 0 only in measure and quality-score columns; totals and
    completeness of a missing feed stay null."""
    cols = [c for c in df.columns if "update" in c or "enrollment" in c or "quality_score" in c]
    return df.fillna(0, subset=cols)


def build_master(raw: dict, valid_states=None, aliases=None, final_trim: bool = False,
                 daily_hook=None, caps: dict | None = None) -> DataFrame:
    """Raw feeds -> master table with ONE shuffle of the rows.

    Equivalent to cleaning each feed, rolling each up to months and joining the
    three monthly tables with two full outer joins, because each feed is unique
    per key after its roll-up. Here the validated daily rows of the three feeds
    are unioned (each feed fills only its own suffixed measure columns), capped
    at each feed's own p99 (exact, from counted values: a number a measure) and
    summed per (month, area) in a single partially-aggregated group-by: a hot
    key is combined map-side before the shuffle.
    """
    all_measures = master_measures()
    parts = []
    for f in FEEDS:
        daily = standardise_feed(raw[f], f, valid_states, aliases, final_trim)
        own = {m + SUFFIX[f]: F.col(m).cast("double") for m in measures_of(f)}
        parts.append(daily.select(
            F.date_format("date", "yyyy-MM").alias("year_month"), "state", "district", "pincode",
            *[(own[c] if c in own else F.lit(None).cast("double")).alias(c) for c in all_measures]))
    daily = parts[0].unionByName(parts[1]).unionByName(parts[2])
    if daily_hook is not None:
        daily = daily_hook(daily)
    capped = cap_at_percentile(daily, all_measures, caps=caps)
    capped = capped.filter(" AND ".join(f"{k} IS NOT NULL" for k in K.KEYS))
    monthly = capped.groupBy(*K.KEYS).agg(*[F.sum(c).alias(c) for c in all_measures])
    for f in FEEDS:
        s, ms = SUFFIX[f], [m + SUFFIX[f] for m in measures_of(f)]
        present = F.col(ms[0]).isNotNull()
        scored = quality_metrics(monthly, ms, s)
        monthly = scored.withColumns({c: F.when(present, F.col(c)) for c in
                                      (f"total_activity{s}", f"data_completeness{s}", f"data_quality_score{s}")})
    return fill_master(monthly.select(*master_columns()))


def write_master(raw: dict, path: str, valid_states=None, aliases=None, final_trim: bool = False,
                 partition_by=None) -> str:
    """Build the master and write it as Parquet, reading the raw feeds once.

    The validated daily union feeds two consumers (the p99 aggregate and the
    roll-up); it is persisted (memory, spilling to disk; lost blocks are
    recomputed) for the duration of the write instead of parsing the raw
    feeds twice, then released.
    """
    from pyspark import StorageLevel
    held = []

    def keep(df):
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    master = build_master(raw, valid_states, aliases, final_trim, daily_hook=keep)
    w = master.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    for df in held:
        df.unpersist()
    return path


def write_master_by_month(raw: dict, path: str, valid_states=None, aliases=None, final_trim: bool = False) -> str:
    """The master as Parquet, a folder for each month, with the caps it was built with beside it (``<path>-caps``)."""
    from pyspark import StorageLevel
    held, caps = [], {}

    def keep(df):
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        caps.update(percentile_caps(held[-1], master_measures()))
        return held[-1]

    master = build_master(raw, valid_states, aliases, final_trim, daily_hook=keep, caps=caps)
    master.write.mode("overwrite").partitionBy("year_month").parquet(path)
    for df in held:
        df.unpersist()
    spark = master.sparkSession
    (spark.createDataFrame(sorted(caps.items()), "measure string, cap double").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}-caps"))
    return path


def refresh_months(raw: dict, path: str, months: list, valid_states=None, aliases=None,
                   final_trim: bool = False) -> str:
    """Rebuilds the given months of a master by month; the folders of all other months stay as they are.

    ``raw`` holds every raw row of these months (more may be there). The caps are those of the last whole build: a
    p99 over all months would change months that got no new rows; ``write_master_by_month`` takes it anew. A month
    left without valid rows keeps its old folder.
    """
    spark = next(iter(raw.values())).sparkSession
    caps = {r["measure"]: r["cap"] for r in spark.read.parquet(f"{path}-caps").collect()}  # a row for each measure
    wanted = F.col("year_month").isin(list(months))
    master = build_master(raw, valid_states, aliases, final_trim, daily_hook=lambda df: df.filter(wanted), caps=caps)
    (master.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year_month").parquet(path))
    return path


def read_master(spark, path: str) -> DataFrame:
    """A master by month; the months stay text whatever Spark would make of the folder names."""
    doubles = ", ".join(f"`{c}` double" for c in master_columns() if c not in K.KEYS)
    schema = f"state string, district string, pincode int, {doubles}, year_month string"
    return spark.read.schema(schema).parquet(path).select(*master_columns())


def write_feeds(raw: dict, folder: str, name: str, valid_states=None, aliases=None, final_trim: bool = False,
                buckets: int | None = None) -> dict:
    """Cleans the three feeds and writes them as tables bucketed and sorted by the four keys, each raw feed parsed once.

    Returns feed -> table name, and ``keys`` -> the table of all keys, dealt alike. Each (month, area) is one row of a
    feed, so buckets are even whatever the rows of an area; ``buckets`` (the shuffle partitions unless given) fits
    the monthly rows.
    """
    from pyspark import StorageLevel
    spark = next(iter(raw.values())).sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(df: DataFrame, kind: str) -> str:
        (df.write.mode("overwrite").format("parquet").bucketBy(buckets, *K.KEYS).sortBy(*K.KEYS)
         .option("path", f"{folder.rstrip('/')}/{name}_{kind}").saveAsTable(f"{name}_{kind}"))
        return f"{name}_{kind}"

    tables = {}
    for f in FEEDS:
        daily = standardise_feed(raw[f], f, valid_states, aliases, final_trim).persist(StorageLevel.MEMORY_AND_DISK)
        ms = measures_of(f)
        monthly = quality_metrics(rollup_period(cap_at_percentile(daily, ms), ms), ms)
        tables[f] = write(monthly.repartition(buckets, *K.KEYS), f)
        daily.unpersist()
    # Read as plain files: a union of bucketed scans claims a partitioning that it need not have when it runs.
    keys = [spark.read.schema(spark.table(t).schema).parquet(f"{folder.rstrip('/')}/{t}").select(*K.KEYS)
            for t in tables.values()]
    every = keys[0].unionByName(keys[1]).unionByName(keys[2])
    tables["keys"] = write(every.repartition(buckets, *K.KEYS).distinct(), "keys")
    return tables


def merge_written(spark, tables: dict) -> DataFrame:
    """J1 + J2 + P14 over the tables of ``write_feeds``: outer joins bucket by bucket, without a shuffle.

    A full outer join leaves no known partitioning, so a second one would shuffle again; left joins onto the table
    of all keys give the same rows and keep the buckets.
    """
    m = spark.table(tables["keys"])
    for f in FEEDS:
        df = spark.table(tables[f])
        m = m.join(df.select(*K.KEYS, *[F.col(c).alias(c + SUFFIX[f]) for c in df.columns if c not in K.KEYS]),
                   K.KEYS, "left")
    return fill_master(m.select(*master_columns()))


def merge_feeds(bio: DataFrame, demo: DataFrame, enrol: DataFrame) -> DataFrame:
    """J1 + J2 + P14 on already cleaned monthly feeds: full outer joins on the
    four keys, suffixing the colliding bio/demo columns first."""
    def suffixed(df, s):
        return df.select(*K.KEYS, *[F.col(c).alias(c + s) for c in df.columns if c not in K.KEYS])
    m = suffixed(bio, "_bio").join(suffixed(demo, "_demo"), K.KEYS, "full")
    m = m.join(enrol, K.KEYS, "full")
    return fill_master(m.select(*master_columns()))


def feed_from_master(master: DataFrame, feed: str) -> DataFrame:
    """The cleaned monthly table of one feed, recovered from the master (narrow)."""
    s = SUFFIX[feed]
    cols = [m + s for m in measures_of(feed)] + [f"total_activity{s}", f"data_completeness{s}",
                                                 f"data_quality_score{s}"]
    out = master.filter(F.col(f"total_activity{s}").isNotNull())
    return out.select(*K.KEYS, *[F.col(c).alias(c[: len(c) - len(s)] if s else c) for c in cols])


def cleaning_report(feeds: dict, master: DataFrame) -> DataFrame:
    """One row per dataset with counts, sorted state list, month range,
    mean quality and total activity (null for the master)."""
    rows = []
    for name, df in list(feeds.items()) + [("master", master)]:
        has_q = name != "master"
        rows.append(df.agg(
            F.lit(name).alias("dataset"),
            F.count(F.lit(1)).alias("final_records"),
            F.countDistinct("state").alias("unique_states"),
            F.sort_array(F.collect_set("state")).alias("states_list"),
            F.countDistinct("district").alias("unique_districts"),
            F.countDistinct("pincode").alias("unique_pincodes"),
            F.concat(F.min("year_month"), F.lit(" to "), F.max("year_month")).alias("date_range"),
            (F.avg("data_quality_score") if has_q else F.lit(None).cast("double")).alias("quality_score_mean"),
            (F.sum("total_activity").cast("bigint") if has_q else F.lit(None).cast("bigint")).alias("total_activity"),
        ))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def cleaning_comparison(raw: dict, clean: dict) -> DataFrame:
    """Rows, distinct states and districts per feed, before and after cleaning."""
    out = None
    for name in raw:
        for stage, df in (("before", raw[name]), ("after", clean[name])):
            r = df.agg(F.lit(name).alias("dataset"), F.lit(stage).alias("stage"),
                       F.count(F.lit(1)).alias("records"),
                       F.countDistinct("state").alias("unique_states"),
                       F.countDistinct("district").alias("unique_districts"))
            out = r if out is None else out.unionByName(r)
    return out
