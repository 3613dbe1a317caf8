"""Scans of raw feed folders and derived tables."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import NULL_TOKENS, RAW_MEASURES

_KEY_FIELDS = ["date", "state", "district", "pincode"]

# Raw feeds are read as text and typed by the cleaning operators, so a bad
# value becomes a counted null instead of a failed job.
RAW_SCHEMAS = {
    feed: T.StructType([T.StructField(c, T.StringType()) for c in _KEY_FIELDS + list(measures)])
    for feed, measures in RAW_MEASURES.items()
}


@dataclass(frozen=True)
class Part:
    """A part file of a feed: its path, size and header (column names in order), or why that cannot be read."""

    path: str
    size: int
    header: tuple = ()
    error: str | None = None


def feed_parts(spark: SparkSession, path: str, feed: str, pattern: str = "*.csv") -> list[Part]:
    """The parts of a feed folder by their headers, sorted by path.

    The folder is listed and the first line of each part read through Hadoop's file system, so any store Spark reads
    will do, many parts at a time. Per part a path and one line reach the driver, none of the rows. A part that cannot
    be opened, has no header or names none of the feed's columns is unreadable.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    glob = jvm.org.apache.hadoop.fs.Path(path, pattern)
    listed = [f for f in glob.getFileSystem(conf).globStatus(glob) or () if f.isFile() and f.getPath().getName()[0] not in "_."]

    def look(status) -> Part:
        where, size = status.getPath(), status.getLen()
        name = where.toString()
        try:
            stream = where.getFileSystem(conf).open(where)
            try:
                line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
            finally:
                stream.close()
        except Exception as e:  # noqa: BLE001 - whatever the store raises, the part is listed with it
            return Part(name, size, (), str(e).splitlines()[0])
        header = tuple(next(csv.reader([line.lstrip("\ufeff")]), ())) if line else ()
        if not header:
            return Part(name, size, (), "no header")
        if len(set(header)) < len(header):
            return Part(name, size, header, "a column name twice")
        if not set(header) & set(RAW_SCHEMAS[feed].names):
            return Part(name, size, header, "no column of the feed")
        return Part(name, size, header)

    with ThreadPoolExecutor(16) as pool:
        return sorted(pool.map(look, listed), key=lambda part: part.path)


#: Holds the cell after the last column of the header: only a row with too many cells has one.
_MORE = "_more"


def _scan_parts(spark: SparkSession, parts: list[Part], feed: str) -> DataFrame:
    """Rows of readable parts with the feed's columns, file_name, file_size and ``_more``; one scan for each distinct header."""
    names = RAW_SCHEMAS[feed].names
    by_header: dict[tuple, list] = {}
    for part in parts:
        by_header.setdefault(part.header, []).append(part.path)
    scans = []
    for header, paths in sorted(by_header.items()):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, _MORE)])
        rows = (spark.read.schema(schema).option("header", True).option("escape", '"')
                .option("mode", "PERMISSIVE").csv(paths))
        cells = [F.when(F.col(f"`{c}`").isin(NULL_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c)
                 for c in names if c in header]
        scans.append(rows.select(*cells, F.col("_metadata.file_name").alias("file_name"),
                                 F.col("_metadata.file_size").alias("file_size"), _MORE))
    if not scans:
        schema = T.StructType([*RAW_SCHEMAS[feed].fields, T.StructField("file_name", T.StringType()),
                               T.StructField("file_size", T.LongType()), T.StructField(_MORE, T.StringType())])
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def scan_feed(spark: SparkSession, path: str, feed: str, with_file: bool = False,
              skip_corrupt_files: bool = False) -> DataFrame:
    """All ``*.csv`` parts of a feed folder as one DataFrame, united by column name.

    Parts may have their columns in any order, lack some (null) or have others (left out); there is one parallel scan
    for each distinct header. Null tokens that pandas treats as missing become SQL NULL, cells missing at the end of a
    row are null. An unreadable part (see ``feed_parts``) fails the call, a row with more cells than its header fails
    the job, naming the part. With ``skip_corrupt_files`` such parts are left out as a whole; ``feed_inventory`` lists
    them. ``with_file`` adds the part name and size for inventories.
    """
    parts = feed_parts(spark, path, feed)
    if skip_corrupt_files:
        long = {r["file_name"] for r in _scan_parts(spark, [p for p in parts if not p.error], feed)
                .filter(F.col(_MORE).isNotNull()).select("file_name").distinct().collect()}  # names of bad parts
        parts = [p for p in parts if not p.error and p.path.rpartition("/")[2] not in long]
    bad = [f"{p.path.rpartition('/')[2]}: {p.error}" for p in parts if p.error]
    if bad:
        raise ValueError(f"{len(bad)} unreadable parts of feed {feed} in {path}: " + "; ".join(bad[:20]))
    names = RAW_SCHEMAS[feed].names
    rows = _scan_parts(spark, parts, feed)
    told = F.concat(F.lit("more cells than columns in "), "file_name")
    rows = rows.filter(F.when(F.col(_MORE).isNotNull(), F.raise_error(told).cast("boolean")).otherwise(True))
    have = [c for c in names if c in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in names if c not in have})
    return rows.select(*names, *(["file_name", "file_size"] if with_file else []))


def feed_inventory(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """S4 + S5: one row for each part: file_name, file_size, status, error, columns, missing_columns, extra_columns, rows, long_rows.

    ``status`` is ``ok`` or ``unreadable`` (no header, none of the feed's columns, not to be opened, or rows with more
    cells than columns: ``long_rows``). One scan counts the rows of all parts that can be scanned.
    """
    parts = feed_parts(spark, path, feed)
    names = RAW_SCHEMAS[feed].names
    listed = spark.createDataFrame(
        [(p.path.rpartition("/")[2], p.size, p.error, list(p.header), [c for c in names if c not in p.header],
          [c for c in p.header if c not in names]) for p in parts],
        "file_name string, file_size long, error string, columns array<string>, missing_columns array<string>, "
        "extra_columns array<string>")
    counts = _scan_parts(spark, [p for p in parts if not p.error], feed).groupBy(F.col("file_name").alias("_file")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(_MORE).isNotNull()).alias("long_rows"))
    out = listed.join(counts, F.col("file_name") == F.col("_file"), "left").fillna(0, ["rows", "long_rows"])
    out = out.withColumn("error", F.coalesce("error", F.when(F.col("long_rows") > 0, "more cells than columns")))
    return out.select("file_name", "file_size", F.when(F.col("error").isNull(), "ok").otherwise("unreadable").alias("status"),
                      "error", "columns", "missing_columns", "extra_columns", "rows", "long_rows")


def scan_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Read one derived table (master, outputs) in Parquet or CSV with header."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def require_columns(df: DataFrame, cols) -> DataFrame:
    """Raise with the missing names before any job runs."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def select_existing(df: DataFrame, cols) -> DataFrame:
    """Keep the listed columns that exist, in the listed order."""
    present = set(df.columns)
    return df.select([c for c in cols if c in present])


def file_inventory(df: DataFrame, file_col: str = "file_name", size_col: str = "file_size") -> DataFrame:
    """Per part file: rows, columns, size in MB, nulls per column, duplicate rows.

    Duplicates are counted inside each file (rows minus distinct rows), by a
    group-by on the file and all data columns (partial aggregation first).
    """
    data_cols = [c for c in df.columns if c not in (file_col, size_col)]
    base = df.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(data_cols)).alias("columns"),
        F.round(F.max(size_col) / (1024 * 1024), 2).alias("size_mb"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in data_cols],
    )
    dups = (df.groupBy(file_col, *data_cols).count()
            .groupBy(file_col).agg(F.sum(F.col("count") - 1).alias("duplicate_rows")))
    return base.join(dups, file_col, "left")


def files_version(spark: SparkSession, paths: list[str]) -> int:
    """A number that changes with the names, sizes or times of the files below ``paths``; no content is read.

    One row reaches the driver however many files there are.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
             .select("path", "length", "modificationTime"))
    # Two files that swap sizes or times differ too: each file is hashed whole, and the order of the sum is free.
    row = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")), F.count("*")).first()
    return hash((row[0], row[1]))


def cached(df: DataFrame) -> DataFrame:
    """Keep a table in executor memory (spilling to disk) for repeated queries.

    Lost blocks are recomputed from lineage, so executor loss is survivable.
    """
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def refresh(spark: SparkSession) -> None:
    """Drop every cached table (the "refresh data cache" action)."""
    spark.catalog.clearCache()
