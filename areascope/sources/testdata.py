"""Adapter: three raw feeds derived from the driver's TPC-H-style tables.

Every row of ``orders`` (feed "bio") and of ``lineitem`` (feeds "demo", dated
by shipment, and "enrol", dated by order) becomes one raw feed row of text
columns, exactly as a CSV part would deliver it. State = nation, district =
market segment, pincode = 100000 + customer key mod 900000. A deterministic
variant number (key mod 20) injects the dirt the cleaner must handle: case,
blanks (tabs and no-break spaces too), starred districts, unknown, outdated and
null names, city names, short pincodes, impossible
dates and unparsable or fractional counts. No row is filtered here: the work
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _nation_name(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def valid_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid state names for the test tables: the normalised nation names."""
    return table(spark, sf_dir, "nation").select(F.lower(_nation_name(F.col("n_name"))).alias("state"))


def _dirty_keys(key: Column, name: Column, segment: Column, custkey: Column, ts: Column) -> list:
    v, u = key % 20, F.floor(key / 20) % 5
    edge = F.when(u == 0, F.lit("\u00a0")).when(u == 1, F.lit("\t")).otherwise(F.lit(" "))
    state = (F.when(v == 0, F.lower(name))
             .when(v == 1, F.concat(edge, edge, name, edge))
             .when(v == 2, F.replace(name, F.lit(" "), F.lit("  ")))
             .when(v == 3, F.when(u == 0, F.lit("Orissa")).when(u == 1, F.lit("Pondicherry"))
                   .when(u == 2, F.lit("Nagpur City")).otherwise(F.lit("Unknown Place")))
             .when(v == 4, F.lit(None).cast("string"))
             .otherwise(name))
    district = (F.when(v == 5, F.concat(segment, F.lit("  *")))
                .when(v == 6, F.lower(segment))
                .when(v == 7, F.lit(None).cast("string"))
                .otherwise(segment))
    pincode = (F.when(v == 8, F.lit("12345"))
               .otherwise((F.lit(100000) + custkey % 900000).cast("string")))
    date = (F.when(v == 9, F.concat(F.lit("31-02-"), F.year(ts).cast("string")))
            .otherwise(F.date_format(ts, "dd-MM-yyyy")))
    return [date.alias("date"), state.alias("state"), district.alias("district"), pincode.alias("pincode")]


def _qty_text(v: Column, cond: Column, qty: Column, junk: str) -> Column:
    q = qty.cast("bigint").cast("string")
    return (F.when(v == 10, F.lit(junk) if junk == "x" else F.concat(q, F.lit(junk)))
            .when(cond, q).otherwise(F.lit("0")))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # nation is a 25-row dimension table: broadcast is size-bounded.
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        "c_custkey", "c_mktsegment", _nation_name(F.col("n_name")).alias("nation"))


def bio_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    j = o.join(_customers(spark, sf_dir), o.o_custkey == F.col("c_custkey"))
    v = F.col("o_orderkey") % 20
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return j.select(
        *_dirty_keys(F.col("o_orderkey"), F.col("nation"), F.col("c_mktsegment"), F.col("o_custkey"), F.col("o_orderdate")),
        F.when(v == 10, F.lit("x")).when(urgent, F.lit("1")).otherwise(F.lit("0")).alias("bio_age_5_17"),
        F.when(urgent, F.lit("0")).otherwise(F.lit("1")).alias("bio_age_17_"),
    )


def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                 "l_returnflag", "l_linestatus", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")))


def demo_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _line_rows(spark, sf_dir)
    key = F.col("l_orderkey") + F.col("l_linenumber")
    v = key % 20
    q = F.col("l_quantity")
    return j.select(
        *_dirty_keys(key, F.col("nation"), F.col("c_mktsegment"), F.col("o_custkey"), F.col("l_shipdate")),
        _qty_text(v, F.col("l_linestatus") == "F", q, ".7").alias("demo_age_5_17"),
        F.when(F.col("l_linestatus") == "O", q.cast("bigint").cast("string")).otherwise(F.lit("0"))
         .alias("demo_age_17_"),
    )


def enrol_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _line_rows(spark, sf_dir)
    key = F.col("l_orderkey") + F.col("l_linenumber")
    v = key % 20
    q = F.col("l_quantity")
    flag = F.col("l_returnflag")
    return j.select(
        *_dirty_keys(key, F.col("nation"), F.col("c_mktsegment"), F.col("o_custkey"), F.col("o_orderdate")),
        _qty_text(v, flag == "A", q, "x").alias("age_0_5"),
        F.when(flag == "N", q.cast("bigint").cast("string")).otherwise(F.lit("0")).alias("age_5_17"),
        F.when(flag == "R", q.cast("bigint").cast("string")).otherwise(F.lit("0")).alias("age_18_greater"),
    )


def raw_feeds(spark: SparkSession, sf_dir: str) -> dict:
    return {"bio": bio_feed(spark, sf_dir), "demo": demo_feed(spark, sf_dir),
            "enrol": enrol_feed(spark, sf_dir)}


def fixed_labels(features: DataFrame) -> DataFrame:
    """Stand-in for the two fitted models: a cluster and a forest score for every feature row, by a plain rule."""
    band = F.least(F.lit(2), F.floor(F.col("total_activity") / 40))
    month = F.substring("year_month", 6, 2).cast("long")
    spread = (F.col("pincode").cast("long") * 31 + month * 17) % 997
    return features.withColumns({
        "cluster_id": (2 * band + (F.col("update_to_enrol_ratio") >= 1).cast("int")).cast("int"),
        "iforest_score": F.lit(-0.3) - spread / F.lit(2000.0)})
