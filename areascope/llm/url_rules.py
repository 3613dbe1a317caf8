"""URL rules as intervals over reversed hosts, met by a sorted sweep.

A host is turned round label by label (``www.example.com`` becomes
``com.example.www.``), so a rule for a host and all its subdomains is one
interval of the sorted keys and rules nest like brackets. URLs and rules are
sorted together by key within ranges; one pass keeps the stack of rules whose
interval is open and takes, of those whose path starts the url's path, the
longest.

Ranges are cut at quantiles of the keys with the path and the id behind the
host, so one host with a third of all urls is spread over many ranges. A rule
that is open across a cut is handed to every range that it reaches into: for
one range those are rules of one host's parents, at most.

Defined results: a null url or one without ``://`` has an empty host and path
and no rule; an empty rule host fits every host; equal rules are one, and of
rules that differ in the verdict alone ``block`` wins; other columns are kept
out; repeated rows are judged row by row.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ship_package, shuffle_parts, small_enough

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys looked at when ranges are cut, for each range; ids hash evenly, so cuts are near the quantiles.
KEYS_A_RANGE = 40


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_flat(url), r"^[\s\S]*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_flat(url), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def _flat(url: Column) -> Column:
    return F.coalesce(url, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a character below all others, so that parents sort before children.

    The empty host has the empty key, the root of all intervals.
    """
    turned = F.array_join(F.reverse(F.split(host, r"\.")), "\u0001")
    return F.when(host == "", F.lit("")).otherwise(F.concat(turned, F.lit("\u0001")))


def _cuts(urls: DataFrame, ranges: int) -> list[tuple]:
    """At most ``ranges`` - 1 sorted (key, path, id hash) tuples near the quantiles, from a bounded draw of keys."""
    total = urls.count()
    want = ranges * KEYS_A_RANGE
    share = min(1.0, want / max(1, total))
    some = urls.filter(F.pmod("spread", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("key", "path", "spread")
    rows = sorted((r[0].encode(), r[1].encode(), r[2]) for r in some.limit(4 * want).collect())
    if not rows:
        return []
    at = sorted({round(i * len(rows) / ranges) for i in range(1, ranges)})
    return sorted({rows[i] for i in at if i < len(rows)})


def judge(urls: DataFrame, rules: DataFrame, keep: list[str], url: str = "url", default: str = "allow",
          ranges: int | None = None) -> DataFrame:
    """Columns ``keep`` of ``urls`` with host, path, rule (host + path, or null) and verdict.

    ``rules`` has host, path and verdict. One shuffle of the urls by range; rules travel to the ranges they touch.
    """
    spark = urls.sparkSession
    ship_package(spark)
    ranges = ranges or max(4, 4 * shuffle_parts(spark))
    u = urls.select(F.struct(*keep).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    u = u.select("id", "host", "path", host_key(F.col("host")).alias("key"), F.xxhash64("id", "host", "path").alias("spread"))
    cuts = _cuts(u, ranges)

    @F.pandas_udf("int")
    def range_of(key, path, spread):
        import pandas as pd
        return pd.Series([bisect.bisect_right(cuts, (k.encode(), p.encode(), s)) for k, p, s in zip(key, path, spread)],
                         dtype="int32")

    first_key = [b""] + [c[0] for c in cuts]

    @F.udf("array<int>")
    def ranges_of(key):
        # Keys of a rule's hosts lie in [key, key + last character]; ranges hold [first_key[i], first_key[i + 1]].
        low, high = key.encode(), key.encode() + b"\xff"
        start = max(0, bisect.bisect_left(first_key, low) - 1)
        return [i for i in range(start, len(first_key)) if first_key[i] < high or i == start]

    clean = (rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    r = clean.withColumn("key", host_key(F.translate("host", _UPPER, _LOWER)))
    r = r.withColumn("range", F.explode(ranges_of("key")))
    null_id = F.lit(None).cast(u.schema["id"].dataType)
    events = u.select(range_of("key", "path", "spread").alias("range"), "key", F.lit(1).alias("kind"), "id", "host", "path",
                      F.lit(None).cast("string").alias("verdict")).unionByName(
        r.select("range", "key", F.lit(0).alias("kind"), null_id.alias("id"), "host", "path", "verdict"))
    laid = (events.repartition(len(cuts) + 1, "range")
            .sortWithinPartitions("range", "key", "kind", "path"))
    id_type = u.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type)] + [T.StructField(c, T.StringType()) for c in (
        "host", "path", "rule", "verdict")])
    arrow = to_arrow_schema(schema)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list = []  # (key, host, path, verdict) of rules whose interval is open, outermost first
        at = None
        for batch in batches:
            ids = batch.column("id")
            d = {c: batch.column(c).to_pylist() for c in ("range", "key", "kind", "host", "path", "verdict")}
            picked, rows = [], []
            for i, (rng, key, kind, host, path, verdict) in enumerate(zip(*d.values())):
                if rng != at:
                    stack, at = [], rng
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((key, host, path, verdict))
                    continue
                fits = [s for s in stack if path.startswith(s[2]) and (host or not s[1])]
                best = max(fits, key=lambda s: (len(s[1]) + len(s[2]), len(s[1]), s[2]), default=None)
                picked.append(i)
                rows.append((host, path, best and best[1] + best[2], best[3] if best else default))
            cols = list(zip(*rows)) if rows else [()] * 4
            chosen = ids.take(pa.array(picked, pa.int64())).cast(arrow.field("id").type)
            yield pa.RecordBatch.from_arrays([chosen] + [pa.array(c, pa.string()) for c in cols], schema=arrow)

    out = laid.mapInArrow(sweep, schema)
    return out.select("id.*", "host", "path", "rule", "verdict")
