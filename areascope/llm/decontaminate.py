"""Benchmark decontamination with DataFrame functions only.

The windows (13 consecutive words, or a shorter item as a whole) of all
benchmark items are hashed into a set of bounded size that every task holds;
each document's word windows are hashed in one scan and looked up, the few
hits are verified word by word, and the words they cover are removed, or the
documents in which they cover a twentieth or more.

The set is part of the plan while the benchmark has at most ``MAX_SET``
windows; a larger one is joined by hash instead, with the same result.

Defined results: null and empty texts have no words and no hits; null and
empty items have no windows and never count; repeated items count one by one
if their ids differ, all without an id count as one, which has no place among
the listed ids; repeated documents are judged row by row; an empty
benchmark leaves everything clean; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, small_enough

WINDOW = 13
MAX_SET = 100_000
#: Words hold digits, ASCII letters and everything beyond ASCII.
_TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Array of the words, A-Z lower-cased; empty for null."""
    return F.coalesce(F.regexp_extract_all(_ascii_lower(text), F.lit(_TOKEN), F.lit(0)), F.array().cast("array<string>"))


def _ascii_lower(text: Column) -> Column:
    """``lower`` where it changes A-Z alone, ``translate`` for texts in which it would change more."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.char_length(text), low).otherwise(F.translate(text, _UPPER, _LOWER))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """item_id, win (array of words), len, h: the distinct windows of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
    size = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    return (items.filter("size(w) > 0")
            .select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win"))
            .distinct().select("item_id", "win", F.size("win").alias("len"), _hash(F.col("win")).alias("h")))


def _hash(win: Column) -> Column:
    """Hash of a window, from the hashes of its words."""
    return F.xxhash64(F.transform(win, lambda w: F.xxhash64(w)))


def _window_at(n: int):
    return lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.xxhash64(F.slice("wh", i, n)).alias("h"))


def _windows(lens: list[int]) -> Column:
    """array<struct<pos, len, h>> of a document's windows of each length."""
    arrays = []
    for n in lens:
        # Sizes are read off the hashes on purpose: a column that is read twice is not inlined into the lambda below,
        # where it would be computed anew for every window.
        starts = F.when(F.size("wh") >= n, F.sequence(F.lit(1), F.size("wh") - n + 1)).otherwise(
            F.array().cast("array<int>"))

        arrays.append(F.transform(starts, _window_at(n)))
    return F.concat(*arrays) if len(arrays) > 1 else arrays[0]


def scan(docs: DataFrame, windows: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """The columns of ``docs`` (__row, text) without the text, n_words and ``hits``: array<struct<pos, len, win>>."""
    lens = sorted(r[0] for r in windows.select("len").distinct().collect())  # 13 numbers at most
    rest = [c for c in docs.columns if c != "text"]
    base = docs.select(*rest, words_of(F.col("text")).alias("w"))
    none = F.array().cast("array<struct<pos:int,len:int,win:array<string>>>")
    if not lens:
        return base.select(*rest, F.size("w").cast("long").alias("n_words"), none.alias("hits"))
    hashes = windows.select("h").distinct()
    base = base.withColumn("wh", F.transform("w", lambda w: F.xxhash64(w)))
    if small_enough(hashes, max_set):
        held = ", ".join(f"{r[0]}L" if r[0] > -(1 << 63) else "-9223372036854775807L - 1L" for r in hashes.collect())
        # Parsed in one go; Spark turns the list into a hash set.
        found = F.expr(f"filter(found, s -> s.h in ({held}))")
        base = base.withColumn("found", _windows(lens)).withColumn("found", found)
        found = F.col("found")
        return base.select(*rest, F.size("w").cast("long").alias("n_words"), F.transform(
            found, lambda s: F.struct(s["pos"], s["len"], F.slice("w", s["pos"], s["len"]).alias("win"))).alias("hits"))
    # A benchmark too large to hold: windows meet the hashes in a join, hits go back to their row.
    rows = cut_lineage(base.withColumn("row", F.monotonically_increasing_id()))
    near = rows.select("row", F.explode(_windows(lens)).alias("s")).select("row", "s.*")
    found = near.join(hashes, "h").groupBy("row").agg(F.collect_list(F.struct("pos", "len")).alias("at"))
    return rows.join(found, "row", "left").select(*rest, F.size("w").cast("long").alias("n_words"), F.coalesce(
        F.transform("at", lambda s: F.struct(s["pos"], s["len"], F.slice("w", s["pos"], s["len"]).alias("win"))),
        none).alias("hits"))


def judge(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, hit_share: int = 20,
          max_set: int = MAX_SET) -> DataFrame:
    """Columns of ``docs`` with n_words, n_hit, n_items, items (sorted ids), spans (array of first and last hit words), contaminated.

    Rows without a candidate never leave their task; those with one are verified against the benchmark's windows.
    """
    windows = cut_lineage(benchmark_windows(benchmark, n))
    rows = docs.select(F.struct([c for c in docs.columns if c != "text"]).alias("__row"), "text")
    # The scan is kept: its candidates are read twice.
    seen = cut_lineage(scan(rows, windows, max_set).withColumn("row", F.monotonically_increasing_id()))
    near = seen.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("s")).select("row", "s.*")
    sure = near.join(windows.select("win", "item_id"), "win").select("row", "pos", "len", "item_id")
    items = sure.select("row", "item_id").distinct().groupBy("row").agg(
        F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("items"))
    # Words are numbered from 1. A hit opens a span unless an earlier hit of its row reaches up to it.
    ends = sure.groupBy("row", "pos").agg((F.max("len") + F.col("pos") - 1).alias("last"))
    by_row = Window.partitionBy("row").orderBy("pos")
    reach = F.max("last").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach >= F.col("pos") - 1, 0).otherwise(1)
    spans = (ends.withColumn("opens", opens).withColumn("span", F.sum("opens").over(by_row))
             .groupBy("row", "span").agg(F.min("pos").alias("first"), F.max("last").alias("last"))
             .groupBy("row").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n_hit"),
                                 F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans")))
    out = seen.drop("hits").join(items.join(spans, "row"), "row", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")),
                           "n_items": F.coalesce("n_items", F.lit(0).cast("long")),
                           "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select("__row.*", "n_words", "n_hit", "n_items", "items", "spans",
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * hit_share >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept."""
    key = F.xxhash64("text")
    bad = judge(docs.select("doc_id", key.alias("th"), "text"), benchmark, **options).filter("contaminated").select(
        F.col("doc_id").alias("bad_id"), F.col("th").alias("bad_th")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (key == F.col("bad_th")), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id and the words of each document, joined by single spaces, without the hit ones."""
    marked = docs.select("doc_id", "text", F.col("text").alias("__text"))
    out = judge(marked, benchmark, **options)
    words = words_of(F.col("__text"))
    kept = F.filter(words, lambda w, i: ~F.exists(
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")),
        lambda s: (s["first"] <= i + 1) & (s["last"] >= i + 1)))
    return out.select("doc_id", F.array_join(kept, " ").alias("text"))
