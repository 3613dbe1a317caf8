"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words; each of its documents then has the
fractional copy count target / source size. Whole copies are given outright,
and the fractions are rounded by the pivotal method: two documents meet, mass
moves at random from one to the other until one of them is integral, the other
goes on. The mass that moves is words, so the words of a pair stay what they
were. Documents meet in hashed blocks. The documents of a source begin with one
fraction, so in a block each of them, the longest first, meets all shorter ones
as one partner, who share what moves: the long ones become integral while there
are words enough to take the difference, and the one that stays open is a short
one. The open ones meet two by two in blocks of blocks (a reduction tree) until
a source has one left, which is drawn by its own probability: a source misses
its target by less than that document.

The draws depend only on the seed, the source and the documents, so reruns and
other partitionings give the same mix. Equal rows are counted before the
shuffle and dealt out in chunks, so no block grows with them; rows without
words give none whatever is drawn and take no part in the blocks. Defined
results: a null text has size 0; null is a source of its own, after all others;
sources without words have target 0; an empty table gives an empty mix;
repeated rows are documents of their own, and ties of size go by id and text;
very long texts count whole; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut_lineage, hash_fraction, ship_package, small_enough

#: Documents of a block, on average, blocks that meet at one node of the tree, and equal rows that share a block.
BLOCK_ROWS, FAN_IN, CHUNK = 4096, 64, 256
#: Sources up to which their table is broadcast.
MAX_BROADCAST = 100_000
_EPS = 1e-9


def rank_sources(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (0, 1, ...) by code point, null last; only one row per shuffle partition reaches the driver."""
    spark = sources.sparkSession
    placed = cut_lineage(sources.withColumn("nil", F.col("source").isNull())
                         .orderBy("nil", "source").drop("nil")
                         .withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    start, before = [], 0
    for p, n in sizes:
        start.append((p, before))
        before += n
    if not start:
        return placed.withColumn("rank", F.lit(0).cast("long")).drop("at")
    first = spark.createDataFrame(start, "p long, first long")  # a row for each partition
    return (placed.join(F.broadcast(first), part == F.col("p"))
            .withColumn("rank", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("p", "first", "at"))


def source_targets(sizes: DataFrame, weights: tuple, share: float, cap: float) -> DataFrame:
    """source, n_docs, n_open (those with words), source_size, weight, target of each source.

    ``sizes``: source, size, n (rows of that size).

    Sources share ``share`` times all sizes by weight; no target goes beyond
    ``cap`` times its source's size, the excess is shared anew among the rest.
    Each round of sharing is one aggregate over the table of sources.
    """
    sums = sizes.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n_open"),
                                       F.sum(F.col("n") * F.col("size")).alias("source_size"))
    cycle = F.array([F.lit(float(w)) for w in weights])
    src = cut_lineage(rank_sources(sums)
                      .withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
                      .withColumn("limit", F.col("source_size") * F.lit(float(cap))))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    rate, full = 0.0, -1
    while True:
        over = F.col("limit") <= F.col("weight") * F.lit(rate)
        row = src.agg(F.sum(F.when(over, F.col("limit")).otherwise(0.0)), F.sum(F.when(~over, F.col("weight"))),
                      F.count(F.when(over, 1))).first()
        if row[2] == full or not row[1]:
            break
        full, rate = row[2], (share * total - (row[0] or 0.0)) / row[1]
    target = F.least(F.col("limit"), F.col("weight") * F.lit(rate))
    return src.withColumn("target", target).drop("limit", "rank")


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple:
    """Rounds fractions in order: an array of 0, 1 and at most one open entry, whose place and fraction come with it.

    Two open documents meet; words move from one to the other until one of them is integral. The direction is drawn
    so that each keeps its expectation, and the words that both are expected to give stay the same.
    """
    out, hold, a = np.zeros(len(p)), -1, 0.0
    draws = rng.random(len(p))
    for k in range(len(p)):
        b = float(p[k])
        if b <= _EPS or b >= 1 - _EPS:
            out[k] = round(b)
            continue
        if size[k] == 0:  # gives no words, whatever it becomes
            out[k] = draws[k] < b
            continue
        if hold < 0:
            hold, a = k, b
            continue
        rate = size[hold] / size[k]
        up, down = min(1 - a, b / rate), min(a, (1 - b) / rate)
        move = up if draws[k] * (up + down) < down else -down
        a, b = a + move, b - move * rate
        if _EPS < b < 1 - _EPS:  # the one that was held is integral
            out[hold] = round(a)
            hold, a = k, b
        else:
            out[k] = round(b)
            if not _EPS < a < 1 - _EPS:
                out[hold], hold = round(a), -1
    return out, hold, a


def pivot_shared(b: float, size: np.ndarray, rng: np.random.Generator) -> tuple:
    """Like ``pivot`` for documents with one fraction ``b``, longest first: each meets all behind it as one partner.

    Those behind keep one fraction in common, so a move changes it by the same amount for all of them.
    """
    out, behind = np.zeros(len(size)), np.append(np.cumsum(size[::-1])[::-1][1:], 0.0)
    draws = rng.random(len(size))
    for k in range(len(size)):
        if b <= _EPS or b >= 1 - _EPS:
            out[k:] = round(b)
            break
        if not behind[k]:
            return out, k, b
        rate = size[k] / behind[k]
        up, down = min(1 - b, b / rate), min(b, (1 - b) / rate)
        move = up if draws[k] * (up + down) < down else -down
        a, b = b + move, b - move * rate
        if _EPS < a < 1 - _EPS:  # all that are behind became integral
            out[k + 1:] = round(b)
            return out, k, a
        out[k] = round(a)
    return out, -1, 0.0


def _rng(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "big"))


def _level(df: DataFrame, keep: str, seed: int, level: int) -> DataFrame:
    """Pivots every block: ``taken_one`` 0 or 1, or null with the open fraction in ``p``; ``n`` equal rows become rows."""
    ship_package(df.sparkSession)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "content"], ascending=[False, True, True], na_position="last")
        pdf = pdf.loc[pdf.index.repeat(pdf["n"])].reset_index(drop=True).assign(n=1)
        source = pdf["source"].iloc[0]
        name = None if source is None or source != source else str(source)
        p, size, rng = pdf["p"].to_numpy(), pdf["size"].to_numpy(np.float64), _rng(seed, level, name, int(pdf["block"].iloc[0]))
        out, hold, rest = pivot(p, size, rng) if level else pivot_shared(float(p[0]), size, rng)
        one = pd.array(out.astype("int64"), dtype="Int64")
        if hold >= 0:
            one[hold] = pd.NA
            pdf.loc[hold, "p"] = rest
        return pdf.assign(taken_one=one)

    return df.groupBy("source", "block").applyInPandas(block, keep + ", taken_one long")


def mix(docs: DataFrame, size: Column, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
        seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs``.

    Three shuffles of narrow rows: equal rows and source totals (both combined before the shuffle) and the blocks;
    the levels above hold one row for each block of the level below.
    """
    chunk = min(CHUNK, block_rows)
    sizes = cut_lineage(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", size.cast("long").alias("size"),
                                    F.xxhash64("text").alias("content"))
                        .groupBy("doc_id", "source", "size", "content").agg(F.count("*").alias("n")))
    src = source_targets(sizes, weights, share, cap)
    per = src.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                         .otherwise(0.0)).select(
        F.col("source").alias("s"), "source_size", "target", F.col("ratio"),
        F.greatest(F.ceil(F.col("n_open") / block_rows), F.lit(1)).cast("long").alias("n_blocks"))
    per = F.broadcast(per) if small_enough(per, MAX_BROADCAST) else per
    same = F.col("source").eqNullSafe(F.col("s"))
    whole = F.floor(F.col("ratio") + _EPS)
    rows = (sizes.join(per, same).drop("s")
            .withColumn("base", whole.cast("long"))
            .withColumn("p", F.greatest(F.col("ratio") - whole, F.lit(0.0))).drop("ratio")
            .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))))
            .withColumn("n", F.least(F.lit(chunk), F.col("n") - F.col("chunk") * chunk))
            .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "content", "chunk"), F.col("n_blocks")))
            .drop("n_blocks"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    wordless = (rows.filter("size = 0").repartition("doc_id", "content", "chunk").withColumn("nth", copy)
                .withColumn("taken_one", (hash_fraction(F.lit(seed), "source", "doc_id", "chunk", "nth") < F.col("p")).cast("long"))
                .drop("nth", "chunk"))
    rows = rows.filter("size > 0").drop("chunk")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keep = ", ".join(f"{c} {types[c]}" for c in rows.columns)
    done, level, todo = [wordless], 0, rows
    while True:
        out = cut_lineage(_level(todo, keep, seed, level))
        done.append(out.filter("taken_one is not null"))
        still = out.filter("taken_one is null")
        widest = still.agg(F.max("block")).first()[0]
        if widest is None:
            break
        if widest == 0:  # one open document a source: drawn by what is left of its probability
            draw = F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
            done.append(still.withColumn("taken_one", (draw < F.col("p")).cast("long")))
            break
        todo, level = still.drop("taken_one").withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long")), level + 1
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    copies = F.col("base") + F.col("taken_one")
    return every.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"),
                        (copies * F.col("size")).alias("taken"))


def word_size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0))


def copies_of(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``mix`` repeated as often as they are taken, with ``copy`` 1, 2, ..."""
    return (mix(docs, word_size(), **options).filter("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
