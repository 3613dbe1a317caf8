"""Exact removal of long repeated substrings with a logarithmic family of suffix arrays.

Suffixes are sampled by content: of every window of ``length`` bytes the
position with the smallest hash of its ``gram`` following bytes is an anchor.
Two equal windows have their anchor at the same offset, so windows can only
repeat where anchors repeat. An index level is a suffix array over the
anchors of some batches: distinct suffix keys (the fingerprint of the suffix's
first ``gram`` bytes) in sorted order, with how often each was seen.

Batches of documents arrive one after another. A batch gets its own suffix
array, which is merge-scanned against every level that exists (sorted merge
join on the suffix key); keys found on either side are long matches. Then it
becomes a level itself, and levels of equal size merge, so there are at most
log2(batches) of them and each suffix is rewritten at most that often.

Anchors whose suffix matched are extended to whole windows. Anchors with equal
surroundings (all bytes of all windows that they decide) repeat as they stand;
of the others, those that share the suffix but not the surroundings, one of
each kind is fetched and its windows compared. Fingerprints have 128 bits, so
at 10^14 windows the odds of any false match are below 10^-10.

A text is known by the fingerprint of its content, so equal texts share their
result. Suffix keys and surroundings are counted with map-side combining, and
the counts come back in joins whose other side has one row per key, which AQE
may split: no key or passage, however frequent, is gathered in one task.

Defined results: null is an empty text; texts under ``length`` bytes lose
nothing; repeated rows repeat all their windows and lose everything if long
enough; empty tables give empty results; other columns are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WORD, byte_array, discard, map_rows, mix64, release, schema_of, scratch_path, sha, ship_package, shuffle_parts, utf8, written

LENGTH = 400
GRAM = 96
BATCHES = 4
#: Window starts handled at a time, so that one long text never needs more than a few MB of work space.
BLOCK = 1 << 19

_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_POWERS: dict = {}
#: Bits of a hash that give way to an index within a block.
_INDEX = np.uint64((1 << 20) - 1)


def _tables(seed: int) -> np.ndarray:
    return mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 + (seed << 20)))


_BYTES = (_tables(1), _tables(2))


def _powers(which: int, n: int) -> tuple:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        base = _BASE[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        m = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(m - 1, base, np.uint64))), dtype=np.uint64)
            down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(m - 1, inverse, np.uint64))), dtype=np.uint64)
        have = _POWERS[which] = (up, down)
    return have


class Fingerprints:
    """Two 64-bit polynomial fingerprints of any substring of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray, both: bool = True) -> None:
        self.sums = []
        for which in range(2 if both else 1):
            up, _ = _powers(which, len(data) + 1)
            with np.errstate(over="ignore"):
                self.sums.append(np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[which][data] * up[: len(data)], dtype=np.uint64))))

    def of(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        _, down = _powers(which, len(self.sums[which]))
        with np.errstate(over="ignore"):
            return mix64((self.sums[which][end] - self.sums[which][start]) * down[start])

    def sliding(self, width: int) -> np.ndarray:
        """Hashes of all substrings of one width, good enough to draw minima by."""
        sums = self.sums[0]
        with np.errstate(over="ignore"):
            h = sums[width:] - sums[:-width]
            h *= _powers(0, len(sums))[1][: len(h)]
            h ^= h >> np.uint64(32)
            h *= _BASE[1]
        return h


def _window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` hashes the index of its smallest, leftmost among equals.

    Hash and index share a word, so plain minima do; runs double up to the largest power of two within ``w``.
    """
    low = (h & ~_INDEX) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n = len(h) - w + 1
    return (np.minimum(low[:n], low[w - width: w - width + n]) & _INDEX).astype(np.int64)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple]:
    """Anchors of one text, block by block: offset of the block, its fingerprints, and within it the positions of the
    anchors and the first and last start of the windows that each decides.

    Every window start from 0 to ``len(data) - length`` belongs to one anchor.
    """
    n = len(data) - length + 1
    for s in range(0, max(n, 0), BLOCK):
        part = data[s: min(n, s + BLOCK) - 1 + length]
        prints = Fingerprints(part)
        pick = _window_argmin(prints.sliding(gram), length - gram + 1)
        cut = np.flatnonzero(pick[1:] != pick[:-1])
        first = np.concatenate(([0], cut + 1))
        yield s, prints, pick[first], first, np.concatenate((cut, [len(pick) - 1]))


def arrow_rows(df: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """Any number of output rows for each input row.

    ``fn()`` gives each task a function of its own from the values of a row to a list of tuples of equally long columns.
    """
    ship_package(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c), type=f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, one = [], 0, fn()
        for values in (v for b in batches for v in zip(*(c.to_pylist() for c in b.columns))):
            for columns in one(*values):
                held.append(columns)
                rows += len(columns[0])
            if rows > 100_000:
                yield batch(held)
                held, rows = [], 0
        if held:
            yield batch(held)

    return df.mapInArrow(run, schema)


#: Distances from an anchor to its first and last window start share a word with its position.
_REACH = 12


def pack(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    # The last start may lie at the anchor but never behind it, the first up to ``length - gram`` before it.
    return (((at << _REACH) | (at - first)) << _REACH) | (at - last)


def unpack(place: np.ndarray) -> tuple:
    at, low = place >> (2 * _REACH), (1 << _REACH) - 1
    return at, at - ((place >> _REACH) & low), at - (place & low)


def suffix_entries(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """t0, t1 (text), suffix key ``k``, fingerprint of the surroundings ``c``, ``place``: a row for each anchor.

    A task that meets a text again tells its anchors twice, which makes them repeats, and not a third time.
    """
    schema = T.StructType.fromDDL("t0 long, t1 long, k long, c long, place long")

    def task():
        met: dict = {}  # texts of this partition

        def one(t0, t1, text):
            met[t0, t1] = times = met.get((t0, t1), 0) + 1
            rows = []
            if times > 2:
                return rows
            for s, prints, at, first, last in anchors(byte_array(text), length, gram):
                with np.errstate(over="ignore"):
                    c = prints.of(first, last + length, 1) ^ mix64(pack(at, first, last) - (at << (2 * _REACH)))
                rows.append((np.full(len(at), t0), np.full(len(at), t1), prints.of(at, at + gram).view(np.int64),
                             c.view(np.int64), pack(at + s, first + s, last + s)))
            return rows
        return one

    return arrow_rows(texts, task, schema)


class SuffixIndex:
    """Logarithmic family of suffix arrays, each a table of the session that is bucketed and sorted by suffix key.

    ``add`` takes the suffix keys of a new batch and returns those that matched, in the batch itself or in a level.
    Tables of one family have equal buckets, so scans and merges of levels are sorted merge joins without a shuffle;
    only a new batch is shuffled, once and by distinct keys. Files lie in the shared checkpoint folder.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark, self.buckets = spark, buckets or shuffle_parts(spark)
        self.folder = scratch_path(spark, "suffix-levels")
        self.name = "suffix_level_" + self.folder.rpartition("-")[2]
        self.step, self.levels = 0, []  # levels: (batches in it, table), largest first
        self.made: list[str] = []

    def _table(self, df: DataFrame) -> str:
        name = f"{self.name}_{self.step}"
        self.step += 1
        (df.write.format("parquet").bucketBy(self.buckets, "k").sortBy("k")
         .option("path", f"{self.folder}/{self.step}").saveAsTable(name))
        self.made.append(name)
        return name

    def add(self, keys: DataFrame) -> DataFrame:
        """``keys``: the column ``k``, a row for each suffix of the batch."""
        array = keys.groupBy("k").agg(F.count("*").alias("n")).repartition(self.buckets, "k")
        name = self._table(array)
        batch = self.spark.table(name)
        matches = [batch.filter("n > 1").select("k")]
        for _, older in self.levels:  # merge scan of two sorted arrays
            matches.append(batch.select("k").hint("merge").join(self.spark.table(older).select("k"), "k", "left_semi"))
        found = written(reduce(DataFrame.unionByName, matches), "suffix-matches")
        self.levels.append((1, name))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, young), (_, old) = self.levels.pop(), self.levels.pop()
            a, b = self.spark.table(old).alias("a"), self.spark.table(young).alias("b")
            both = a.hint("merge").join(b, F.expr("a.k = b.k"), "full").select(
                F.coalesce("a.k", "b.k").alias("k"),
                (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"))
            self.levels.append((2 * size, self._table(both)))
        return found

    def close(self) -> None:
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def matched_keys(entries: DataFrame, batches: int) -> DataFrame:
    """Distinct suffix keys that occur at two places or more, found batch by batch."""
    spark = entries.sparkSession
    index = SuffixIndex(spark)
    found = []
    for b in range(batches):
        found.append(index.add(entries.filter(F.pmod("t0", F.lit(batches)) == b).select("k")))
        release(spark)
    keys = written(reduce(DataFrame.unionByName, found).distinct(), "suffix-keys")
    index.close()
    return keys


def _runs(flags: np.ndarray, start: np.ndarray, owner: np.ndarray) -> tuple:
    """Maximal runs of flagged window starts of one owner: indices of their first and last entries."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    cut = np.flatnonzero((start[at[1:]] != start[at[:-1]] + 1) | (owner[at[1:]] != owner[at[:-1]]))
    return at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple:
    """All window starts from first to last of each range, and the range that each belongs to."""
    count = last - first + 1
    owner = np.repeat(np.arange(len(first)), count)
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count - first, count), owner


def compare_kinds(kinds: DataFrame, length: int, chunk: int = 1 << 22) -> DataFrame:
    """t0, t1, first, last: window starts that repeat among the surroundings of one suffix.

    ``kinds`` (k, t0, t1, place, around) lies sorted by ``k`` in partitions that hold all rows of a key. Windows of
    unlike suffixes never match, so whole stretches of keys are compared at once.
    """
    schema = T.StructType.fromDDL("t0 long, t1 long, first long, last long")
    arrow = to_arrow_schema(schema)

    def compare(rows: list) -> pa.RecordBatch:
        t0, t1, place = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        text = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        base = np.concatenate(([0], np.cumsum([len(r[4]) for r in rows])[:-1]))
        _, first, last = unpack(place)
        start, owner = _spread(np.zeros(len(rows), np.int64), last - first)
        prints, begin = Fingerprints(text), start + base[owner]
        w0, w1 = prints.of(begin, begin + length), prints.of(begin, begin + length, 1)
        order = np.lexsort((w1, w0))
        same = (w0[order[1:]] == w0[order[:-1]]) & (w1[order[1:]] == w1[order[:-1]])
        twice = np.zeros(len(start), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        a, b = _runs(twice, start, owner)
        who = owner[a]
        columns = (t0[who], t1[who], first[who] + start[a], first[who] + start[b])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, key = [], 0, None
        for row in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            if size > chunk and row[0] != key:
                yield compare(rows)
                rows, size = [], 0
            rows.append(row)
            size, key = size + len(row[4]), row[0]
        if rows:
            yield compare(rows)

    return kinds.select("k", "t0", "t1", "place", "around").mapInArrow(run, schema)


def compare_windows(kinds: DataFrame, length: int) -> DataFrame:
    """The same for suffixes with so many surroundings that no task should hold them: window by window."""
    schema = T.StructType.fromDDL("w0 long, w1 long, t0 long, t1 long, first long")

    def one(t0, t1, place, around):
        _, first, last = (int(x) for x in unpack(np.int64(place)))
        start = np.arange(last - first + 1)
        prints = Fingerprints(np.frombuffer(around, np.uint8))
        return [(prints.of(start, start + length).view(np.int64), prints.of(start, start + length, 1).view(np.int64),
                 np.full(len(start), t0), np.full(len(start), t1), first + start)]

    each = arrow_rows(kinds.select("t0", "t1", "place", "around"), lambda: one, schema)
    twice = each.groupBy("w0", "w1").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return each.join(twice, ["w0", "w1"], "left_semi").select("t0", "t1", "first", F.col("first").alias("last"))


def with_text_key(docs: DataFrame) -> DataFrame:
    """Adds t0 and t1, together a 128-bit fingerprint of the text (null as empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"t0": F.xxhash64(text), "t1": F.xxhash64(F.lit(1), text, F.octet_length(text))})


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES,
                   max_kinds: int = 20_000) -> DataFrame:
    """t0, t1, spans: for every text with repeats, ranges of window starts (structs first, last) that occur elsewhere.

    ``max_kinds``: surroundings of one suffix that a task compares at once; more are compared window by window.
    """
    spark = docs.sparkSession
    texts = with_text_key(docs.select("text")).filter(F.octet_length("text") >= length).select("t0", "t1", "text")
    entries = written(suffix_entries(texts, length, gram), "suffix-entries")
    keys = matched_keys(entries, batches)
    near = written(entries.join(keys, "k", "left_semi"), "suffix-near")
    discard(entries)
    release(spark)
    # Surroundings that occur twice repeat with all their windows.
    same = written(near.groupBy("k", "c").agg(F.count("*").alias("n"), F.min(F.struct("t0", "t1", "place")).alias("e")),
                   "suffix-kinds")
    whole = near.join(same.filter("n > 1").select("k", "c"), ["k", "c"], "left_semi").select("t0", "t1", "place")
    # Suffixes with several kinds of surroundings, of which at least one is alone: one of each kind is fetched.
    many = same.groupBy("k").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    reps = same.join(many.select("k", "kinds"), "k").select("k", "kinds", "e.*")
    by_text = reps.groupBy("t0", "t1").agg(F.collect_list(F.struct("k", "kinds", "place")).alias("es"))
    schema = T.StructType.fromDDL("k long, kinds long, t0 long, t1 long, place long, around binary")

    def fetch(t0, t1, text, es):
        data, out = utf8(text), []
        for e in es:
            _, first, last = (int(x) for x in unpack(np.int64(e["place"])))
            out.append(([e["k"]], [e["kinds"]], [t0], [t1], [e["place"]],
                        np.array([data[first: last + length]], dtype=object)))
        return out

    # Equal texts are fetched once for each copy; one row of each kind is left.
    fetched = arrow_rows(texts.join(by_text, ["t0", "t1"]).select("t0", "t1", "text", "es"), lambda: fetch, schema)
    around = written(fetched.dropDuplicates(["k", "t0", "t1", "place"]), "suffix-around")
    release(spark)
    few = around.filter(F.col("kinds") <= max_kinds)
    parts = shuffle_parts(spark)
    windows = compare_kinds(few.repartition(parts, "k").sortWithinPartitions("k"), length).unionByName(
        compare_windows(around.filter(F.col("kinds") > max_kinds), length))
    at = F.shiftright("place", 2 * _REACH)
    low = F.lit((1 << _REACH) - 1)
    ranges = whole.select("t0", "t1", (at - F.shiftright("place", _REACH).bitwiseAND(low)).alias("first"),
                          (at - F.col("place").bitwiseAND(low)).alias("last")).unionByName(windows)
    # Copies of a text bring equal ranges, which are combined before the shuffle.
    spans = ranges.distinct().groupBy("t0", "t1").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    out = written(spans, "suffix-spans")
    release(spark)
    return out


def removed_runs(spans: list | None, length: int) -> list[tuple]:
    """Maximal runs of bytes covered by the windows, as (first byte, byte after the last)."""
    out: list[tuple] = []
    for first, end in sorted((s["first"], s["last"] + length) for s in spans or ()):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def kept_bytes(data: bytes, runs: list[tuple]) -> bytes:
    parts, at = [], 0
    for first, end in runs:
        parts.append(data[at: first])
        at = end
    return b"".join(parts) + data[at:]


def _dedup(rows: DataFrame, length: int, **options) -> DataFrame:
    """``rows`` (__row, text): __row with the figures and the bytes that stay."""
    spans = repeated_spans(rows, length, **options)
    rows = with_text_key(rows).join(spans, ["t0", "t1"], "left").select("__row", "text", "spans")

    def one(row, text, found):
        data = utf8(text)
        runs = removed_runs(found, length)
        left = kept_bytes(data, runs)
        return (row, len(data), len(data) - len(left), len(runs), sha(left), left)

    return map_rows(rows, one, schema_of(rows, ["__row"], (
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")))


def dedup(docs: DataFrame, keep: list[str], length: int = LENGTH, **options) -> DataFrame:
    """Columns ``keep`` of every row with n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the bytes that stay."""
    out = _dedup(docs.select(F.struct(*keep).alias("__row"), "text"), length, **options)
    return out.select("__row.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def clean_documents(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """Documents with the repeated bytes gone; those with no word left go altogether.

    A character that is cut by a run's end goes as a whole. Same columns as ``docs``.
    """
    out = _dedup(docs.select(F.struct(*docs.columns).dropFields("text").alias("__row"), "text"), length, **options)
    valid = F.try_validate_utf8(F.col("kept").cast("string"))
    text = F.coalesce(valid, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\uFFFD", ""))
    out = out.withColumn("text", text).filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    cols = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select([cols[c].alias(c) if c in cols else F.col("__row").getField(c).alias(c) for c in docs.columns])
