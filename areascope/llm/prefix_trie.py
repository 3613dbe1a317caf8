"""Prefix trie of conversations by splitter and skeleton.

A conversation becomes a path: for each turn the fingerprint of its role and
text and the text's length. Paths are dealt to shards by range of (path,
conv_id) and sorted in each shard, so the members of a node lie side by side,
and copies of one conversation, however many, are dealt to as many shards as
they fill. The first path of a shard is its splitter. Only a node whose path
begins a splitter *and* the path before it has members in several shards;
these nodes are the skeleton. Every shard is told how deep its skeleton goes
at either end (the trie of the splitters as depths: two numbers a shard,
broadcast), walks its paths with a stack and finishes all other nodes. For
skeleton nodes it hands out partial aggregates: members, children and leaves
of its own, tokens saved below, and the ids that end there, in order. The
partials are reduced by node, and what skeleton nodes add to the skeleton
nodes above them is summed along the skeleton in path order.

Defined results: null role or text is empty; turns come by number, null first,
equal numbers by the fingerprint of role and text, repeated rows are turns of
their own; rows without a conversation id belong to no conversation; a
conversation without turns is a member of the root; an empty table has no
nodes, not even a root. Texts of any length are only fingerprinted and
measured (128 bits; never shuffled); other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import cut_lineage, ship_package, shuffle_parts, small_enough, written

#: Bytes of a turn in a path: 16 of the fingerprint, 4 of the text's length in code points.
UNIT = 20
#: Ids handed out in one row, and output rows and bytes of ids of one Arrow batch.
_IDS, _ROWS, _BYTES = 1 << 16, 4096, 1 << 22
#: Skeleton nodes that are broadcast to their children; more are joined by a shuffle.
MAX_BROADCAST_NODES = 200_000


def turn_unit(role: Column, text: Column) -> Column:
    """The 20 bytes of a turn; the role's length comes first, so that no two different turns read alike."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    told = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(F.md5(told.cast("binary")), F.lpad(F.hex(F.char_length(text)), 8, "0")))


def conversation_turns(turns: DataFrame) -> DataFrame:
    """conv_id, units (the turns in order) of each conversation."""
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_unit(F.col("role"), F.col("text")).alias("unit"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "unit")))  # null turns first
    return rows.groupBy("conv_id").agg(ordered.alias("units")).withColumn("units", F.col("units.unit"))


def rebuilt(conversations: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """conv_id, units of each conversation after its head was taken from the first conversation of its family.

    The first h turns come from conversation c - c % ``family`` (none if there is none), the others are its own after
    the first h; h is crc32 of the id's digits modulo ``most``.
    """
    heads = conversations.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("head_id"), F.slice("units", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = F.when(F.size("units") > h, F.slice(F.col("units"), h + 1, F.greatest(F.size("units") - h, F.lit(0))))
    none = F.array().cast("array<binary>")
    return conversations.join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("head_id"), "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("head", none), 1, h), F.coalesce(own, none)).alias("units"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at the beginning."""
    low, high = 0, min(len(a), len(b)) // UNIT
    if a[:high * UNIT] == b[:high * UNIT]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle * UNIT] == b[:middle * UNIT]:
            low = middle
        else:
            high = middle
    return low


def _batches(rows: Iterator[tuple], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    found, weight = [], 0
    for row in rows:
        found.append(row)
        weight += len(row[-1] or b"")
        if len(found) >= _ROWS or weight > _BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)
            found, weight = [], 0
    columns = list(zip(*found)) if found else [()] * len(arrow)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _ends(paths: DataFrame) -> DataFrame:
    """shard, first, last path of every shard that has rows."""
    arrow = to_arrow_schema(T.StructType.fromDDL("shard int, first binary, last binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = batch.column(0)[0].as_py() if first is None else first
                last = batch.column(0)[batch.num_rows - 1].as_py()
        rows = [] if first is None else [(TaskContext.get().partitionId(), first, last)]
        yield from _batches(iter(rows), arrow)

    return paths.select("path").mapInArrow(run, "shard int, first binary, last binary")


def skeleton_depths(paths: DataFrame) -> dict[int, tuple]:
    """shard -> (depth of the skeleton on its first path, on its last path); -1: no shard with rows on that side.

    The ends of the shards meet in one table of a row for each shard; two numbers a shard reach the driver.
    """
    ends = _ends(paths).withColumn("before", F.lag("last").over(Window.orderBy("shard")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, _common(f, b)) for s, f, b in zip(*(c.to_pylist() for c in batch.columns)) if b is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                              pa.array([r[1] for r in rows], pa.int32())], names=["shard", "depth"])

    shards = sorted(r[0] for r in ends.select("shard").collect())
    shared = dict(tuple(r) for r in ends.select("shard", "first", "before").mapInArrow(run, "shard int, depth int").collect())
    after = {left: shared[right] for left, right in zip(shards, shards[1:])}
    return {s: (shared.get(s, -1), after.get(s, -1)) for s in shards}


#: Rows of the walk. ``parent`` is null where parent_conv_id is known or the node is the root; partial aggregates of a
#: skeleton node come with the ids that end in it, in blobs by ``seq``.
_WALK = ("part boolean, shard int, key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, own_length long, ends_sha256 string, seq long, blob binary")
_ROOT = b"\0" * 16


def _key(parent: bytes, unit: bytes) -> bytes:
    """Fingerprint of a node's path, from its parent's and its last turn."""
    return hashlib.sha256(parent + unit).digest()[:16]


class _Node:
    """An open node of a walk; ``first`` if the shard before has members of it."""

    __slots__ = ("key", "length", "first", "n_convs", "conv_id", "n_children", "n_leaves", "saved", "ends", "waiting")

    def __init__(self, key: bytes, unit: bytes, first: bool):
        self.key, self.length, self.first = key, int.from_bytes(unit[16:], "big"), first
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.conv_id = None
        self.ends = array("q")
        self.waiting: list[tuple] = []  # finished children that wait for this node's conv_id

    def joined_ends(self) -> Iterator[bytes]:
        for start in range(0, len(self.ends), _IDS):
            yield ("," if start else "").encode() + ",".join(map(str, self.ends[start:start + _IDS])).encode()

    def take_member(self, conv_id: int, members: int = 1) -> None:
        self.n_convs += members
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)


def _walk(found: Iterator[tuple], shard: int, left: int, right: int) -> Iterator[tuple]:
    """The rows of ``_WALK`` from one shard's (path, conv_id) in order; memory grows with the shard's open nodes.

    The skeleton is what the first path has in common with the shard before (``left`` deep) and the last path with the
    shard after (``right`` deep).
    """
    stack: list[_Node] = []
    before = None

    def close(skeleton: bool) -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        up = stack[-1] if stack else None
        if not skeleton:
            node.n_leaves = node.n_leaves if node.n_children else 1
            node.saved += (node.n_convs - 1) * node.length
        if up is not None:
            up.take_member(node.conv_id, node.n_convs)
            up.n_leaves += node.n_leaves
            up.saved += node.saved
            up.n_children += not skeleton
        sums = (node.n_convs, node.n_children, node.n_leaves, node.saved, node.length)
        if skeleton:
            yield from ((*row[:3], node.key, *row[4:]) for row in node.waiting)
            parent = up.key if up is not None else None
            yield (True, shard, node.key, parent, depth, node.conv_id, None, *sums, None, None, None)
            for seq, blob in enumerate(node.joined_ends()):
                yield (True, shard, node.key, parent, depth, None, None, 0, 0, 0, 0, node.length, None, seq, blob)
            return
        yield from ((*row[:6], node.conv_id, *row[7:]) for row in node.waiting)
        told = hashlib.sha256()
        for blob in node.joined_ends():
            told.update(blob)
        row = (False, shard, None, None, depth, node.conv_id, None, *sums, told.hexdigest(), None, None)
        if up is None:
            yield row
        elif up.first or (len(stack) == 1 and right >= 0):  # known to be in the skeleton
            yield (*row[:3], up.key, *row[4:])
        else:
            up.waiting.append(row)

    for path, conv_id in found:
        depth, keep = len(path) // UNIT, 0 if before is None else _common(before, path)
        while len(stack) > keep + 1:
            yield from close(stack[-1].first)
        while len(stack) <= depth:
            at = len(stack)
            unit = path[(at - 1) * UNIT:at * UNIT] if at else b""
            stack.append(_Node(_key(stack[-1].key, unit) if at else _ROOT, unit, before is None and at <= left))
        stack[-1].ends.append(conv_id)
        stack[-1].take_member(conv_id)
        before = path
    while stack:
        yield from close(stack[-1].first or len(stack) - 1 <= right)


def walk(paths: DataFrame, depths: dict[int, tuple]) -> DataFrame:
    """Walks every shard of ``paths``; ``depths`` are two numbers for each."""
    ship_package(paths.sparkSession)
    arrow = to_arrow_schema(T.StructType.fromDDL(_WALK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        found = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield from _batches(_walk(found, shard, *depths.get(shard, (-1, -1))), arrow)

    return paths.select("path", "conv_id").mapInArrow(run, _WALK)


def _sums_below(nodes: DataFrame) -> DataFrame:
    """key, n_leaves, saved_tokens of skeleton nodes (key, parent, n_leaves, saved_tokens) summed over all nodes below and itself.

    Each round doubles how far sums have come: a node adds what the nodes as far below it as rounds have reached hold.
    """
    now = cut_lineage(nodes.select("key", F.col("parent").alias("up"), "n_leaves", "saved_tokens"))
    while now.filter("up is not null").limit(1).count():
        more = now.filter("up is not null").groupBy("up").agg(
            F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("up", "key")
        above = now.select(F.col("key").alias("up"), F.col("up").alias("further"))
        zero = F.lit(0).cast("long")
        now = cut_lineage(now.join(more, "key", "left").join(above, "up", "left").select(
            "key", F.col("further").alias("up"), (F.col("n_leaves") + F.coalesce("leaves", zero)).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("saved", zero)).alias("saved_tokens")))
    return now.drop("up")


def _ends_of_skeleton(parts: DataFrame) -> DataFrame:
    """key, ends_sha256 of the skeleton nodes in which conversations end; each node's ids stream by in shard order."""
    arrow = to_arrow_schema(T.StructType.fromDDL("key binary, ends_sha256 string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            key = sha = shard = None
            for batch in batches:
                for k, s, blob in zip(*(c.to_pylist() for c in batch.columns)):
                    if k != key:
                        if key is not None:
                            yield key, sha.hexdigest()
                        key, sha = k, hashlib.sha256()
                    elif s != shard:
                        sha.update(b",")
                    shard = s
                    sha.update(blob)
            if key is not None:
                yield key, sha.hexdigest()
        yield from _batches(((*row,) for row in told()), arrow)

    rows = parts.filter("blob is not null").repartition("key").sortWithinPartitions("key", "shard", "seq")
    return rows.select("key", "shard", "blob").mapInArrow(run, "key binary, ends_sha256 string")


def _reduced(parts: DataFrame) -> DataFrame:
    """The skeleton's nodes, whole, from the partial aggregates of the shards."""
    sums = cut_lineage(parts.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.first("own_length").alias("own_length")))
    inner = sums.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("more")).withColumnRenamed("parent", "key")
    none, zero = F.lit(hashlib.sha256().hexdigest()), F.lit(0).cast("long")
    nodes = cut_lineage(sums.join(inner, "key", "left").join(_ends_of_skeleton(parts), "key", "left").withColumns({
        "n_children": F.col("n_children") + F.coalesce("more", zero), "ends_sha256": F.coalesce("ends_sha256", none)}))
    own = nodes.select("key", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("own_length")).alias("saved_tokens"))
    below = _sums_below(own).select("key", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    return cut_lineage(nodes.join(below, "key").withColumns({
        "n_leaves": F.col("n_leaves") + F.col("leaves"), "saved_tokens": F.col("saved_tokens") + F.col("saved")}))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes (``COLUMNS``) of the trie of ``conversations`` (conv_id, units), which have one row for each id.

    Paths are shuffled once, by range; ``shards`` is the number of ranges.
    """
    spark = conversations.sparkSession
    rows = written(conversations.select(F.unhex(F.array_join(F.transform("units", F.hex), "")).alias("path"), "conv_id"), "paths")
    paths = cut_lineage(rows.repartitionByRange(shards or shuffle_parts(spark), "path", "conv_id")
                        .sortWithinPartitions("path", "conv_id"))
    done = written(walk(paths, skeleton_depths(paths)), "walk")
    skeleton = _reduced(done.filter("part"))
    ids = skeleton.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    ids = F.broadcast(ids) if small_enough(ids, MAX_BROADCAST_NODES) else ids
    waiting = done.filter("not part and parent is not null").drop("parent_conv_id").unionByName(
        skeleton.filter("parent is not null"), allowMissingColumns=True)
    below = waiting.join(ids, "parent").withColumn("parent_conv_id", F.col("above"))
    rest = done.filter("not part and parent is null").select(*COLUMNS).unionByName(
        skeleton.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*COLUMNS))
    return below.select(*COLUMNS).unionByName(rest)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text) after its conversations were rebuilt."""
    return trie(rebuilt(conversation_turns(turns)))
