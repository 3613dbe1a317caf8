"""Set similarity join on word shingles with grouped prefixes.

A document is the set of its distinct five-word shingles. Two sets of Jaccard
similarity ``t`` or more must share a shingle among the first
``n - ceil(t n) + 1`` of each (its prefix), in any order that all sets keep;
here frequent shingles come last, so that passages which many documents share
are in few prefixes. Documents with an equal prefix and size form one group;
groups meet by prefix shingle, pairs pass the size, position and count filters
(similar sets share many prefix shingles, and early ones), and what is left is
expanded to member sets and verified on the whole texts.

Components need no more links than span them. A first round therefore verifies
one partner of each group, the member of its buckets whose shingles are most
common (the centre of a family of near copies). For the second round, a set is
first counted against its buckets as a whole: only if it shares enough prefix
shingles with sets of other components and of a size that can be similar does
it meet them. Of the pairs that pass the filters, those are verified whose ends
are not connected yet, so no link between different components is lost, and no
family is paired out.

Exactness: shingles and sets are known by 64-bit fingerprints; among 10^10
sets a handful may collide. Frequencies only order the shingles: a shingle
that is frequent in no stretch of a task is treated as rare, which costs time
and loses nothing.

Defined results: null and wordless texts have an empty set and link with
nothing, their component is their own id; texts of fewer than five words are
one shingle; repeated rows are in one component; ids that are null never
become a component's id unless all are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import byte_array, discard, mix64, release, schema_of, ship_package, small_enough, written
from .components import components
from .suffix_dedup import Fingerprints, arrow_rows

WORDS = 5
#: Similarity as a whole percentage: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles counted together in a task, the least count there that is told, and the largest table of frequent ones.
STRETCH, TOLD, FREQUENT = 1 << 20, 4, 1 << 20
#: Groups in a bucket from which its shingle counts as frequent.
LARGE = 16
#: Buckets of each group that are asked for a centre in the first round.
VOTES = 8
#: Of these, how many must name the same centre.
AGREED = 3
#: Rounds after the first in which sets that can still meet another component ask one partner.
ROUNDS = 1
#: Bands of set sizes for a factor e.
BANDS = 40
#: Keys of wanted texts that may be broadcast (8 bytes each); beyond, they are joined by shuffle.
WANTED = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x2545F4914F6CDD1D)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct fingerprints of the word shingles of a text, A-Z lower-cased."""
    data = _LOWER[byte_array(text)]
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    w = np.empty(len(start), np.uint64)
    # Long texts are fingerprinted piece by piece, cut between words.
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + (1 << 20))))
        prints = Fingerprints(data[start[at]: end[stop - 1]], both=False)
        w[at:stop] = prints.of(start[at:stop] - start[at], end[at:stop] - start[at])
        at = stop
    width = min(words, len(w))
    h = np.full(len(w) - width + 1, np.uint64(width))
    with np.errstate(over="ignore"):
        for j in range(width):
            h = h * _STEP + w[j: len(w) - width + 1 + j]
    return np.unique(mix64(h))


def set_id(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.sum(mix64(tokens ^ _STEP), dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def need(n: int, percent: int) -> int:
    """ceil(percent * n / 100)"""
    return -(-percent * n // 100)


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens and the classes (floor of the binary logarithm of their count) of the most frequent ones.

    Every task counts all its shingles, a stretch at a time, and tells those that it meets ``TOLD`` times; the sums
    are taken by a shuffle. At most ``FREQUENT`` tokens reach the driver: the threshold is the number of all
    shingles over that bound, if it is higher than the least count.
    """
    ship_package(docs.sparkSession)
    schema = T.StructType.fromDDL("token long, n long, total long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def tell() -> pa.RecordBatch:
            tokens, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= TOLD
            t, c = tokens[often].view(np.int64), count[often]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(t, 0)), pa.array(np.append(c, 0)),
                 pa.array(np.append(np.zeros(len(t), np.int64), size))], schema=arrow)

        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(text.as_py(), words))
                size += len(held[-1])
                if size > STRETCH:
                    yield tell()
                    held, size = [], 0
        if size:
            yield tell()

    told = docs.select("text").mapInArrow(run, schema).groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))
    told = written(told, "shingle-counts")
    total = told.agg(F.sum("total")).first()[0] or 0
    rows = told.filter(F.col("n") >= max(2 * TOLD, total // FREQUENT + 1)).select("token", "n").toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.log2(np.maximum(rows["n"].to_numpy(np.float64), 1)).astype(np.uint8)[order]


def _ordered(tokens: np.ndarray, often: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Tokens in the common order: rare ones by value, then frequent ones by class and value."""
    if not len(often) or not len(tokens):
        return tokens
    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
    rank = np.where(often[at] == tokens, classes[at] + 1, 0)
    return tokens[np.lexsort((tokens, rank))]


def prefix_rows(docs: DataFrame, words: int, percent: int, often: np.ndarray, classes: np.ndarray) -> DataFrame:
    """Two kinds of rows: documents (kind 0: doc_id, t0, gid, sid, n) and prefix shingles (kind 1: token, gid, n, pos).

    The prefix shingles of a group are told once in a task.
    """
    spark = docs.sparkSession
    ship_package(spark)
    table = spark.sparkContext.broadcast((often, classes))  # at most FREQUENT entries of 9 bytes
    schema = schema_of(docs, ["doc_id"], "t0 long, gid long, sid long, n int, token long, pos int, kind int")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set = set()
        often, classes = table.value
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                batch = whole.slice(s, 500)
                gid, sid, size, tokens, owner, place = [], [], [], [], [], []
                for text in batch.column(2).to_pylist():
                    t = _ordered(shingles(text, words), often, classes)
                    n = len(t)
                    prefix = t[: n - need(n, percent) + 1] if n else t
                    g = set_id(np.append(prefix, np.uint64(n)))
                    gid.append(g)
                    sid.append(set_id(t))
                    size.append(n)
                    if n and g not in told:
                        if len(told) > 200_000:  # a bound on the task's memory; what is told twice is merged later
                            told.clear()
                        told.add(g)
                        tokens.append(prefix.view(np.int64))
                        owner.append(np.full(len(prefix), len(gid) - 1))
                        place.append(np.arange(len(prefix), dtype=np.int32))
                k = batch.num_rows
                gid, size = np.array(gid, np.int64), np.array(size, np.int32)
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(arrow.field(0).type), batch.column(1), pa.array(gid), pa.array(sid, pa.int64()),
                     pa.array(size), none, none.cast(pa.int32()), pa.array(np.zeros(k, np.int32))], schema=arrow)
                if tokens:
                    tokens, owner = np.concatenate(tokens), np.concatenate(owner)
                    k = len(tokens)
                    none = pa.nulls(k, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(k, arrow.field(0).type), none, pa.array(gid[owner]), none, pa.array(size[owner]),
                         pa.array(tokens), pa.array(np.concatenate(place)), pa.array(np.ones(k, np.int32))], schema=arrow)

    return docs.select("doc_id", F.xxhash64("text").alias("t0"), "text").mapInArrow(run, schema)


def _buckets(docs: DataFrame, words: int, percent: int, often: np.ndarray, classes: np.ndarray) -> tuple:
    """Documents (doc_id, t0, gid, sid, n) and the prefix shingles of two groups or more (token, gid, n, pos, size)."""
    told = written(prefix_rows(docs, words, percent, often, classes), "prefixes")
    rows = written(told.filter("kind = 0").select("doc_id", "t0", "gid", "sid", "n"), "sets-of-documents")
    by_token = Window.partitionBy("token")
    shared = written(
        told.filter("kind = 1").select("token", "gid", "n", "pos")
        .withColumns({"low": F.min("gid").over(by_token), "high": F.max("gid").over(by_token)})
        .filter("low != high").drop("low", "high").dropDuplicates(["token", "gid"])
        .withColumn("size", F.count("*").over(by_token)).select("token", "gid", "n", "pos", "size"), "shared-prefixes")
    discard(told)
    del told
    release(docs.sparkSession)
    return rows, shared


def _demoted(shared: DataFrame, often: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table of frequent shingles with those of large buckets; at most ``FREQUENT`` more."""
    limit = max(LARGE, shared.count() // FREQUENT + 1)
    rows = shared.filter(F.col("size") >= limit).groupBy("token").agg(F.max("size").alias("n")).toPandas()
    tokens = np.concatenate([often, rows["token"].to_numpy(np.int64).view(np.uint64)])
    ranks = np.concatenate([classes, np.log2(rows["n"].to_numpy(np.float64)).astype(np.uint8)])
    order = np.lexsort((-ranks.astype(np.int64), tokens))
    tokens, ranks = tokens[order], ranks[order]
    first = np.concatenate(([True], tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, bool)
    return tokens[first], ranks[first]


def verify(pairs: DataFrame, sets: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that are similar, from the whole texts. ``sets``: sid, t0 of one text of each set.

    Texts travel to ``b`` once for each pair, so ``b`` should be the side that many pairs share.
    """
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(sets, "sid"), "wanted-sets")
    keys = wanted.select("t0").distinct()
    keys = F.broadcast(keys) if small_enough(keys, WANTED) else keys
    found = texts.join(keys, "t0", "left_semi").dropDuplicates(["t0"])
    have = written(wanted.join(found, "t0").select("sid", "text"), "wanted-texts")
    del found, keys
    release(pairs.sparkSession)
    left = pairs.join(have.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(have.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b")
    schema = T.StructType.fromDDL("a long, b long")

    def task():
        last: dict = {}  # rows come in the order of b, whose set is kept

        def one(a, b, text_a, text_b):
            if last.get("id") != b:
                last["id"], last["set"] = b, shingles(text_b, words)
            x, y = shingles(text_a, words), last["set"]
            common = len(np.intersect1d(x, y, assume_unique=True))
            return [([a], [b])] if 100 * common >= percent * (len(x) + len(y) - common) else []
        return one

    links = written(arrow_rows(both.select("a", "b", "text_a", "text_b"), task, schema), "links")
    discard(have)
    del both, left
    release(pairs.sparkSession)
    return links


def _in_both(n: Column, m: Column, percent: int) -> Column:
    """The least number of common shingles that similar sets of n and m shingles have in both their prefixes.

    The common ones come in one order in both, so those outside a prefix are outside that of the larger set at most.
    """
    overlap = F.ceil((n + m) * percent / (100 + percent))
    return overlap - F.ceil(F.greatest(n, m) * percent / 100) + 1


def _promising(open_: DataFrame, percent: int) -> DataFrame:
    """The rows of ``open_`` (token, gid, n, pos, sid, root) that can belong to a similar pair, with ``band`` and ``want``.

    A set that is similar to one of another component, of a certain size, shares that many prefix shingles with it; so
    it must share that many with the sets of about that size and other components taken together. This counts against
    the buckets, not against their members: a far copy of a large family, most of whose rare shingles nobody shares,
    goes before it meets the family. Sizes are taken in bands of 2.5 %; ``want`` is a band in which a set may find a
    partner, ``band`` its own, ``size`` the sets of that band in the bucket, ``probes`` see ``_candidates``. Rows of whole
    groups (pos -1) stay as they are.
    """
    groups = open_.filter("pos < 0").withColumns({"band": F.lit(-1), "want": F.lit(-1)})
    rows = open_.filter("pos >= 0").withColumn("band", F.floor(F.log(F.col("n").cast("double")) * BANDS).cast("int"))
    held = (rows.groupBy("token", "band").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                              F.count("*").alias("size")).withColumnRenamed("band", "want"))
    n = F.col("n").cast("double")
    # The sizes of a band, a little wider; between them the bound first rises, then falls.
    least = F.greatest(F.floor(F.exp(F.col("want") / BANDS)) - 1, F.floor(n * percent / 100), F.lit(1))
    most = F.least(F.ceil(F.exp((F.col("want") + 1) / BANDS)) + 1, F.ceil(n * 100 / percent))
    bound = F.greatest(F.least(_in_both(n, least, percent), _in_both(n, most, percent)), F.lit(1))
    hits = written(rows.join(held, "token")
                   .filter((least <= most) & ((F.col("low") != F.col("root")) | (F.col("high") != F.col("root"))))
                   .select("token", "gid", "n", "pos", "sid", "root", "band", "want", "size", bound.alias("bound")), "bucket-hits")
    wants = (hits.groupBy("sid", "want").agg((F.count("*") - F.first("bound") + 1).cast("int").alias("probes"))
             .filter("probes >= 1"))
    kept = hits.drop("bound").join(wants, ["sid", "want"])
    columns = ["token", "gid", "n", "pos", "sid", "root", "band", "want", "size", "probes"]
    groups = groups.withColumns({"size": F.lit(0).cast("long"), "probes": F.lit(0)})
    return written(kept.select(*columns).unionByName(groups.select(*columns)), "promising")


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of promising sets that share enough prefix shingles, and those of one group.

    Of c shingles that a set has in buckets with others, a partner shares ``bound`` at least, so it is met through any
    c - bound + 1 of them: a set probes with its ``probes`` least crowded ones, the one of a pair that has fewer probes
    meets the other. What is met is counted over all shared prefix shingles of the two.
    """
    single = rows.filter("pos >= 0")
    turn = F.row_number().over(Window.partitionBy("sid", "want").orderBy("size", "token"))
    x = single.withColumn("turn", turn).filter("turn <= probes").alias("x")
    y = single.alias("y")
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    first = ((F.col("x.probes") < F.col("y.probes"))
             | ((F.col("x.probes") == F.col("y.probes")) & (F.col("x.sid") < F.col("y.sid"))))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.want") == F.col("y.band"))
                 & (F.col("x.band") == F.col("y.want")) & first & (F.col("x.root") != F.col("y.root"))
                 & (small * 100 >= large * percent))
    pairs = written(met.select(F.col("x.sid").alias("x"), F.col("x.want").alias("x_want"), F.col("x.n").alias("x_n"),
                               F.col("y.sid").alias("y"), F.col("y.want").alias("y_want"), F.col("y.n").alias("y_n"))
                    .distinct(), "met-pairs")
    met_ids = pairs.select(F.explode(F.array("x", "y")).alias("sid")).distinct()
    tokens = written(single.join(met_ids, "sid", "left_semi").groupBy("sid", "want").agg(F.collect_list("token").alias("tokens")), "tokens-of-sets")
    of = [tokens.select(F.col("sid").alias(c), F.col("want").alias(f"{c}_want"), F.col("tokens").alias(f"{c}_tokens"))
          for c in ("x", "y")]
    enough = F.size(F.array_intersect("x_tokens", "y_tokens")) >= _in_both(F.col("x_n"), F.col("y_n"), percent)
    counted = pairs.join(of[0], ["x", "x_want"]).join(of[1], ["y", "y_want"]).filter(enough).select("x", "y")
    u, v = rows.filter("pos < 0").alias("u"), rows.filter("pos < 0").alias("v")
    one_group = u.join(v, (F.col("u.token") == F.col("v.token")) & (F.col("u.sid") < F.col("v.sid"))
                       & (F.col("u.root") != F.col("v.root"))).select(F.col("u.sid").alias("x"), F.col("v.sid").alias("y"))
    return counted.unionByName(one_group).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _nominated(rows: DataFrame, weights: DataFrame, percent: int) -> DataFrame:
    """At most one pair (a, b) for each promising set: it and the set that most of its buckets name.

    A bucket names the member with the most common shingles, to its own component the best of the others.
    """
    rows = rows.filter("pos >= 0").join(weights, "gid")
    told = F.struct("weight", "sid", "root", "n")
    of_root = rows.groupBy("token", "band", "root").agg(F.max(told).alias("c"))
    best = of_root.groupBy("token", "band").agg(F.max("c").alias("c1"))
    second = (of_root.join(best, ["token", "band"]).filter(F.col("root") != F.col("c1.root"))
              .groupBy("token", "band").agg(F.max("c").alias("c2")))
    named = best.join(second, ["token", "band"], "left").withColumnRenamed("band", "want")
    to = F.when(F.col("c1.root") != F.col("root"), F.col("c1")).otherwise(F.col("c2"))
    votes = (rows.join(named, ["token", "want"]).withColumn("to", to)
             .filter((F.col("to.weight") > F.col("weight"))
                     & (F.least("n", "to.n") * 100 >= F.greatest("n", "to.n") * percent))
             .groupBy("sid", F.col("to.sid").alias("other")).agg(F.count("*").alias("count")))
    chosen = votes.groupBy("sid").agg(F.max(F.struct("count", "other")).alias("v")).select("sid", F.col("v.other").alias("other"))
    return chosen.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()


def _placed(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, t0 (hash of the text), n and root, the component's set or null without words, for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    texts = docs.select(F.xxhash64("text").alias("t0"), "text")
    often, classes = frequent_shingles(docs, words)
    rows, shared = _buckets(docs, words, percent, often, classes)
    # Buckets now tell exactly how common their shingles are. Those of large buckets go to the end of the order too,
    # and the prefixes are drawn anew: pairs of a bucket grow with the square of its size.
    often, classes = _demoted(shared, often, classes)
    discard(rows)
    discard(shared)
    rows, shared = _buckets(docs, words, percent, often, classes)
    members = written(rows.filter("n > 0").groupBy("sid", "gid", "n").agg(F.min("t0").alias("t0")), "members")
    sets = members.select("sid", "t0")

    # First round: each group asks a few of its buckets, drawn by hash, for the group whose shingles are most common.
    # A good share of them must name the same group, of a size that can be similar; the others wait for the second round.
    by_group = Window.partitionBy("gid")
    asked = (shared.withColumns({
        "weight": F.sum(F.log2(F.col("size"))).over(by_group) / F.col("n"),
        "turn": F.row_number().over(by_group.orderBy("token"))})
        .filter(F.col("turn") <= VOTES).select("token", "gid", "n", "weight"))
    asked = written(asked, "votes")
    release(spark)
    centre = asked.groupBy("token").agg(F.max(F.struct("weight", "gid", "n")).alias("c")).select("token", "c")
    votes = (asked.join(centre, "token").groupBy("gid", F.col("c.gid").alias("to"))
             .agg(F.count("*").alias("count"), F.max("n").alias("n"), F.max("c.n").alias("to_n"))
             .filter((F.col("gid") != F.col("to")) & (F.col("count") >= AGREED)
                     & (F.least("n", "to_n") * 100 >= F.greatest("n", "to_n") * percent))
             .groupBy("gid").agg(F.max(F.struct("count", "to")).alias("v")).select("gid", F.col("v.to").alias("to")))
    first_of = members.groupBy("gid").agg(F.min("sid").alias("sid"), F.count("*").alias("k"))
    own = first_of.select("gid", F.col("sid").alias("first"))
    pairs = (votes.join(own.withColumnRenamed("first", "a"), "gid")
             .join(own.select(F.col("gid").alias("to"), F.col("first").alias("b")), "to").select("a", "b"))
    # Members of one group stand for themselves to its first member.
    inside = members.join(own, "gid").filter("sid != first").select(F.col("sid").alias("a"), F.col("first").alias("b"))
    pairs = written(pairs.unionByName(inside).distinct(), "first-pairs")
    links = verify(pairs, sets, texts, words, percent)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    release(spark)

    # Further rounds of this kind, for the sets that can still meet another component: each asks the set whose shingles
    # are most common among those of other components in its buckets. What can be linked to a family mostly is by then.
    weights = written(asked.select("gid", "weight").distinct(), "weights")
    whole_groups = first_of.filter("k > 1").select(F.col("gid").alias("token"), "gid").join(
        members.select("gid", "n").distinct(), "gid").select("token", "gid", "n", F.lit(-1).alias("pos"))
    every_bucket = shared.select("token", "gid", "n", "pos").unionByName(whole_groups)
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for turn in range(ROUNDS + 1):
        placed = written(members.join(roots, members["sid"] == roots["u"], "left")
                         .select("gid", "sid", F.coalesce("root", "sid").alias("root")), "placed")
        if turn:  # sets that could not meet another component before cannot do so now
            bucket = open_.select("token", "gid", "n", "pos", "sid").distinct().join(placed.select("sid", "root"), "sid")
        else:
            bucket = every_bucket.join(placed, "gid")
        apart = bucket.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
        open_ = written(bucket.join(apart.select("token"), "token", "left_semi"), "open-buckets")
        open_ = _promising(open_, percent)
        release(spark)
        if turn == ROUNDS:
            break
        asked_now = written(_nominated(open_, weights, percent).join(tried, ["a", "b"], "left_anti"), "more-pairs")
        links = written(links.unionByName(verify(asked_now, sets, texts, words, percent)), "links-so-far")
        tried = tried.unionByName(asked_now)
        roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        release(spark)

    # Last round: what the filters let through between components that are still apart.
    more = _candidates(open_, percent)
    more = written(more.join(tried, ["a", "b"], "left_anti"), "second-pairs")
    links = links.unionByName(verify(more, sets, texts, words, percent))
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    release(spark)
    return rows.join(roots, rows["sid"] == roots["u"], "left").select(
        "doc_id", "t0", "n", F.when(F.col("n") > 0, F.coalesce("root", "sid")).alias("root"))


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    member = _placed(docs, words, percent).drop("t0")
    least = member.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return member.join(least, "root", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, that of its smallest id; rows without words stay, of equal ones one.

    Rows are told apart by id and text, so two documents that share an id are each judged on their own, and copies
    without an id are reduced like others.
    """
    member = _placed(docs, **options)
    # Ids that are null come last.
    first = member.filter("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t0")).alias("k"))
    chosen = (first.select(F.col("k.doc_id").alias("kept_id"), F.col("k.t0").alias("kept_t0"))
              .unionByName(member.filter("root is null").select(F.col("doc_id").alias("kept_id"), F.col("t0").alias("kept_t0")))
              .distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t0"))
    kept = rows.join(chosen, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("t0") == F.col("kept_t0")), "left_semi")
    return kept.dropDuplicates(["id", "t0"]).select("row.*")
