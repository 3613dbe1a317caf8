"""Alignment of two tokenizers' tokens, by a monoid of byte-range fragments.

Both tokenizers cut the same bytes (a space and the text). Where a token of
each ends at the same byte offset, a group ends: the tokens of both since the
last such offset. A chunk is a byte range of a document, cut at any character;
a token belongs to the chunk in which it ends. What a chunk knows is a
fragment: the tokens up to its first common end (open prefix, their group may
have begun before), the groups between common ends (closed), and the tokens
after its last common end (open suffix). Two neighbouring fragments compose
into one: the suffix of the left and the prefix of the right make one group,
or stay open if one of them has no common end. Composition is associative and
has a neutral element, so the fragments of a very long document come from many
tasks and are reduced in a tree of small groups; a short document is one chunk.

Tokens must not depend on where a chunk begins. They don't change at a *safe
place*, a space between two characters that are no white space: there both
tokenizers start anew (the pattern of the one splits before such a space, and
no piece of the other goes on beyond one). A chunk is read with what lies
around it up to the next safe places and only keeps its own tokens; where none
is within reach, the cut itself moves to the next safe place, so no stretch is
read often.

Defined results: texts null, empty, or not given back byte by byte by both
tokenizers (such as those with U+2581, which the pieces use for a space) have
no tokens, groups ``''`` and zeros. Rows are documents of their own, repeated
or not, with null ids or not; ties for the highest count of an id are all
highest; columns asked for travel in a struct, so no name clashes; an empty
table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, flat_map_rows, ship_package, small_enough, written

#: Code points of a chunk, and how far around its ends safe places are looked for.
CHUNK, REACH = 1 << 15, 1 << 10
#: Fragments that one node of the reduction tree composes.
FAN_IN = 8
#: Id pairs that are broadcast with their counts (under 100 MB); more are joined by a shuffle.
MAX_BROADCAST_PAIRS = 1_000_000

_SAFE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_LONG = 1 << 17
_BLOCK = 1 << 12  # token pairs of a group beyond which they are counted before they are paired


# ---- tokenizers ---------------------------------------------------------------------------------------------------

def _byte_level_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable Latin-1 stands for itself, the rest follows U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class _Bytes:
    """The bytes of a vocabulary in one array."""

    def __init__(self, bytes_of: list[bytes]):
        self.sizes = np.array([len(b) for b in bytes_of], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(bytes_of), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.sizes[ids])

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes of the tokens ``ids``, which end at ``ends``."""
        sizes = self.sizes[ids]
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class ByteLevel:
    """A byte-level tokenizer of the ``tokenizers`` library, from its JSON; it is given space + text.

    With the ``pattern`` by which it splits, the tiktoken library makes the same ids at a quarter of the time, if the
    ids of the vocabulary are in the order of the merges. It is not given stretches of over ``_LONG`` code points.
    """

    def __init__(self, data: bytes, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(data.decode("utf-8"))
        self.tokenizer.encode_special_tokens = True
        alphabet = _byte_level_alphabet()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = all(c in alphabet for c in token)
            self.bytes_of[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        self.table = _Bytes(self.bytes_of)
        self.fast = None
        model = json.loads(data)["model"]
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        if pattern and all(x < y for x, y in zip([255, *merged], merged)):
            import tiktoken
            ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, spaced: str) -> list[int] | np.ndarray:
        if self.fast is not None and len(spaced) <= _LONG:
            return self.fast.encode_to_numpy(spaced, disallowed_special=())
        return self.tokenizer.encode(spaced, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model; it puts the space before the text itself."""

    def __init__(self, data: bytes):
        import sentencepiece
        self.model = model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes_of = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
                         else model.id_to_piece(i).replace("▁", " ").encode()
                         for i in range(model.get_piece_size())]
        self.table = _Bytes(self.bytes_of)

    def ids(self, spaced: str) -> list[int]:
        return self.model.encode(spaced[1:], num_threads=1)


_made: dict = {}


def _tokenizers(shared) -> tuple:
    """Both tokenizers, made once in each Python worker from the broadcast files."""
    if shared.value not in _made:
        _made.clear()
        _made[shared.value] = ByteLevel(shared.value[0], shared.value[2]), Pieces(shared.value[1])
    return _made[shared.value]


# ---- fragments ----------------------------------------------------------------------------------------------------

@dataclass
class Fragment:
    """What a byte range says about its groups; the default is the neutral element.

    ``head`` and ``tail`` hold the ids (first, second tokenizer) of the open prefix and suffix; without a common end
    (``cut`` false) all tokens are in ``head``. ``groups`` are the closed groups as text, ``pairs`` and ``links`` their
    id pairs (first << 32 | second, ascending) and how often each is linked.
    """

    head: tuple = ((), ())
    cut: bool = False
    tail: tuple = ((), ())
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    groups: list = field(default_factory=list)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    links: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    valid: bool = True


def _counted(pairs: list, links: list) -> tuple:
    """Sums the counts of equal pairs."""
    pairs, links = np.concatenate(pairs), np.concatenate(links)
    found, where = np.unique(pairs, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, where, links)
    return found, sums


def _group_text(a, b) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


class _Numbers:
    """Ids as text with what follows them, for whole arrays at a time."""

    def __init__(self):
        self.text = {end: np.zeros(0, object) for end in ",|;"}

    def of(self, ids: np.ndarray, end: str) -> np.ndarray:
        known = self.text[end]
        need = int(ids.max()) + 1 if len(ids) else 0
        if len(known) < need:
            known = self.text[end] = np.array([f"{i}{end}" for i in range(max(need, 1 << 16))], object)
        return known[ids]


_numbers = _Numbers()


def _closed_text(a: np.ndarray, many_a: np.ndarray, b: np.ndarray, many_b: np.ndarray) -> str:
    """The groups as text: ``many_a`` ids of ``a`` and ``many_b`` of ``b`` make each group."""
    out = np.empty(len(a) + len(b), object)
    stop_a, stop_b = np.cumsum(many_a), np.cumsum(many_b)
    at_a = np.arange(len(a)) + np.repeat(stop_b - many_b, many_a)  # after the second ids of the groups before
    at_b = np.arange(len(b)) + np.repeat(stop_a, many_b)  # after the first ids up to its own group
    out[at_a], out[at_b] = _numbers.of(a, ","), _numbers.of(b, ",")
    out[at_a[stop_a - 1]], out[at_b[stop_b - 1]] = _numbers.of(a[stop_a - 1], "|"), _numbers.of(b[stop_b - 1], ";")
    return "".join(out.tolist())[:-1]


def _pairs_of(a, b) -> tuple:
    """The id pairs of one group, each with its count, without writing out the repeats."""
    a, m = np.unique(np.asarray(a, np.int64), return_counts=True)
    b, n = np.unique(np.asarray(b, np.int64), return_counts=True)
    return (a[:, None] << 32 | b[None, :]).ravel(), (m[:, None] * n[None, :]).ravel()


def fragment(a: np.ndarray, end_a: np.ndarray, b: np.ndarray, end_b: np.ndarray, start: bool = False) -> Fragment:
    """The fragment of the tokens ``a`` and ``b`` with their ascending end offsets.

    ``start``: the range begins with a common end, as a document does.
    """
    a, b = a.astype(np.int64, copy=False), b.astype(np.int64, copy=False)
    ends = np.zeros(max(end_a[-1] if len(a) else 0, end_b[-1] if len(b) else 0) + 1, np.int8)
    ends[end_a] = 1
    ends[end_b] += 2
    stop_a, stop_b = np.flatnonzero(ends[end_a] == 3) + 1, np.flatnonzero(ends[end_b] == 3) + 1
    if start:
        stop_a, stop_b = np.concatenate(([0], stop_a)), np.concatenate(([0], stop_b))
    if not len(stop_a):
        return Fragment(head=(a.tolist(), b.tolist()), n_a=len(a), n_b=len(b))
    out = Fragment(head=(a[:stop_a[0]].tolist(), b[:stop_b[0]].tolist()), cut=True,
                   tail=(a[stop_a[-1]:].tolist(), b[stop_b[-1]:].tolist()), n_a=len(a), n_b=len(b), n_groups=len(stop_a) - 1)
    if len(stop_a) == 1:
        return out
    many_a, many_b = np.diff(stop_a), np.diff(stop_b)
    out.groups = [_closed_text(a[stop_a[0]:stop_a[-1]], many_a, b[stop_b[0]:stop_b[-1]], many_b)]
    large = many_a * many_b > _BLOCK
    pairs, links = [], []
    for i in np.flatnonzero(large):
        p, n = _pairs_of(a[stop_a[i]:stop_a[i + 1]], b[stop_b[i]:stop_b[i + 1]])
        pairs.append(p)
        links.append(n)
    many_a, many_b = np.where(large, 0, many_a), np.where(large, 0, many_b)
    first_a, first_b = np.repeat(stop_a[:-1], many_a), np.repeat(stop_b[:-1], many_a)
    token_a = np.arange(many_a.sum()) - np.repeat(np.cumsum(many_a) - many_a, many_a) + first_a
    width = np.repeat(many_b, many_a)  # tokens of b that each token of a meets
    token_b = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first_b, width)
    small, n = np.unique(np.repeat(a[token_a], width) << 32 | b[token_b], return_counts=True)
    out.pairs, out.links = _counted([*pairs, small], [*links, n]) if pairs else (small, n.astype(np.int64))
    return out


def compose(parts: list[Fragment]) -> Fragment:
    """The fragment of neighbouring byte ranges, from those of the ranges."""
    out, pairs, links = Fragment(), [], []
    for part in parts:
        out.valid &= part.valid
        out.n_a, out.n_b = out.n_a + part.n_a, out.n_b + part.n_b
        pairs.append(part.pairs)
        links.append(part.links)
        opened = "tail" if out.cut else "head"
        joined = tuple([*x, *y] for x, y in zip(getattr(out, opened), part.head))
        if not part.cut:
            setattr(out, opened, joined)
            continue
        if out.cut:  # the group over the border is complete
            out.groups.append(_group_text(*joined))
            out.n_groups += 1
            p, n = _pairs_of(*joined)
            pairs.append(p)
            links.append(n)
        else:
            out.head, out.cut = joined, True
        out.groups += part.groups
        out.n_groups += part.n_groups
        out.tail = part.tail
    if pairs:
        out.pairs, out.links = _counted(pairs, links)
    return out


def whole(part: Fragment) -> Fragment:
    """The fragment of a whole document; one that is not given back is empty."""
    return part if part.valid else Fragment()


def chunk_ranges(spaced: str, size: int = CHUNK, reach: int = REACH) -> Iterator[tuple]:
    """(from, to, read from, read to) of the chunks of space + text, in code points."""
    n, at, begin = len(spaced), 0, 0
    while at < n:
        to = at + size
        if to >= n:
            yield at, n, begin, n
            return
        after = _SAFE.search(spaced, to, min(n, to + reach))
        before = None
        for found in _SAFE.finditer(spaced, max(at, to - reach), to):
            before = found
        if after and before:
            yield at, to, begin, after.start()
            at, begin = to, before.start()
        else:  # no safe places around: the chunk goes on to the next one
            after = after or _SAFE.search(spaced, to)
            to = after.start() if after else n
            yield at, to, begin, to
            at = begin = to


def chunk_fragment(read: str, skip: int, take: int, first, second, start: bool = False) -> Fragment:
    """The fragment of the bytes ``skip`` to ``skip + take`` of ``read``, which begins with a space.

    ``start``: they are a document's first bytes.
    """
    data = np.frombuffer(read.encode("utf-8", "surrogatepass"), np.uint8)
    sides, valid = [], True
    for side in (first, second):
        ids = np.asarray(side.ids(read), np.int64)
        ends = side.table.ends(ids)
        valid = valid and np.array_equal(side.table.joined(ids, ends), data)
        own = slice(*np.searchsorted(ends, [skip, skip + take], side="right"))
        sides += [ids[own], ends[own]]
    if not valid:
        return Fragment(valid=False)
    return fragment(*sides, start)


# ---- Spark --------------------------------------------------------------------------------------------------------

_RESULT = ("n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<long>")
_FRAGMENT = ("doc long, chunk long, head_a array<long>, head_b array<long>, cut boolean, tail_a array<long>, "
             "tail_b array<long>, n_a long, n_b long, n_groups long, groups string, pairs array<long>, links array<long>, "
             "valid boolean")
_FIELDS = [column.split()[0] for column in _FRAGMENT.split(", ")]


def _result(part: Fragment) -> tuple:
    return part.n_a, part.n_b, part.n_groups, int(part.links.sum()), ";".join(part.groups), part.pairs, part.links


def _row(part: Fragment) -> tuple:
    return (*part.head, part.cut, *part.tail, part.n_a, part.n_b, part.n_groups, ";".join(part.groups),
            part.pairs, part.links, part.valid)


def _of_row(r) -> Fragment:
    return Fragment(head=(list(r.head_a), list(r.head_b)), cut=bool(r.cut), tail=(list(r.tail_a), list(r.tail_b)),
                    n_a=int(r.n_a), n_b=int(r.n_b), n_groups=int(r.n_groups), groups=[r.groups] if r.groups else [],
                    pairs=np.asarray(r.pairs, np.int64), links=np.asarray(r.links, np.int64), valid=bool(r.valid))


def _reduce(fragments: DataFrame, fan_in: int) -> DataFrame:
    """One level of the tree: ``fan_in`` neighbouring fragments of a document become one."""
    ship_package(fragments.sparkSession)

    def node(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.itertuples(index=False), key=lambda r: r.chunk)
        part = compose([_of_row(r) for r in rows])
        return pd.DataFrame([(rows[0].doc, rows[0].chunk // fan_in, *_row(part))], columns=_FIELDS)

    return fragments.groupBy("doc", F.floor(F.col("chunk") / fan_in).alias("node")).applyInPandas(node, _FRAGMENT)


def _file(source: bytes | str) -> bytes:
    if isinstance(source, str):
        with open(source, "rb") as file:
            return file.read()
    return source


def align(docs: DataFrame, keep: list[str], byte_level: bytes | str, pieces: bytes | str, text: str = "text",
          pattern: str | None = None, chunk: int = CHUNK, reach: int = REACH, fan_in: int = FAN_IN) -> DataFrame:
    """kept (a struct of the columns ``keep``), n_a, n_b, n_groups, n_links, groups, pairs, links of each document.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of the first | second tokenizer, by group. ``pairs`` are the distinct id
    pairs linked in the document (first << 32 | second), ``links`` how often each is. ``byte_level`` and ``pieces``
    are the tokenizers' files (a few MB, broadcast) or their paths on the driver, ``pattern`` see ``ByteLevel``.

    Documents of up to ``chunk`` code points are done where they are read. Only the chunks of longer ones are dealt to
    other tasks, and only their fragments are shuffled.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((_file(byte_level), _file(pieces), pattern))
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    kept = T.StructType([rows.schema["kept"]])
    long = F.coalesce(F.char_length("text") >= chunk, F.lit(False))
    result = T.StructType(kept.fields + T.StructType.fromDDL(_RESULT).fields)

    def short_doc(k, content) -> Iterator[tuple]:
        if not content:
            yield (k, *_result(Fragment()))
            return
        size = len(content.encode("utf-8", "surrogatepass")) + 1
        yield (k, *_result(whole(chunk_fragment(" " + content, 0, size, *_tokenizers(shared), True))))

    short = flat_map_rows(rows.filter(~long), short_doc, result)

    def split(doc, content) -> Iterator[tuple]:
        spaced = " " + content
        for i, (at, to, begin, end) in enumerate(chunk_ranges(spaced, chunk, reach)):
            yield (doc, i, spaced[begin:end], len(spaced[begin:at].encode("utf-8", "surrogatepass")),
                   len(spaced[at:to].encode("utf-8", "surrogatepass")))

    longer = cut_lineage(rows.filter(long).withColumn("doc", F.monotonically_increasing_id()))
    chunks = flat_map_rows(longer.select("doc", "text"), split,
                           T.StructType.fromDDL("doc long, chunk long, read string, skip long, take long"), rows=8)

    def read_chunk(doc, i, read, skip, take) -> Iterator[tuple]:
        yield (doc, i, *_row(chunk_fragment(read, skip, take, *_tokenizers(shared), i == 0)))

    parts = cut_lineage(flat_map_rows(chunks.repartition("doc", "chunk"), read_chunk, T.StructType.fromDDL(_FRAGMENT), rows=8))
    last = parts.agg(F.max("chunk")).first()[0] or 0
    while last > 0:
        parts, last = cut_lineage(_reduce(parts, fan_in)), last // fan_in

    def finish(k, *fields) -> Iterator[tuple]:
        yield (k, *_result(whole(_of_row(_Fields(*fields)))))

    done = longer.select("doc", "kept").join(parts, "doc").select("kept", *_FIELDS[2:])
    return short.unionByName(flat_map_rows(done, finish, result, rows=8))


class _Fields:
    def __init__(self, *values):
        self.__dict__.update(zip(_FIELDS[2:], values))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs, best of each linked id pair: documents that hold it linked, and whether no pair of its first id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = cut_lineage(counts.withColumn("first", F.shiftright("pair", 32)))
    most = counts.groupBy("first").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "first").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, max_pairs: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """The rows of ``aligned`` with n_best (links of best pairs) and count_sum (document counts summed over links).

    Counts of up to ``max_pairs`` pairs are broadcast, more are joined by a shuffle.
    """
    rows = written(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = cut_lineage(pair_counts(rows))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.links").alias("times"))
    links = links.join(F.broadcast(counts) if small_enough(counts, max_pairs) else counts, "pair")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                    F.sum(F.col("n_docs") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "links").join(sums, "row", "left").drop("row").withColumns(
        {"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)})
