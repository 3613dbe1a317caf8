"""Byte-level BPE, token alignment and the prefix trie against plain versions."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from areascope.llm import byte_bpe, catalog, prefix_trie, token_alignment

from . import brute_tokens as brute

TEXTS = [None, "", " ", "a", "Hello  world\n\n it's 12345 ok ", "é日本語 ß ÃÂÃÂ <|endoftext|>", "a" * 3000, " " * 2500 + "x",
         "x\x00\x01\x1c\x85　y", "'s 'S 've", "-----====" * 40, "same text", "same text", "🙂👩‍👩‍👧 ok"]


def _random_texts(n, seed=3):
    rnd = random.Random(seed)
    alphabets = ["ab ", "aA =-_", " \n\tx", "ÃÂ", "é日本語ß ", "abcdefghijklmnopqrstuvwxyz'   ", "0123456789 ."]
    return ["".join(rnd.choice(a) for _ in range(rnd.randint(0, 300))) for a in rnd.choices(alphabets, k=n)]


@pytest.fixture(scope="module")
def fst():
    return byte_bpe.Transducer(brute.rank_file(), P.PATTERN)


def test_transducer_equals_tiktoken(fst):
    rows = list(enumerate(TEXTS + _random_texts(400)))
    import tiktoken
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=brute.rank_file(), special_tokens={})
    for _, text in rows:
        assert fst.encode(text or "").tolist() == enc.encode_ordinary(text or ""), text


def test_transducer_holds_back_a_bounded_lookahead(fst):
    """Long matches give tokens while they are read, and the states don't grow with them."""
    for unit in ("a", "ab", "-", "ÃÂ"):
        portions = list(fst.pieces((unit * 20000).encode()))
        assert len(portions[-1]) < 256 and len(portions) > 100
    assert len(fst._forms) < 20000


def test_order_of_tokens_equals_the_merges_of_both(fst):
    """The walk along the border agrees with merging the bytes of the pair."""
    rnd = random.Random(2)
    tokens = [t for t in fst.bytes_of if len(fst.bytes_of[t]) < 12]
    twins = [t for t in tokens if len(set(fst.bytes_of[t])) == 1]
    follow = 0
    for _ in range(30000):
        x, y = rnd.choice(tokens), rnd.choice(tokens)
        if rnd.random() < 0.2:
            x, y = rnd.choice(twins), rnd.choice(twins)
        want = fst.merge(fst.bytes_of[x] + fst.bytes_of[y]) == [fst.bytes_of[x], fst.bytes_of[y]]
        assert fst.follows(x, y) == want, (fst.bytes_of[x], fst.bytes_of[y])
        follow += want
    assert 1000 < follow < 29500


def test_transducer_forgets_states_without_changing_results(fst, monkeypatch):
    texts = _random_texts(60, seed=5)
    want = [fst.encode(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 20)
    small = byte_bpe.Transducer(brute.rank_file(), P.PATTERN)
    assert [small.encode(t) for t in texts] == want


def test_utf8_machine_streams(fst):
    machine = byte_bpe.Utf8Machine(fst.bytes_of)
    text = "é日本語🙂 ok " * 5
    ids = fst.encode(text).tolist()
    parts = list(machine.decode([i] for i in ids))  # one token at a time
    assert "".join(parts) == text and "" in parts  # characters over several tokens wait
    half = [i for i in ids if len(fst.bytes_of[i]) == 1][:1]
    assert "�" in "".join(machine.decode([half + [fst.ranks[b"a"]]])) or not half
    broken = [fst.ranks[b"\xe6"], fst.ranks[b"a"], fst.ranks[b"\xe6"]]
    data = b"".join(fst.bytes_of[i] for i in broken)
    assert "".join(machine.decode([broken[:1], broken[1:]])) == data.decode("utf-8", "replace")


def test_encode_and_decode_tables(spark, docs_of, clash):
    rows = list(enumerate(TEXTS + _random_texts(30)))
    docs = clash(docs_of(rows)).withColumn("ids", F.lit("x"))
    path = P.path("byte_bpe_50k.tiktoken")
    out = byte_bpe.encode(docs, ["doc_id"], path, P.PATTERN)
    back = {r.doc_id: r.text for r in byte_bpe.decode(out, ["doc_id"], path).collect()}
    assert back == {d: t or "" for d, t in rows}
    assert byte_bpe.encode(docs_of([]), ["doc_id"], path, P.PATTERN).collect() == []
    nothing = byte_bpe.decode(out.withColumn("ids", F.lit(None).cast("binary")).limit(1), ["doc_id"], path)
    assert nothing.first().text == ""


def _run(spark, docs, name, tmp_path, table="documents"):
    docs.write.parquet(f"{tmp_path}/{table}.parquet")
    out = catalog.QUERIES[name](spark, str(tmp_path))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_op11_equals_tiktoken(spark, docs_of, tmp_path):
    rows = [*enumerate(TEXTS), (None, "no id"), (1, "twice")]
    assert _run(spark, docs_of(rows), "op11_byte_bpe", tmp_path) == sorted(brute.tiktoken_rows(rows), key=repr)


def test_op11_on_sample_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in catalog.QUERIES["op11_byte_bpe"](spark, sf).collect())
    assert got == sorted(brute.tiktoken_rows(rows))


# ---- alignment ----

@pytest.fixture(scope="module")
def sides():
    with open(P.path("byte_bpe_50k.json"), "rb") as a, open(P.path("piece_bpe_32k.model"), "rb") as b:
        return token_alignment.ByteLevel(a.read()), token_alignment.Pieces(b.read())


LONG = ("The quick brown Fox, niño über-straße 日本語テキスト don't stop! \n\n tabs\tand  blanks 3.14159 xyzzyplugh " * 40,
        "nospaceshere" * 300, "日本語テキスト" * 200, " " * 700 + "x y" * 300, "=" * 2000 + " a b " + "-" * 900)


def test_both_libraries_make_the_same_ids(sides):
    with open(P.path("byte_bpe_50k.json"), "rb") as file:
        fast = token_alignment.ByteLevel(file.read(), P.PATTERN)
    assert fast.fast is not None
    for text in [t for t in TEXTS if t] + _random_texts(100) + list(LONG):
        assert list(fast.ids(" " + text)) == sides[0].ids(" " + text)
    for c in range(0x250, 0x30000, 7):  # classes of letters, numbers and white space
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}! {chr(c)}"
            assert list(fast.ids(text)) == sides[0].ids(text)


def _same(x, y):
    return (x.head, x.cut, x.tail, x.n_a, x.n_b, x.n_groups, ";".join(x.groups), x.pairs.tolist(), x.links.tolist(), x.valid) == (
        y.head, y.cut, y.tail, y.n_a, y.n_b, y.n_groups, ";".join(y.groups), y.pairs.tolist(), y.links.tolist(), y.valid)


def _lists(part):
    part.head, part.tail = (tuple(map(list, p)) for p in (part.head, part.tail))
    return part


def test_chunks_compose_to_the_whole(sides):
    for text in LONG:
        spaced = " " + text
        want = token_alignment.chunk_fragment(spaced, 0, len(spaced.encode()), *sides, True)
        for size, reach in ((7, 30), (64, 40), (100, 5), (333, 200)):
            parts = []
            for at, to, begin, end in token_alignment.chunk_ranges(spaced, size, reach):
                parts.append(token_alignment.chunk_fragment(
                    spaced[begin:end], len(spaced[begin:at].encode()), len(spaced[at:to].encode()), *sides, at == 0))
            assert sum(p.n_a for p in parts) == want.n_a
            assert _same(_lists(token_alignment.compose(parts)), _lists(want)), (text[:20], size, reach)


def test_some_cuts_fall_inside_groups(sides):
    spaced = " " + LONG[0]
    ranges = list(token_alignment.chunk_ranges(spaced, 50, 60))
    parts = [token_alignment.chunk_fragment(spaced[b:e], len(spaced[b:a].encode()), len(spaced[a:t].encode()), *sides)
             for a, t, b, e in ranges]
    assert sum(any(p.tail) for p in parts) > 10  # open suffixes that the next chunk closes


def test_composition_is_associative():
    rnd = np.random.default_rng(4)
    for _ in range(200):
        n = int(rnd.integers(2, 40))
        end_a = np.sort(rnd.choice(60, n, replace=False)) + 1
        end_b = np.sort(rnd.choice(60, n, replace=False)) + 1
        a, b = rnd.integers(0, 5, n), rnd.integers(0, 5, n)
        cuts = [0, *sorted(rnd.choice(60, 3, replace=False) + 1), 61]
        parts = []
        for lo, hi in zip(cuts, cuts[1:]):
            ia, ib = (end_a > lo) & (end_a <= hi), (end_b > lo) & (end_b <= hi)
            parts.append(token_alignment.fragment(a[ia], end_a[ia], b[ib], end_b[ib]))
        c = token_alignment.compose
        want = _lists(token_alignment.fragment(a, end_a, b, end_b))
        none = token_alignment.Fragment()
        assert _same(_lists(c(parts)), want)
        assert _same(_lists(c([c(parts[:2]), none, c(parts[2:])])), want)
        assert _same(_lists(c([parts[0], c([parts[1], c(parts[2:])])])), want)


def test_large_groups_are_counted_before_they_are_paired():
    a, b = np.arange(300) % 3, np.arange(200) % 2
    part = token_alignment.whole(token_alignment.fragment(a, np.arange(300) * 2 + 2, b, np.append(np.arange(199) * 2 + 1, 600), True))
    assert part.n_groups == 1 and int(part.links.sum()) == 60000 and len(part.pairs) == 6


def test_op12_equals_brute_force(spark, docs_of, tmp_path):
    rows = [*enumerate(TEXTS + _random_texts(20) + list(LONG)), (None, "no id"), (1, "twice"), (90, "with ▁ inside"), (91, "▁")]
    assert _run(spark, docs_of(rows), "op12_token_alignment", tmp_path) == sorted(brute.alignment(rows), key=repr)


def test_alignment_of_long_documents_over_a_tree(spark, docs_of, clash):
    rows = [*enumerate(LONG), (7, "short"), (8, None), (9, "bad ▁ " + LONG[0]), (0, LONG[0])]
    docs = clash(docs_of(rows))
    files = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    want = sorted(brute.alignment(rows), key=repr)
    for chunk, limit in ((150, 1_000_000), (1 << 15, 3)):  # a tree of several levels; pairs joined instead of broadcast
        got = token_alignment.align(docs, ["doc_id", "n"], *files, chunk=chunk, reach=60, fan_in=2)
        told = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("sha")
        out = token_alignment.score_links(got.withColumn("sha", told), limit).select(
            "kept.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha", "kept.n")
        assert sorted((tuple(r)[:-1] for r in out.collect()), key=repr) == want


def test_alignment_of_nothing(spark, docs_of):
    files = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    assert token_alignment.score_links(token_alignment.align(docs_of([]), ["doc_id"], *files)).collect() == []


# ---- trie ----

TURNS = "conv_id long, turn long, role string, text string"


def _conversations(seed, n_convs, hot=0):
    rnd, rows = random.Random(seed), []
    for c in rnd.sample(range(-50, 450), n_convs):
        for t in range(rnd.randint(1, 7)):
            rows.append((c, t, rnd.choice(["user", "bot", None]), rnd.choice(["a", "b", "", None, "long é text"])))
    for c in range(1000, 1000 + hot):  # copies of one conversation, where their heads are absent
        rows += [(c, t, "user", "copy") for t in range(9)]
    return rows


def _nodes(df):
    return sorted((tuple(r) for r in df.select(*prefix_trie.COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("shards", [1, 2, 7, 61])
def test_trie_equals_brute_force(spark, shards):
    rows = [r for r in _conversations(shards, 150, hot=120) if r[0] >= 0]
    rows += [(5, None, "user", "early"), (700, 0, None, None), (None, 0, "user", "no id"), (300, 3, "user", "x"), (300, 3, "user", "x")]
    rows = list({(r[0], r[1]): r for r in rows}.values()) + [(900, 2, "same", "row")] * 3
    made = prefix_trie.rebuilt(prefix_trie.conversation_turns(spark.createDataFrame(rows, TURNS)))
    assert _nodes(prefix_trie.trie(made, shards)) == brute.trie(rows)


def test_skeleton_is_only_what_spans_shards(spark):
    rows = _conversations(1, 0, hot=100)
    made = prefix_trie.rebuilt(prefix_trie.conversation_turns(spark.createDataFrame(rows, TURNS)))
    paths = (made.select(F.unhex(F.array_join(F.transform("units", F.hex), "")).alias("path"), "conv_id")
             .repartitionByRange(5, "path", "conv_id").sortWithinPartitions("path", "conv_id"))
    paths = prefix_trie.cut_lineage(paths)
    depths = prefix_trie.skeleton_depths(paths)
    assert max(d for pair in depths.values() for d in pair) >= 9 and min(pair[0] for pair in depths.values()) == -1
    parts = prefix_trie.walk(paths, depths)
    assert parts.filter("part").select("key").distinct().count() < parts.filter("not part").count() + 40


def test_trie_of_one_and_of_no_conversation(spark):
    one = spark.createDataFrame([(3, 0, "user", "hi")], TURNS)
    assert _nodes(prefix_trie.prefix_trie(one)) == brute.trie([(3, 0, "user", "hi")])
    assert _nodes(prefix_trie.prefix_trie(one.limit(0))) == []
    assert _nodes(prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "hi")], TURNS))) == []


def test_op13_on_sample_tables_with_clashing_names(spark, clash, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = _run(spark, clash(table).withColumn("path", F.lit("x")), "op13_prefix_trie", tmp_path, "conversations")
    assert got == brute.trie(rows)


def test_trie_of_very_long_conversations(spark):
    rows = [(c, t, "user", "x" if t < 900 else str(c)) for c in (100, 101, 200, 205) for t in range(1000)]
    made = prefix_trie.rebuilt(prefix_trie.conversation_turns(spark.createDataFrame(rows, TURNS)))
    assert _nodes(prefix_trie.trie(made, 4)) == brute.trie(rows)
