"""Suffix-array dedup and the Jaccard join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from areascope.llm import jaccard_join as J
from areascope.llm import suffix_dedup as S
from areascope.llm.components import components

from . import brute


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(5, 160)) for _ in range(25)]
    passage = prose(rng, 40)
    out = [*base, base[0], base[0], base[1] + " tail", "x" * 900, "ab" * 300, None, "", " ", "one two", "one two"]
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(6)]
    out.append(passage + " " + prose(rng, 10) + " " + passage)
    near = prose(rng, 200).split()
    for i in range(5):
        w = list(near)
        w[rng.randrange(len(w))] = f"new{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("max_kinds", [20_000, 1])
def test_dedup_matches_brute_force(spark, docs_of, texts, max_kinds):
    docs = docs_of([(i, t) for i, t in enumerate(texts)])
    out = S.dedup(docs, ["doc_id"], length=80, gram=20, batches=3, max_kinds=max_kinds).drop("kept").collect()
    got = [tuple(r[1:]) for r in sorted(out)]
    assert got == brute.dedup(texts, 80)


def test_dedup_blocks_of_long_texts(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 64)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 1000).astype(np.uint8)
    seen = []
    for s, _, at, first, last in S.anchors(data, 50, 10):
        for a, lo, hi in zip(at + s, first + s, last + s):
            assert lo <= a <= lo + 40 and hi <= a
            seen.extend(range(lo, hi + 1))
    assert seen == list(range(1000 - 50 + 1))


def test_place_round_trip():
    at, first, last = np.array([5, 10 ** 9]), np.array([0, 10 ** 9 - 304]), np.array([5, 10 ** 9 - 3])
    assert [list(x) for x in S.unpack(S.pack(at, first, last))] == [list(at), list(first), list(last)]


def test_dedup_empty_clashing_and_clean(spark, docs_of, clash):
    assert S.dedup(docs_of([]), ["doc_id"], length=20, gram=8).count() == 0
    docs = clash(docs_of([(1, "é" * 30 + "abc"), (2, "é" * 30 + "xyz"), (None, None), (4, "plain text")]))
    out = {r["doc_id"]: r for r in S.clean_documents(docs, length=21, gram=8).collect()}
    assert out[1]["text"].endswith("abc") and "�" not in out[1]["text"] and out[1]["k"] == "x"
    assert out[4]["text"] == "plain text" and out[4]["n_chars"] == 10 and out[None]["text"] in ("", None)
    assert S.clean_documents(docs, length=21, gram=8).columns == docs.columns


def test_join_matches_brute_force(spark, docs_of, texts, clash):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (None, "lonely words here now indeed")]
    out = J.join_components(clash(docs_of(rows))).collect()
    assert sorted(map(str, [tuple(r) for r in out])) == sorted(map(str, brute.components(rows)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_of_families(spark, docs_of, seed):
    """Families of near copies at all distances around the limit, some with a common passage."""
    rng = random.Random(seed)
    rows, passage = [], prose(rng, 30)
    for f in range(6):
        base = prose(rng, 60).split() + (passage.split() if f % 2 else [])
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10 ** 6)}"
            rows.append((len(rows) + 1, " ".join(w[: len(w) - rng.randrange(12)])))
    out = J.join_components(docs_of(rows)).collect()
    assert sorted(tuple(r) for r in out) == sorted(brute.components(rows))


def test_frequent_shingles_only_change_the_order(spark, docs_of, monkeypatch):
    monkeypatch.setattr(J, "TOLD", 1)
    rng = random.Random(9)
    passage = prose(rng, 20)
    rows = [(i, passage + " " + prose(rng, 12)) for i in range(20)] + [(50, passage), (51, passage + " x")]
    out = J.join_components(docs_of(rows)).collect()
    assert sorted(tuple(r) for r in out) == sorted(brute.components(rows))


def test_join_empty_and_representatives(spark, docs_of):
    assert J.join_components(docs_of([])).count() == 0
    docs = docs_of([(2, "a b c d e f g"), (1, "A b c d e f g"), (3, "other words"), (4, None), (3, "other words")])
    kept = J.representatives(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4] and kept.columns == docs.columns


def test_representatives_by_id_and_text(spark, docs_of):
    a, b, c = "a b c d e f g", "other words of a text that nobody else has", "one more text of which copies have no id"
    docs = docs_of([(7, a), (7, b), (1, a.upper()), (None, c), (None, c.upper()), (8, None), (None, None)])
    kept = [(r["doc_id"], None if r["text"] is None else r["text"].lower()) for r in J.representatives(docs).collect()]
    assert sorted(kept, key=str) == sorted([(7, b), (1, a), (None, c), (8, None), (None, None)], key=str)


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionByName(
        spark.createDataFrame([(100, 101), (101, 101), (101, 100)], "u long, v long"))
    out = {r["u"]: r["root"] for r in components(edges).collect()}
    assert out == {**{i: 0 for i in range(1, n)}, 101: 100}
