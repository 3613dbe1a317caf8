"""Toxicity, quality and language on the given tables (held-out accuracy) and on edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from areascope.llm import catalog as C
from areascope.llm import language as L
from areascope.llm import neighbour_quality as N
from areascope.llm import toxicity as X
from areascope.llm.ngram import gram_counts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")


def _share(df, hit):
    return df.agg(F.avg(hit.cast("double"))).first()[0]


def test_toxicity_held_out(spark, labels):
    out = C.op1_toxicity(spark, SF).join(labels, "doc_id").filter("held_out")
    assert _share(out.filter("toxic = 1"), F.col("predicted") == 1) > 0.7
    assert _share(out.filter("toxic = 0"), F.col("predicted") == 0) > 0.98


def test_quality_held_out(spark, labels):
    out = C.op3_quality(spark, SF).join(labels, "doc_id").filter("held_out")
    assert _share(out, F.col("predicted") == F.col("quality")) > 0.95


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = C.op7_language(spark, SF).join(docs, "doc_id").filter("held_out")
    assert _share(out, F.col("lang_pred") == F.col("lang")) > 0.97


EDGE = [(1, None), (2, ""), (3, "12 34 !!"), (4, "plain words in a row"), (4, "plain words in a row"), (None, "ünï " * 3), (6, "x" * 300_000)]


def test_edges(spark, docs_of, clash):
    docs = clash(docs_of(EDGE)).drop("label")
    none = spark.createDataFrame([], "doc_id long, text string, label int")
    some = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(
        [("good words in prose here", 1), ("bad junk junk junk", 0), ("fine words stand here", 1), (None, 1), ("x", None)] * 4)],
        "doc_id long, text string, label int")
    for train in (none, some):
        q = N.quality(docs, train, ["doc_id"]).collect()
        assert len(q) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in q)
        t = X.score(docs, X.fit(train), ["doc_id"]).collect()
        assert len(t) == len(EDGE) and all(0 <= r["p_toxic"] <= 1 for r in t)
    assert N.quality(docs_of([]), some, ["doc_id"]).count() == 0 == X.score(docs_of([]), X.fit(some), ["doc_id"]).count()
    train = docs_of([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "fr"), (4, "x y", None)])
    out = L.identify(docs, L.fit(train), ["doc_id"]).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(EDGE) and {by[i]["lang_pred"] for i in (1, 2, 3)} == {"und"} and by[4]["lang_pred"] in ("en", "de")
    nothing = L.fit(train.limit(0))
    assert {r["lang_pred"] for r in L.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}


def test_votes_against_brute_force():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 6)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    y = (rng.random(200) < 0.5).astype(np.float32)
    o = N.Options(neighbours=7)
    got = N.vote(v[:20], N.Model(None, None, None, v, y), o)
    for i in range(20):
        sims = v @ v[i]
        near = np.argsort(-sims)[:7]
        w = np.clip(sims[near], 1e-3, 1) ** o.power
        assert abs(got[i] - (w * y[near]).sum() / w.sum()) < 1e-4


def test_gram_counts_cover_whole_texts():
    from areascope.llm import ngram
    data = np.random.default_rng(1).integers(97, 123, 5000).astype(np.uint8)
    whole = gram_counts(data, 64)
    piece, ngram._PIECE = ngram._PIECE, 512
    try:
        assert (gram_counts(data, 64) == whole).all() and whole.sum() == 4999 + 4998
    finally:
        ngram._PIECE = piece


def test_chain_feeds_earlier_probabilities():
    w = [np.array([2.0, -1.0]), np.array([0.0, 3.0, -2.0])]
    p = X.predict(np.array([[0.0], [1.0]], np.float32), w)
    assert np.allclose(p[:, 1], 1 / (1 + np.exp(-(3 * p[:, 0] - 2))))


def test_language_learns_nothing_from_held_out_texts(spark, tmp_path):
    """Other held-out texts leave the scores of all other documents as they are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("text", F.when(C.held_out(F.col("doc_id")), F.lit("zzz qqq " * 40)).otherwise(F.col("text")))
    other.write.parquet(f"{tmp_path}/documents.parquet")
    scores = [{r["doc_id"]: (r["lang_pred"], r["score"]) for r in
               C.op7_language(spark, sf).filter("not held_out").collect()} for sf in (SF, str(tmp_path))]
    assert scores[0] == scores[1] and len(scores[0]) > 100
