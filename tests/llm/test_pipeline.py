"""The pipeline on a small table against its stages in plain Python, and the SQL of the queries."""

import duckdb
import pytest

import corpus_pipeline
from areascope.llm import catalog as C
from areascope.llm import quality_rules as Q

from . import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = []
    for d, t in docs:
        judged = Q.judge(t, Q.LineRules())
        if judged[6]:
            rows.append((d, judged[-1]))
    rows = [(d, dict(rows)[d]) for d, _, c in brute.components(rows) if d == c]
    left = brute.dedup([t for _, t in rows], corpus_pipeline.PASSAGE)
    kept = {d for (d, t), (n, gone, _, _) in zip(rows, left) if gone < n}
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in out}
    assert ids <= kept
    texts = dict(rows)
    whole = {d for (d, _), x in zip(rows, left) if x[1] == 0}
    for d in kept & whole:
        assert (d in ids) != brute.contamination(texts[d], items)[3]
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out) and items


@pytest.mark.parametrize("name", sorted(C.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(C.ORACLE[name])
    got = C.QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    cols = sorted(want.columns)
    assert sorted(map(str, want.project(", ".join(cols)).fetchall())) == sorted(str(tuple(r)) for r in got.select(cols).collect())


def test_passages_of_over_fifty_words_go(spark, docs_of):
    """A passage of 51 words in two documents goes from both, their own words stay; equal to brute force at that length."""
    import corpus_pipeline as P

    from . import brute
    passage = " ".join(f"shared{i % 17}w{i}" for i in range(51))
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(60)) + f". {passage} " + " ".join(f"end{i}y{j}" for j in range(40)))
            for i in range(2)] + [(5, " ".join(f"clean{j}" for j in range(90)))]
    got = {r["doc_id"]: r["text"] for r in P.repeated_passages(spark, docs_of(rows), "").collect()}
    want = brute.dedup([t for _, t in rows], P.PASSAGE)
    for (i, _), (n, gone, _, kept) in zip(rows, want):
        assert brute.sha(got[i].encode()) == kept
        assert (gone > 0) == (i < 2)
    assert "shared3w20" not in got[0] and "own0x58" in got[0] and "end1y39" in got[1]
