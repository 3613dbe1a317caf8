import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text) or (doc_id, text, lang, source) tuples as a table of documents."""
    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    def add(df):
        names = ["k", "row", "t0", "t1", "spans", "hits", "size", "base", "block", "gid", "sid", "token", "root", "u", "v", "n",
                 "words", "score", "kept", "count", "key", "range", "kind", "id"]
        return df.withColumns({c: F.lit("x") for c in names})
    return add
