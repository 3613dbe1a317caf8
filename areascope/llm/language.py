"""Language identification by the nearest of several centroids for each language.

Documents are unit TF-IDF vectors over hashed byte n-grams of the lower-cased
letters of the text. For each language a bounded sample is clustered by spherical k-means,
one task a language; a document gets the language of the centroid with the
largest cosine. A document that lies further from that centroid than nearly
all of the centroid's own members did is marked as rejected.

Bounds: at most about ``per_language`` documents of each language are
clustered, drawn by the hash of the id; frequencies are counted over all
documents that may be learnt from, and all documents are classified.

Defined results: ``und`` with score 0 for texts that are null or without a
letter, and for all texts if nothing could be learnt; null languages are not
learnt from; ties go to the language that sorts first; repeated rows get equal
results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_lineage, hash_fraction, schema_of, ship_package, small_enough
from .ngram import document_frequencies, gram_counts, letter_bytes, term_weights, unit

DIMS = 2048
#: Languages whose counts may be broadcast; beyond, they meet the texts in a shuffle.
MAX_LANGUAGES = 100_000
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Options:
    centroids: int = 4
    rounds: int = 8
    per_language: int = 1500
    reject_share: float = 0.002
    block: int = 512


@dataclass
class Model:
    idf: np.ndarray
    languages: list
    centroids: np.ndarray  # a row each
    floors: np.ndarray     # cosine under which a document is rejected


def features(text: str | None) -> np.ndarray:
    return term_weights(gram_counts(letter_bytes(text), DIMS, (2, 3)))


def cluster(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit rows: centres, and each row's centre. Starts are spread: each the row furthest from those before."""
    centres = [unit(x.mean(axis=0, keepdims=True))[0]]
    best = x @ centres[0]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[int(best.argmin())])
        best = np.maximum(best, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        c = np.stack([unit(x[at == i].mean(axis=0, keepdims=True))[0] if (at == i).any() else c[i] for i in range(len(c))])
    return c, (x @ c.T).argmax(axis=1)


def fit(labelled: DataFrame, options: Options = Options()) -> Model:
    """``labelled``: doc_id, text, lang of the documents that may be learnt from; no other text has a say in the model."""
    ship_package(labelled.sparkSession)
    idf = document_frequencies(labelled.filter(F.col("lang").isNotNull()), features, DIMS)
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    each = cut_lineage(known.groupBy("lang").count().select(F.col("lang").alias("of"), F.col("count").alias("n")))
    each = F.broadcast(each) if small_enough(each, MAX_LANGUAGES) else each  # else texts would meet by language
    draw = hash_fraction(F.lit(7), F.col("doc_id"))
    sample = known.join(each, F.col("lang") == F.col("of")).filter(
        draw * F.col("n") < options.per_language).select("lang", "doc_id", "text")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        x = unit(np.stack([features(t) for t in pdf["text"]]) * idf)
        c, at = cluster(x, options.centroids, options.rounds)
        own = (x * c[at]).sum(axis=1)
        floors = [float(np.quantile(own[at == i], options.reject_share)) if (at == i).any() else 2.0 for i in range(len(c))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "v": list(c.astype(np.float32)), "floor": floors})

    # A few centroids of each language reach the driver.
    rows = sample.groupBy("lang").applyInPandas(one, "lang string, v array<float>, floor double").collect()
    rows = sorted((r for r in rows if r["floor"] <= 1), key=lambda r: (r["lang"], r["v"]))
    return Model(idf, [r["lang"] for r in rows], np.array([r["v"] for r in rows], np.float32).reshape(-1, DIMS),
                 np.array([r["floor"] for r in rows]))


def identify(docs: DataFrame, model: Model, keep: list[str], options: Options = Options()) -> DataFrame:
    """Columns ``keep`` with lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)
    schema = schema_of(docs, keep, "lang_pred string, score double, rejected boolean")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for s in range(0, batch.num_rows, options.block):
                part = batch.slice(s, options.block)
                texts = part.column(len(keep)).to_pylist()
                known = np.array([bool(m.languages) and bool(t and _LETTER.search(t)) for t in texts])
                lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if known.any():
                    at = np.flatnonzero(known)
                    x = unit(np.stack([features(texts[i]) for i in at]) * m.idf)
                    cosine = x @ m.centroids.T
                    best = cosine.argmax(axis=1)
                    for i, b in zip(at, best):
                        lang[i] = m.languages[b]
                    score[at] = np.clip(cosine[np.arange(len(at)), best], 0, 1)
                    far[at] = score[at] < m.floors[best]
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score), pa.array(far)], schema=arrow)

    return docs.select(*keep, F.col("text")).mapInArrow(run, schema)
