"""Quality scores by a vote of the nearest labelled documents in a latent semantic space.

Documents are TF-IDF vectors over hashed byte n-grams and a few binned style
measures (shares of repeated words, capitals, symbols and so on, as terms of
their own). The axes of the space are the leading eigenvectors of the labelled
documents' Gram matrix, which is summed by the tasks. The labelled vectors are
broadcast; every document meets all of them in blocks of exact cosine
products, and the nearest ones vote for their label, weighted by similarity.

Bounds: at most ``max_fit`` labelled rows fit the axes and at most
``max_voters`` are broadcast (``rank`` floats each), both drawn by the hash of
the id. Inverse document frequencies are counted over all documents.

Defined results: null and empty texts get the label share of the voters whose
style is nearest, like any other text; with no labelled rows every score is
``empty_score``; rows with a null label or text are not learnt from; repeated
rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import byte_array, cut_lineage, hash_fraction, schema_of, ship_package
from .ngram import document_frequencies, gram_counts, term_weights, unit

GRAMS, BINS = 1024, 8
#: Tasks that share the bounded sample when the axes are fitted.
FIT_PARTS = 6
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>{}[]=_^~\\/@", np.uint8)] = True
MEASURES = 9
DIMS = GRAMS + MEASURES * BINS


def style(data: np.ndarray) -> np.ndarray:
    """Shares between 0 and 1 that tell running prose from lists, tables, shouting and repetition."""
    n = max(1, len(data))
    words = data.tobytes().split()
    k = max(1, len(words))
    seen = Counter(words)
    top = max(seen.values(), default=0)
    same = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    letters = max(1, int(((data | 32) >= 97).sum()))
    upper = int(((data >= 65) & (data <= 90)).sum())
    return np.array([
        len(seen) / k, top / k, same / k, pairs / k,
        upper / letters, ((data >= 48) & (data <= 57)).sum() / n,
        min(1, int(_SYMBOLS[data].sum()) / k), min(1, int(((data == 33) | (data == 63)).sum()) / k),
        min(1, np.log1p(len(words)) / 10)])


def features(text: str | None) -> np.ndarray:
    """Term weights of a text before the inverse document frequencies."""
    data = byte_array(text)
    out = np.zeros(DIMS, np.float32)
    out[:GRAMS] = term_weights(gram_counts(data, GRAMS))
    norm = np.linalg.norm(out[:GRAMS])
    if norm:
        out[:GRAMS] /= norm
    # Each measure is spread over its two nearest bins, so that near values stay near.
    x = np.clip(style(data), 0, 1) ** 0.5 * (BINS - 1)
    low = np.minimum(x.astype(int), BINS - 2)
    at = GRAMS + np.arange(MEASURES) * BINS + low
    out[at] = 1 - (x - low)
    out[at + 1] = x - low
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray     # DIMS x rank
    mean: np.ndarray
    voters: np.ndarray   # rows of unit vectors
    labels: np.ndarray


@dataclass(frozen=True)
class Options:
    rank: int = 48
    neighbours: int = 25
    power: float = 8.0
    style_weight: float = 1.0
    max_fit: int = 20_000
    max_voters: int = 4_096
    block: int = 512


def weigh(rows: np.ndarray, idf: np.ndarray, style_weight: float) -> np.ndarray:
    """TF-IDF with the grams and the style terms each scaled to a fixed share."""
    rows = rows * idf
    grams, terms = unit(rows[:, :GRAMS]), unit(rows[:, GRAMS:])
    return np.hstack([grams, style_weight * terms]).astype(np.float32)


def _stack(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.stack([features(t) for t in batch.column(k).to_pylist()])


def fit(docs: DataFrame, labelled: DataFrame, options: Options = Options()) -> Model | None:
    """``docs``: text of all documents; ``labelled``: doc_id, text, label (0 or 1), the rows that may be learnt from."""
    spark = docs.sparkSession
    ship_package(spark)
    idf = document_frequencies(docs, features, DIMS)
    known = labelled.filter("text is not null and label is not null")
    total = known.count()
    if not total:
        return None
    draw = hash_fraction(F.lit(5), F.col("doc_id"))
    sample = cut_lineage(known.filter(draw < options.max_fit / total * 0.98 if total > options.max_fit else F.lit(True))
                         .select("text", "label", draw.alias("u")).repartition(FIT_PARTS, "u"))
    schema = T.StructType.fromDDL("dim int, sums array<double>")
    arrow = to_arrow_schema(schema)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIMS + 1, DIMS))
        for batch in batches:
            for s in range(0, batch.num_rows, options.block):
                x = weigh(_stack(batch.slice(s, options.block), 0), idf, options.style_weight)
                total[:DIMS] += x.T @ x
                total[DIMS] += x.sum(axis=0)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(DIMS + 1, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], schema=arrow)

    # FIT_PARTS partial matrices are added row by row, however many parts the sample lies in.
    sums = (sample.select("text").coalesce(FIT_PARTS).mapInArrow(gram, schema).groupBy("dim")
            .agg(F.reduce(F.collect_list("sums"), F.array_repeat(F.lit(0.0), DIMS),
                          lambda a, b: F.zip_with(a, b, lambda p, q: p + q)).alias("sums")))
    matrix = np.zeros((DIMS + 1, DIMS))
    for dim, row in sums.collect():
        matrix[dim] = row
    n = sample.count()
    mean = matrix[DIMS] / n
    _, vectors = np.linalg.eigh(matrix[:DIMS] / n - np.outer(mean, mean))
    axes = vectors[:, ::-1][:, : options.rank].astype(np.float32)
    share = min(1.0, options.max_voters / n * 0.95)
    limit = share * (options.max_fit / total * 0.98 if total > options.max_fit else 1.0)
    chosen = sample.filter(F.col("u") < limit) if share < 1 else sample
    rank = options.rank
    voter_schema = T.StructType.fromDDL("label int, v array<float>")
    voter_arrow = to_arrow_schema(voter_schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, options.block):
                part = batch.slice(s, options.block)
                v = unit((weigh(_stack(part, 0), idf, options.style_weight) - mean.astype(np.float32)) @ axes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).cast(pa.int32()), pa.array(list(v), pa.list_(pa.float32()))], schema=voter_arrow)

    held = chosen.select("text", F.col("label").cast("int").alias("label")).mapInArrow(place, voter_schema).toPandas()
    if held.empty:
        return None
    voters = np.array(held["v"].tolist(), np.float32).reshape(-1, rank)
    labels = held["label"].to_numpy(np.float32)
    order = np.lexsort((labels, *voters.T))  # not the order of arrival
    return Model(idf, axes, mean.astype(np.float32), voters[order], labels[order])


def vote(x: np.ndarray, model: Model, options: Options) -> np.ndarray:
    """Scores of a block of latent vectors: all cosines, then the nearest labels weighted by their similarity."""
    cosine = x @ model.voters.T
    k = min(options.neighbours, cosine.shape[1])
    near = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, -k:]
    sims = np.clip(np.take_along_axis(cosine, near, 1), 1e-3, 1) ** options.power
    return (sims * model.labels[near]).sum(axis=1) / sims.sum(axis=1)


def score(docs: DataFrame, model: Model | None, keep: list[str], options: Options = Options(),
          empty_score: float = 0.0) -> DataFrame:
    """Columns ``keep`` and ``score``; one pass with the model as a broadcast variable, no shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)  # at most max_voters x rank + DIMS x rank floats
    schema = schema_of(docs, keep, "score double")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for s in range(0, batch.num_rows, options.block):
                part = batch.slice(s, options.block)
                if m is None:
                    scores = np.full(part.num_rows, empty_score)
                else:
                    x = weigh(_stack(part, len(keep)), m.idf, options.style_weight)
                    scores = vote(unit((x - m.mean) @ m.axes), m, options).astype(np.float64)
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.clip(scores, 0, 1))], schema=arrow)

    return docs.select(*keep, F.col("text")).mapInArrow(run, schema)


def quality(docs: DataFrame, labelled: DataFrame, keep: list[str], threshold: float = 0.3,
            options: Options = Options()) -> DataFrame:
    """Columns ``keep`` with score and predicted, learnt from ``labelled``."""
    predicted: Column = (F.col("score") >= threshold).cast("int")
    return score(docs, fit(docs, labelled, options), keep, options).withColumn("predicted", predicted)
