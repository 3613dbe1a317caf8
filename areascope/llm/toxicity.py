"""Toxicity by a classifier chain.

Three categories are predicted one after another by logistic models over term
rates: ``severe`` (flagged terms are dense), ``varied`` (many different
flagged terms) and ``toxic`` (the label itself). Each model after the first
also sees the probabilities of the categories before it. In training those
come out of fold: every row's earlier probabilities are from models that never
saw the row, so later models learn how far they can be trusted.

Terms are lower-cased words and the first four and five letters of longer
ones, so that inflected forms share a term. The terms of the model are those
whose document rates differ most between toxic and other training rows.

Bounds: at most about ``max_train`` labelled rows are learnt from, drawn by
the hash of the id, over ``max_terms`` terms; each fold of a category is
fitted by a task of its own. All documents are scored in one pass.

Defined results: null and empty texts have no terms and get the model's base
rate; without positive labels every probability is 0; null labels are not
learnt from; repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_lineage, hash_fraction, schema_of, ship_package, written

#: The chain, in order; the last is the verdict.
CATEGORIES = ("severe", "varied", "toxic")
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5)


@dataclass(frozen=True)
class Options:
    max_train: int = 20_000
    max_terms: int = 400
    min_rows: int = 3
    folds: int = 4
    ridge: float = 1e-3
    steps: int = 150
    varied_terms: int = 4


@dataclass
class Model:
    terms: dict = field(default_factory=dict)      # term -> column
    weights: list = field(default_factory=list)    # of each category: terms, earlier categories, bias
    threshold: float = 0.5


def terms_of(text: str | None) -> tuple[Counter, int]:
    """Counts of the terms of a text and its number of words."""
    words = _WORD.findall((text or "").lower())
    counts = Counter(words)
    out = Counter(counts)
    for w, n in counts.items():
        for k in _PREFIXES:
            if len(w) > k:
                out[w[:k] + "-"] += n
    return out, len(words)


def row_of(text: str | None, terms: dict) -> np.ndarray:
    """Dampened rates of the model's terms in a hundred words."""
    x = np.zeros(len(terms), np.float32)
    words = _WORD.findall((text or "").lower())
    if not words:
        return x
    for w, n in Counter(words).items():
        at = terms.get(w)
        if at is not None:
            x[at] += n
        for k in _PREFIXES:
            if len(w) > k:
                at = terms.get(w[:k] + "-")
                if at is not None:
                    x[at] += n
    return np.log1p(x * (100 / len(words)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """Weights and bias of a ridge logistic model, by accelerated gradient steps; deterministic."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    a = np.hstack([x / scale, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(a.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.append(np.full(x.shape[1], ridge), 0.0)
    v = np.ones(a.shape[1])
    for _ in range(30):  # largest curvature, by power iteration
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * np.linalg.norm(a @ v) ** 2 / len(y) + ridge)
    before = w
    for t in range(steps):
        z = w + (t / (t + 3)) * (w - before)
        g = a.T @ (_sigmoid(a @ z) - y) / len(y) + penalty * z
        before, w = w, z - rate * g
    return np.append(w[:-1] / scale, w[-1])


def predict(x: np.ndarray, weights: list) -> np.ndarray:
    """Probabilities of the categories, a column each, the chain run in order."""
    out = np.zeros((len(x), 0))
    for w in weights:
        full = np.hstack([x, out])
        out = np.hstack([out, _sigmoid(full @ w[:-1] + w[-1])[:, None]])
    return out


def choose_terms(sample: DataFrame, options: Options) -> tuple[list, list]:
    """Terms with the largest signed deviance between toxic and other rows, and which of them are flagged.

    Tasks count their own rows; the sums are ranked by Spark and ``max_terms`` rows reach the driver.
    """
    ship_package(sample.sparkSession)
    schema = T.StructType.fromDDL("term string, pos long, neg long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (pos if label else neg).update(terms_of(text)[0].keys())
        every = sorted(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([pos[t] for t in every], pa.int64()),
                                          pa.array([neg[t] for t in every], pa.int64())], schema=arrow)

    totals = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return [], []
    counts = sample.select("text", "label").mapInArrow(run, schema).groupBy("term").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(F.col("pos") + F.col("neg") >= options.min_rows)
    p = (F.col("pos") + 0.5) / (n1 + 1)
    q = (F.col("neg") + 0.5) / (n0 + 1)
    gap = (p - q) / F.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0 + F.lit(1e-12))
    top = counts.select("term", gap.alias("gap"), (p / q).alias("lift")).orderBy(F.desc(F.abs("gap")), "term").limit(options.max_terms)
    rows = top.collect()
    return [r["term"] for r in rows], [i for i, r in enumerate(rows) if r["lift"] > 10]


def fit(labelled: DataFrame, options: Options = Options()) -> Model:
    """``labelled``: doc_id, text, label (0 or 1); the rows that may be learnt from."""
    spark = labelled.sparkSession
    ship_package(spark)
    known = labelled.filter("label is not null")
    total = known.count()
    draw = hash_fraction(F.lit(3), F.col("doc_id"))
    sample = cut_lineage(known.filter(draw < min(1.0, options.max_train / max(1, total))).select(
        F.xxhash64("doc_id", "text").alias("row"), "text", F.col("label").cast("int").alias("label"))
        .repartition(2 * options.folds, "row"))
    names, flagged = choose_terms(sample, options)
    if not names:
        return Model({}, [np.array([*[0.0] * i, -30.0]) for i in range(len(CATEGORIES))])
    terms = {t: i for i, t in enumerate(names)}
    schema = T.StructType.fromDDL("row long, label int, x array<float>, dense double, kinds int")
    arrow = to_arrow_schema(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([row_of(t, terms) for t in batch.column(1).to_pylist()])
            hot = x[:, flagged]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float32())),
                 pa.array(hot.sum(axis=1, dtype=np.float64)), pa.array((hot > 0).sum(axis=1).astype(np.int32))], schema=arrow)

    rows = written(sample.mapInArrow(encode, schema), "toxicity-rows")
    middle = rows.filter("label = 1").agg(F.median("dense")).first()[0] or 0.0
    toxic = F.col("label") == 1
    rows = rows.select("row", "x", F.pmod("row", F.lit(options.folds)).cast("int").alias("fold"),
                       (toxic & (F.col("dense") >= middle)).cast("int").alias("severe"),
                       (toxic & (F.col("kinds") >= options.varied_terms)).cast("int").alias("varied"),
                       F.col("label").alias("toxic"))
    n, folds, ridge, steps = len(terms), options.folds, options.ridge, options.steps
    earlier = rows.select("row", "fold", F.array().cast("array<double>").alias("before"))
    weights: list = []
    for category in CATEGORIES:
        data = rows.select("row", "x", "fold", F.col(category).alias("y")).join(earlier.select("row", "before"), "row")
        # Model i leaves out fold i and predicts it; the last model sees all rows.
        copies = data.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(folds))))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("row")
            x = np.hstack([np.stack(pdf["x"].to_numpy()).reshape(len(pdf), n),
                           np.array(pdf["before"].tolist(), np.float64).reshape(len(pdf), -1)]).astype(np.float32)
            y, model = pdf["y"].to_numpy(np.float64), int(pdf["model"].iloc[0])
            out = (pdf["fold"] == model).to_numpy()
            if (~out).any():
                w = logistic(x[~out], y[~out], ridge, steps)
            else:
                w = np.append(np.zeros(x.shape[1]), -30.0)
            p = _sigmoid(x[out] @ w[:-1] + w[-1])
            row = pd.array([*pdf["row"][out], None], dtype="Int64")  # the last row carries the weights
            return pd.DataFrame({"row": row, "p": np.append(p, 0.0), "model": model, "w": [None] * len(p) + [w]})

        fitted = written(copies.groupBy("model").applyInPandas(one, "row long, p double, model int, w array<double>"),
                         "toxicity-chain")
        weights.append(np.array(fitted.filter(f"model = {folds} and w is not null").select("w").first()[0]))
        fresh = fitted.filter(f"model < {folds} and row is not null").select("row", "p").dropDuplicates(["row"])
        earlier = written(earlier.join(fresh, "row").select("row", "fold", F.concat("before", F.array("p")).alias("before")),
                          "toxicity-before")
    # The cut with the best F1 out of fold, from a histogram of the last probabilities.
    last = F.element_at("before", -1)
    steps_of = (rows.select("row", "toxic").join(earlier, "row")
                .groupBy(F.floor(last * 100).alias("bin")).agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).collect())
    pos, every = np.zeros(101), np.zeros(101)
    for b, p, k in steps_of:
        pos[b], every[b] = p, k
    hits, told = pos[::-1].cumsum()[::-1], every[::-1].cumsum()[::-1]
    f1 = 2 * hits / np.maximum(told + pos.sum(), 1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return Model(terms, weights, float(best[len(best) // 2]) / 100 if f1.max() > 0 else 0.5)


def score(docs: DataFrame, model: Model, keep: list[str], block: int = 512) -> DataFrame:
    """Columns ``keep`` with p_severe, p_varied, p_toxic and predicted; one pass, no shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)  # at most max_terms terms
    schema = schema_of(docs, keep, ", ".join(f"p_{c} double" for c in CATEGORIES) + ", predicted int")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for s in range(0, batch.num_rows, block):
                part = batch.slice(s, block)
                x = np.stack([row_of(t, m.terms) for t in part.column(len(keep)).to_pylist()])
                p = predict(x, m.weights)
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                told = (p[:, -1] >= m.threshold).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(told)],
                                                 schema=arrow)

    return docs.select(*keep, F.col("text")).mapInArrow(run, schema)
