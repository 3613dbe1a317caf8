"""Isolation forest on Spark (ML6-ML8).

Fitting: each tree takes the ``psi`` (<= 256) rows with the smallest hashes of
(row keys, tree), a state that tasks keep and merge, stable under retries and
repartitioning, and ``groupBy(tree).applyInPandas`` grows one tree per group
of exactly ``psi`` rows. The forest is a node table of at most
trees * (2 * psi - 1) rows.

Scoring is the distributed part: the bounded node arrays are broadcast and an
Arrow ``pandas_udf`` walks all trees for a whole batch at once with NumPy.
Scores follow the usual definition: s(x) = -2 ** (-E[h(x)] / c(psi)),
offset = the contamination quantile of s over the data, anomaly iff s < offset.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import cut_lineage, ship_package
from .order_stats import quantile_values

#: Rows that walk the trees together.
_SCORED_ROWS = 512
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int"


def average_path_length(n):
    """c(n): mean path length of an unsuccessful search in a BST of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def grow_tree(X: np.ndarray, rng: np.random.Generator, max_depth: int) -> list:
    """Random isolation tree: random non-constant feature, uniform threshold
    in [min, max), ``x <= t`` goes left; stops at ``max_depth`` or one row."""
    feat, thr, left, right, size = [], [], [], [], []

    def new():
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(0)
        return len(feat) - 1

    stack = [(np.arange(len(X)), 0, new())]
    while stack:
        idx, depth, node = stack.pop()
        size[node] = len(idx)
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            continue
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= t
        lnode, rnode = new(), new()
        feat[node], thr[node], left[node], right[node] = f, t, lnode, rnode
        stack.append((idx[~go_left], depth + 1, rnode))
        stack.append((idx[go_left], depth + 1, lnode))
    return [feat, thr, left, right, size]


#: Kept rows of a tree, as they travel between tasks: tree, hash of the row in that tree, hash of the row, features.
_KEPT = "tree int, key long, row long, x array<double>"


def sample_trees(df: DataFrame, feature_cols, id_cols, n_trees: int, psi: int, seed: int, rows: int) -> DataFrame:
    """``psi`` rows for each tree, those with the smallest hashes of all ``rows`` rows: ``_KEPT``, lineage cut.

    A task keeps the smallest ``psi`` hashes of its rows for each tree, whatever batches they come in; what the tasks
    kept is merged by the same rule, so the sample does not depend on the partitioning or the size of the table. Tasks
    don't hand on hashes beyond a bound below which four times as many are expected; should a tree get fewer than
    ``psi`` that way, the bound is raised, so it never changes the sample. The memory of a task is trees x psi rows.
    """
    cols = list(feature_cols)
    h = F.xxhash64(*[F.col(c) for c in id_cols], F.lit(seed))
    hashed = df.select(h.alias("row"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    share = 4.0
    while True:
        bound = min((1 << 63) - 1, int(-(1 << 63) + share * psi / max(rows, 1) * (1 << 64)))

        def keep(batches: Iterator[pd.DataFrame], bound=bound) -> Iterator[pd.DataFrame]:
            held: list = [None] * n_trees
            for batch in batches:
                if len(batch):
                    row = batch["row"].to_numpy(np.int64)
                    x = np.array(batch["x"].tolist(), dtype=float).reshape(len(row), len(cols))
                    for tree in range(n_trees):
                        held[tree] = _smallest(held[tree], _tree_key(row, tree), row, x, psi, bound)
            for tree, kept in enumerate(held):
                if kept is not None:
                    key, row, x = kept
                    yield pd.DataFrame({"tree": np.full(len(key), tree, np.int32), "key": key, "row": row, "x": list(x)})

        rank = F.row_number().over(Window.partitionBy("tree").orderBy("key", "row", "x"))
        out = cut_lineage(hashed.mapInPandas(keep, _KEPT).withColumn("_rank", rank).filter(F.col("_rank") <= psi).drop("_rank"))
        if bound == (1 << 63) - 1 or out.count() == n_trees * psi:
            return out
        share *= 4


def _smallest(held: tuple | None, key: np.ndarray, row: np.ndarray, x: np.ndarray, psi: int, bound: int) -> tuple | None:
    """The ``psi`` rows with the smallest keys, out of those held and a new batch; ties by row hash and features."""
    if held is not None and len(held[0]) == psi:
        bound = min(bound, int(held[0][-1]))
    some = np.flatnonzero(key <= bound)
    if len(some) > psi:
        some = some[key[some] <= np.partition(key[some], psi - 1)[psi - 1]]
    if not len(some):
        return held
    key, row, x = key[some], row[some], x[some]
    if held is not None:
        key, row, x = np.concatenate((held[0], key)), np.concatenate((held[1], row)), np.concatenate((held[2], x))
    order = np.lexsort((row, key))
    if (key[order][1:] == key[order][:-1]).any():
        order = np.lexsort((*x.T[::-1], row, key))
    order = order[:psi]
    return key[order], row[order], x[order]


def _tree_key(row: np.ndarray, tree: int) -> np.ndarray:
    """A hash of each row for one tree (splitmix64 of the row's hash and the tree)."""
    with np.errstate(over="ignore"):
        z = row.astype(np.uint64) + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def fit_iforest(df: DataFrame, feature_cols, id_cols, n_trees: int = K.FOREST_TREES,
                max_samples: int = K.FOREST_MAX_SAMPLES, seed: int = K.FOREST_SEED) -> tuple[DataFrame, int]:
    """Returns (node table, psi): every tree is grown from exactly psi = min(max_samples, rows) rows."""
    ship_package(df.sparkSession)
    n = df.count()
    psi = max(1, min(max_samples, n))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    members = sample_trees(df, feature_cols, id_cols, n_trees, psi, seed, n)

    def fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.assign(_x=[tuple(x) for x in pdf["x"]]).sort_values(["key", "row", "_x"])
        X = np.array(pdf["x"].tolist(), dtype=float)
        rng = np.random.default_rng([seed, tree])
        feat, thr, left, right, size = grow_tree(X, rng, max_depth)
        return pd.DataFrame({"tree": tree, "node": np.arange(len(feat), dtype="int32"),
                             "feature": feat, "threshold": thr, "left": left, "right": right,
                             "size": size})

    nodes = members.groupBy("tree").applyInPandas(fit_group, NODE_SCHEMA)
    return nodes, psi


def _forest_arrays(nodes_pdf: pd.DataFrame):
    nodes_pdf = nodes_pdf.sort_values(["tree", "node"]).reset_index(drop=True)
    counts = nodes_pdf.groupby("tree")["node"].count().sort_index()
    base = np.concatenate([[0], np.cumsum(counts.to_numpy())[:-1]]).astype(np.int64)
    tree_base = dict(zip(counts.index.to_numpy(), base))
    offs = nodes_pdf["tree"].map(tree_base).to_numpy()
    left = np.where(nodes_pdf["left"] >= 0, nodes_pdf["left"] + offs, -1)
    right = np.where(nodes_pdf["right"] >= 0, nodes_pdf["right"] + offs, -1)
    roots, feature = base, nodes_pdf["feature"].to_numpy(np.int64)
    itself, inner = np.arange(len(feature)), feature >= 0
    depth, level, at = np.zeros(len(feature)), 0, roots
    while len(at):  # the depth of every node, level by level
        depth[at] = level
        at = at[inner[at]]
        at, level = np.concatenate((left[at], right[at])), level + 1
    return {
        "roots": roots, "feature": np.where(inner, feature, 0),
        "threshold": nodes_pdf["threshold"].to_numpy(float),
        # Where a row goes from a node: right, left. A leaf is left to itself.
        "next": np.where(inner, (right, left), itself).T.ravel().astype(np.int64), "levels": level - 1,
        "length": depth + average_path_length(nodes_pdf["size"].to_numpy()),
    }


def path_lengths(X: np.ndarray, forest: dict) -> np.ndarray:
    """Mean path length over all trees for each row of X (vectorised): each step takes all rows one level down all trees."""
    m, d = X.shape
    node = np.broadcast_to(forest["roots"], (m, len(forest["roots"]))).copy()
    cells, start = np.ascontiguousarray(X).ravel(), (np.arange(m) * d)[:, None]
    cell, x, threshold = np.empty_like(node), np.empty(node.shape), np.empty(node.shape)
    for _ in range(forest["levels"]):
        np.take(forest["feature"], node, out=cell, mode="clip")
        cell += start
        np.take(cells, cell, out=x, mode="clip")
        np.take(forest["threshold"], node, out=threshold, mode="clip")
        node *= 2
        node += x <= threshold
        np.take(forest["next"], node, out=cell, mode="clip")
        node, cell = cell, node
    return forest["length"][node].mean(axis=1)


def score_samples(df: DataFrame, nodes: DataFrame, psi: int, feature_cols, out: str = "iforest_score") -> DataFrame:
    """Attach s(x) = -2 ** (-E[h(x)] / c(psi)); lower is more anomalous."""
    ship_package(df.sparkSession)
    forest = _forest_arrays(nodes.toPandas())  # bounded: trees * (2 psi - 1) rows
    bc = df.sparkSession.sparkContext.broadcast(forest)
    norm = float(average_path_length([psi])[0]) or 1.0

    @F.pandas_udf("double")
    def _score(*cols: pd.Series) -> pd.Series:
        X = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        # Rows x trees of a slice stay in a core's cache.
        parts = [path_lengths(X[lo:lo + _SCORED_ROWS], bc.value) for lo in range(0, len(X), _SCORED_ROWS)]
        return pd.Series(-np.power(2.0, -np.concatenate(parts or [np.zeros(0)]) / norm))

    return df.withColumn(out, _score(*[F.col(c) for c in feature_cols]))


def decision_scores(df: DataFrame, contamination: float = K.FOREST_CONTAMINATION,
                    score_col: str = "iforest_score") -> DataFrame:
    """ML8: offset = exact contamination quantile of the scores (one number);
    ``anomaly_score`` = score - offset; ``anomaly_prediction`` -1 below the
    offset, else 1; ``is_anomaly`` 1/0.
    """
    offset = quantile_values(df, [score_col], [contamination]).get(score_col, [0.0])[0]
    out = df.withColumn("anomaly_score", F.col(score_col) - F.lit(offset))
    out = out.withColumn("anomaly_prediction", F.when(F.col("anomaly_score") < 0, -1).otherwise(1))
    return out.withColumn("is_anomaly", (F.col("anomaly_prediction") == -1).cast("int"))
