"""Multi-start k-means for many (k, seed) runs in the same passes over the data.

Choosing k in 3..8 with 10 restarts each is 60 independent k-means runs. Run
one at a time, each pass over the data serves one run (about 25 passes per
run, 1,500 in all). Here every pass serves all runs at once:

* seeding (k-means++): pass j draws the j-th centre of every run by D^2
  weighting. Each partition keeps its best exponential-race key per run
  (key = -log(u) / w, smallest wins, u from a hash of the row keys, run and
  step, so retries draw the same rows); a group-by over at most
  runs x partitions candidates picks the winner per run.
* Lloyd iterations: each partition assigns its rows to the nearest centre of
  every still-moving run (one matrix product against all centres) and emits
  per (run, centre) counts, coordinate sums and squared distances; a group-by
  adds them up. Only centres (runs x k x dims numbers) reach the driver.

* silhouettes: the last pass leaves count, vector sum and square sum of every
  cluster; from these one more pass scores every row for the best run of each
  k (linear squared-Euclidean form).

A run stops when its summed squared centre shift is <= tol * mean feature
variance; inertia is taken on the final centres. Empty clusters keep their
previous centre. The rows are packed once into pieces of numbers, written to
the shared checkpoint folder, so a pass turns no row into Arrow or Python
values and holds a few blocks of them, however long the table and its
partitions are. A block is worked through in slices, so that rows x centres
stay below ``_CELLS`` numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard_checkpoint, ship_package

_MASK52 = (1 << 52) - 1


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Deterministic uniforms in (0, 1) from 64-bit row hashes and a salt."""
    x = (h.astype(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
    part = np.empty_like(x)  # in place: this runs over all rows for every run and step
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= np.right_shift(x, np.uint64(shift), out=part)
        x *= np.uint64(factor)
    x ^= np.right_shift(x, np.uint64(31), out=part)
    x &= np.uint64(_MASK52)
    u = x.astype(np.float64)
    u += 0.5
    u /= float(1 << 52)
    return u


#: Distances that a task holds at a time: a few MB stay in a core's cache.
_CELLS = 1 << 18
#: Rows of a block, rows of a stored piece of it, and pieces of a batch: some 2 MB of rows are handed over at a time.
_BLOCK_ROWS = 4096
_PIECE_ROWS = 512
_PIECE_BATCH = 32


def _slices(X: np.ndarray, width: int):
    step = max(1, _CELLS // max(width, 1))
    for start in range(0, len(X), step):
        yield X[start:start + step]


def _sqdist(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    d = (X * X).sum(1)[:, None] - 2.0 * X @ C.T + (C * C).sum(1)[None, :]
    return np.maximum(d, 0.0)


def blocks(data: DataFrame, cols) -> DataFrame:
    """``_h`` and ``cols`` of up to ``_PIECE_ROWS`` rows as one row of two binary values; nothing is shuffled."""
    def pack(batches):
        for pdf in batches:
            h, X = pdf["_h"].to_numpy(np.int64), pdf[cols].to_numpy(dtype=float)
            size = min(_PIECE_ROWS, _BLOCK_ROWS)
            at = range(0, len(h), size)
            yield pd.DataFrame({"_hashes": [h[lo:lo + size].tobytes() for lo in at],
                                "_rows": [np.ascontiguousarray(X[lo:lo + size]).tobytes() for lo in at]})

    return data.mapInPandas(pack, "_hashes binary, _rows binary")


def _unpacked(batches, cols):
    """(hashes, matrix of the rows) for each block of ``_BLOCK_ROWS`` rows, or for each batch of rows that were not packed."""
    held: list = []

    def block():
        h, x = (b"".join(parts) for parts in zip(*held))
        held.clear()
        return np.frombuffer(h, np.int64), np.frombuffer(x, float).reshape(-1, len(cols))

    for pdf in batches:
        if "_rows" in pdf.columns:
            for piece in zip(pdf["_hashes"], pdf["_rows"]):
                held.append(piece)
                if sum(len(h) for h, _ in held) >= 8 * _BLOCK_ROWS:
                    yield block()
        else:
            yield pdf["_h"].to_numpy(), pdf[cols].to_numpy(dtype=float)
    if held:
        yield block()


def _alike(runs: list, centers: dict) -> list:
    """The runs in groups of equal numbers of centres: (k, runs)."""
    groups: dict = {}
    for r in runs:
        groups.setdefault(len(centers[r]), []).append(r)
    return sorted(groups.items())


def _nearest_sums(weights: np.ndarray, groups: list, rows: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """Sums of the rows of each slot; ``rows``: values, 1 and square sum of each. A row belongs to the first slot of its
    run with the smallest score. Slots are dealt by group, centre and run, so that a group is marked at once.

    ``room``: two arrays of a number for each row and slot at least, used again for each slice: fresh ones of some MB
    would go back to the system and come anew, page by page, every time."""
    shape = len(weights), len(rows)
    room = np.empty((2, shape[0] * shape[1])) if room is None else room
    scores, member = (r[:shape[0] * shape[1]].reshape(shape) for r in room)
    np.matmul(weights, rows[:, :-1].T, out=scores)
    views, at = [], 0
    for k, n_runs in groups:
        views.append((scores[at:at + k * n_runs].reshape(k, n_runs, -1), member[at:at + k * n_runs].reshape(k, n_runs, -1)))
        at += k * n_runs
    for score, mark in views:
        np.equal(score, score.min(axis=0), out=mark)
    sums, at, again = member @ rows, 0, False
    for score, mark in views:
        k, n_runs, n = score.shape
        counts = sums[at:at + k * n_runs, -2].reshape(k, n_runs).sum(axis=0)
        at += k * n_runs
        if (counts != n).any():  # equal centres, or values that are no numbers
            mark[:] = 0.0
            np.put_along_axis(mark, np.argmin(score, axis=0)[None], 1.0, axis=0)
            again = True
    return member @ rows if again else sums


class MultiKMeans:
    """Fit ``n_init`` seeded runs for every k in ``ks`` over ``df[cols]``."""

    def __init__(self, ks, n_init: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4):
        self.ks, self.n_init, self.seed, self.max_iter, self.tol = list(ks), n_init, seed, max_iter, tol
        self.runs = [(k, i) for k in self.ks for i in range(n_init)]

    # -------------------------------------------------------------- passes
    def _seed_pass(self, data: DataFrame, cols, centers: dict, step: int) -> dict:
        """Draw centre ``step`` for every run with k > step (D^2 weighting)."""
        active = [r for r, (k, _) in enumerate(self.runs) if k > step]
        prev = {r: np.asarray(centers[r]) for r in active}
        seed, d = self.seed, len(cols)

        near = {r: float((c * c).sum(1).min()) ** 0.5 for r, c in prev.items()} if step else {}

        def best(it):
            keep = {}
            for h, X in _unpacked(it, cols):
                squares = (X * X).sum(1)
                norms = np.sqrt(squares)
                for r in active:
                    u = _uniform(h, seed * 1_000_003 + r * 101 + step)
                    Y, sq = X, squares
                    if r in keep:
                        # -log(u) >= 1 - u, and no row is further from all centres than from the one next to zero: only
                        # rows below this bound can have a smaller key.
                        reach = (norms + near[r]) ** 2 if step else 1.0
                        some = np.flatnonzero(1.0 - u <= keep[r][0] * (1.0 + 1e-9) * reach)
                        if not len(some):
                            continue
                        u, Y, sq = u[some], X[some], squares[some]
                    if step == 0:
                        w = np.ones(len(Y))
                    else:
                        C = prev[r]
                        # A centre a row: the smallest of few long rows is taken faster than that of many short ones.
                        w = np.maximum((sq - 2.0 * C @ Y.T + (C * C).sum(1)[:, None]).min(axis=0), 0.0)
                    with np.errstate(divide="ignore"):
                        key = np.where(w > 0, -np.log(u) / w, np.inf)
                    i = int(np.argmin(key))
                    if np.isfinite(key[i]) and (r not in keep or key[i] < keep[r][0]):
                        keep[r] = (float(key[i]), Y[i].copy())
            if keep:
                yield pd.DataFrame({"run": list(keep), "key": [v[0] for v in keep.values()],
                                    **{f"c{j}": [v[1][j] for v in keep.values()] for j in range(d)}})

        schema = "run int, key double, " + ", ".join(f"c{j} double" for j in range(d))
        cand = data.mapInPandas(best, schema)
        win = cand.groupBy("run").agg(F.min_by(F.array(*[f"c{j}" for j in range(d)]), "key").alias("c"))
        return {int(r.run): np.asarray(r.c, dtype=float) for r in win.collect()}  # <= one row per run

    def _lloyd_pass(self, data: DataFrame, cols, centers: dict, active: list) -> dict:
        """Per (run, centre): count, coordinate sums, square sums; squared distances follow from them."""
        d = len(cols)
        alike, slots, at = _alike(active, centers), {}, 0
        for k, runs in alike:
            for i, r in enumerate(runs):
                slots[r] = at + i + np.arange(k) * len(runs)
            at += k * len(runs)
        stack, groups = np.empty((at, d)), [(k, len(runs)) for k, runs in alike]
        for r, own in slots.items():
            stack[own] = centers[r]

        # |x - c|^2 without |x|^2, which is the same for all centres: a row's nearest centre has the smallest.
        weights = np.hstack([-2.0 * stack, (stack * stack).sum(1)[:, None]])

        def partial(it):
            total, room = np.zeros((len(stack), d + 2)), np.empty((2, max(_CELLS, len(stack))))
            for _, rows in _unpacked(it, cols):
                whole = np.hstack([rows, np.ones((len(rows), 1)), (rows * rows).sum(1)[:, None]])
                for X in _slices(whole, len(stack)):
                    total += _nearest_sums(weights, groups, X, room)
            yield pd.DataFrame({"slot": np.arange(len(stack), dtype="int32"), "n": total[:, d], "sq": total[:, d + 1],
                                **{f"s{j}": total[:, j] for j in range(d)}})

        schema = "slot int, n double, sq double, " + ", ".join(f"s{j} double" for j in range(d))
        agg = data.mapInPandas(partial, schema).groupBy("slot").agg(
            F.sum("n").alias("n"), F.sum("sq").alias("sq"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(d)])
        rows = {int(r.slot): r for r in agg.collect()}  # one row per centre slot
        out = {}
        for r in active:
            mine = [rows[int(at)] for at in slots[r]]
            n = np.array([row.n for row in mine])
            s = np.array([[row[f"s{j}"] for j in range(d)] for row in mine])
            squares = np.array([row.sq for row in mine])
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centers[r])
            sq = np.maximum(squares - 2 * (s * centers[r]).sum(1) + n * (centers[r] ** 2).sum(1), 0.0)
            out[r] = (new, float(sq.sum()), (n, s, squares))
        return out

    # -------------------------------------------------------------- fit
    def fit(self, df: DataFrame, cols, id_cols) -> "MultiKMeans":
        spark = df.sparkSession
        ship_package(spark)
        # A record is a piece of rows in all passes over them.
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(key, None)
        data = df.select(F.xxhash64(*[F.col(c) for c in id_cols]).alias("_h"), *cols)
        var = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
        spark.conf.set(key, str(_BLOCK_ROWS))
        try:
            # Files, not cached: a cached partition is held in the executors' heap, whole when it goes to disk or to another.
            packed = cut_lineage(blocks(data, list(cols)))
            spark.conf.set(key, str(_PIECE_BATCH))
            self._fit(packed, cols, float(np.mean([v or 0.0 for v in var])) or 1.0)
            discard_checkpoint(packed)
            return self
        finally:
            if before is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before)

    def _fit(self, data: DataFrame, cols, scale: float) -> "MultiKMeans":
        centers = {r: [] for r in range(len(self.runs))}
        for step in range(max(self.ks)):
            drawn = self._seed_pass(data, cols, centers, step)
            for r, (k, _) in enumerate(self.runs):
                if k > step:
                    # fewer distinct points than k: repeat the last centre
                    centers[r].append(drawn[r] if r in drawn else centers[r][-1])
        centers = {r: np.vstack(c) for r, c in centers.items()}
        moving = list(range(len(self.runs)))
        self.inertia = {}
        self.n_iter = dict.fromkeys(moving, 0)
        for _ in range(self.max_iter):
            if not moving:
                break
            res = self._lloyd_pass(data, cols, centers, moving)
            still = []
            for r, (new, *_) in res.items():
                shift = float(((new - centers[r]) ** 2).sum())
                centers[r] = new
                self.n_iter[r] += 1
                if shift > self.tol * scale:
                    still.append(r)
            moving = still
        final = self._lloyd_pass(data, cols, centers, list(range(len(self.runs))))
        self.inertia = {r: v[1] for r, v in final.items()}
        self.clusters = {r: v[2] for r, v in final.items()}  # count, vector sum, square sum of each cluster
        self.centers = centers
        self.best = {}
        for k in self.ks:
            runs = [r for r, (kk, _) in enumerate(self.runs) if kk == k]
            self.best[k] = min(runs, key=lambda r: (self.inertia[r], r))
        return self

    def centers_of(self, k: int) -> np.ndarray:
        return self.centers[self.best[k]]

    def inertia_of(self, k: int) -> float:
        return self.inertia[self.best[k]]


def row_silhouettes(X: np.ndarray, centers: np.ndarray, clusters: tuple) -> np.ndarray:
    """Silhouette of each row of X in its nearest centre's cluster, by mean squared distances to whole clusters."""
    n, sums, squares = clusters
    label = np.argmin(_sqdist(X, centers), axis=1)
    rows, many = np.arange(len(X)), np.maximum(n, 1)
    mean = (X * X).sum(1)[:, None] + (squares / many)[None, :] - 2.0 * X @ (sums / many[:, None]).T
    own = n[label]
    inside = mean[rows, label] * own / np.maximum(own - 1, 1)
    mean[:, n == 0] = np.inf
    mean[rows, label] = np.inf
    outside = mean.min(axis=1)
    most = np.maximum(inside, outside)
    with np.errstate(invalid="ignore"):
        out = np.where(most > 0, (outside - inside) / most, 0.0)
    return np.where((own <= 1) | ~np.isfinite(outside), 0.0, out)


def silhouettes(df: DataFrame, cols, model: MultiKMeans) -> list[tuple]:
    """(k, mean silhouette) of the best run for each k, all in one pass; a sum and a count a task and k travel."""
    ship_package(df.sparkSession)
    best = {k: (model.centers_of(k), model.clusters[model.best[k]]) for k in model.ks}
    width = sum(2 * k for k in model.ks)

    def score(batches):
        total, rows = dict.fromkeys(best, 0.0), 0
        for pdf in batches:
            for X in _slices(pdf.to_numpy(dtype=float), width):
                rows += len(X)
                for k, (centers, clusters) in best.items():
                    total[k] += float(row_silhouettes(X, centers, clusters).sum())
        yield pd.DataFrame({"k": list(total), "total": list(total.values()), "n": [rows] * len(total)})

    sums = df.select(*cols).mapInPandas(score, "k int, total double, n long").groupBy("k").agg(
        (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean")).collect()  # a row for each k
    return sorted((r["k"], r["mean"] or 0.0) for r in sums)


def assign(df: DataFrame, cols, centers: np.ndarray, out: str = "cluster_id") -> DataFrame:
    """Nearest-centre label per row (Arrow-batched, centres are k x dims)."""
    ship_package(df.sparkSession)
    C = np.asarray(centers, dtype=float)

    @F.pandas_udf("int")
    def label(*series: pd.Series) -> pd.Series:
        X = np.column_stack([s.to_numpy(dtype=float) for s in series])
        return pd.Series(np.argmin(_sqdist(X, C), axis=1).astype("int32"))

    return df.withColumn(out, label(*[F.col(c) for c in cols]))


def centers_table(spark, model: MultiKMeans, k: int, cols) -> DataFrame:
    """The chosen centres as a small table (for saving with the other models)."""
    C = model.centers_of(k)
    return spark.createDataFrame([(i, *map(float, C[i])) for i in range(len(C))],
                                 "cluster_id int, " + ", ".join(f"{c} double" for c in cols))

