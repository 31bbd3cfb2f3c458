"""Re-weighting grids and leave-one-entry-out evaluation of a learned arbitrator."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .relational import bounded, numbered


def weighted_grid(df: DataFrame, terms: Sequence[str], grid: DataFrame, most: int = 10_000) -> DataFrame:
    """Scores of rows under each weighting of a grid (grid_id and a weight column w_<term> for each term) of at most ``most``."""
    score = sum((F.col(t) * F.col(f"w_{t}") for t in terms), F.lit(0.0))
    return df.join(bounded(grid, most, "the grid")).withColumn("score", F.round(score, 12))


def changed_rate(predictions: DataFrame, default: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per grid_id the share of keys whose prediction differs from the default's."""
    d = default.select(*keys, F.col(value).alias("_d"))
    j = predictions.join(d, list(keys))
    return j.groupBy("grid_id").agg(F.avg((~F.col(value).eqNullSafe(F.col("_d"))).cast("double")).alias("changed"))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with intercept last, means, deviations): scaled features, balanced classes, L2 penalty 1/c; Newton steps."""
    mean, dev = x.mean(0), x.std(0)
    dev[dev == 0] = 1
    z = np.column_stack([(x - mean) / dev, np.ones(len(x))])
    weight = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    penalty = np.full(z.shape[1], 1 / c)
    penalty[-1] = 1e-9
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + penalty * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, dev


def leave_one_out(df: DataFrame, fold: str, features: Sequence[str], label: str, c: float = 1.0, most: int = 1000, steps: int = 30) -> DataFrame:
    """(fold, label, probability): each fold's rows judged by a model of all others.

    All models of at most ``most`` folds are fitted together by Newton steps.  A step is one pass over the rows: tasks add
    up gradients and Hessians, a row's for every fold but its own, and what comes to the driver has a row for each fold.
    Means, deviations and class weights of a fold's others are the totals less the fold's own.  No task holds the samples.
    """
    rows = stored(df.select(F.coalesce(F.col(fold).cast("string"), F.lit("")).alias("fold"), F.col(label).cast("double").alias("y"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features))))
    d, names = len(features), [f"x{i}" for i in range(len(features))]
    own = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), *(F.sum(x).alias(f"s_{x}") for x in names), *(F.sum(F.col(x) * F.col(x)).alias(f"q_{x}") for x in names))
    bounded(own.select("fold"), most, "the set of folds")
    sums = own.orderBy("fold").collect()
    if not sums:
        return rows.select("fold", F.col("y").alias("label"), F.lit(0.5).alias("probability"))
    place = {r["fold"]: i for i, r in enumerate(sums)}
    table = np.array([[r["n"], r["pos"], *(r[f"s_{x}"] for x in names), *(r[f"q_{x}"] for x in names)] for r in sums], float)
    others = table.sum(0) - table
    n, pos = np.maximum(others[:, 0], 1), others[:, 1]
    mean = others[:, 2 : 2 + d] / n[:, None]
    dev = np.sqrt(np.maximum(others[:, 2 + d :] / n[:, None] - mean**2, 0))
    dev[dev < 1e-12] = 1
    weight = np.stack([others[:, 0] / (2 * np.maximum(others[:, 0] - pos, 1)), others[:, 0] / (2 * np.maximum(pos, 1))], 1)
    penalty = np.append(np.full(d, 1 / c), 1e-9)
    w = np.zeros((len(sums), d + 1))
    plain = (pos == 0) | (pos == others[:, 0])  # one class only: no model
    open_ = ~plain

    def scaled(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.stack([batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(d)], 1)
        z = (x[:, None, :] - mean[None]) / dev[None]
        return np.array([place[f] for f in batch.column("fold").to_pylist()]), batch.column("y").to_numpy(zero_copy_only=False), np.concatenate([z, np.ones((*z.shape[:2], 1))], 2)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, 4_000_000 // (len(sums) * (d + 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield batch.slice(at, size)

    for _ in range(steps):
        if not open_.any():
            break

        def gradients(batches: Iterator[pa.RecordBatch], w: np.ndarray = w.copy()) -> Iterator[pa.RecordBatch]:
            g, h = np.zeros((len(w), d + 1)), np.zeros((len(w), d + 1, d + 1))
            for batch in pieces(batches):
                at, y, z = scaled(batch)
                p = 1 / (1 + np.exp(-np.clip(np.einsum("nfd,fd->nf", z, w), -30, 30)))
                share = weight[:, y.astype(int)].T * (at[:, None] != np.arange(len(w))[None])
                g += np.einsum("nf,nfd->fd", share * (p - y[:, None]), z)
                h += np.einsum("nf,nfd,nfe->fde", share * p * (1 - p), z, z, optimize=True)
            flat = np.concatenate([g, h.reshape(len(w), -1)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(w)), flat.shape[1])), pa.array(np.tile(np.arange(flat.shape[1]), len(w))), pa.array(flat.ravel())], ["f", "i", "v"])

        total = np.zeros((len(sums), (d + 1) * (d + 2)))
        for r in rows.mapInArrow(gradients, "f long, i long, v double").groupBy("f", "i").agg(F.sum("v").alias("v")).collect():
            total[r["f"], r["i"]] = r["v"]
        grad, hess = total[:, : d + 1] + penalty * w, total[:, d + 1 :].reshape(-1, d + 1, d + 1) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        w[open_] -= step[open_]
        open_ &= np.abs(step).max(1) >= 1e-8
    base = np.where(others[:, 0] > 0, pos / n, 0.5)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(d)], 1)
            at = np.array([place[f] for f in batch.column("fold").to_pylist()], int)
            margin = ((x - mean[at]) / dev[at] * w[at, :-1]).sum(1) + w[at, -1]
            p = np.where(plain[at], base[at], 1 / (1 + np.exp(-margin)))
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("y"), pa.array(p)], ["fold", "label", "probability"])

    return rows.mapInArrow(judge, "fold string, label double, probability double")


def clustered_bootstrap(df: DataFrame, cluster: str, delta: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, mean): clusters are drawn with replacement; each counts as often as it is drawn, whole."""
    from .evaluation import unit_hash

    sums = df.groupBy(cluster).agg(F.sum(delta).alias("s"), F.count("*").alias("n"))
    k = sums.count()
    draws = df.sparkSession.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(max(k - 1, 0)))).alias("draw"))
    picked = draws.withColumn("pos", F.floor(unit_hash(F.lit(seed), F.col("replicate"), F.col("draw")) * k).cast("long"))
    return picked.join(numbered(sums, [cluster], "pos"), "pos").groupBy("replicate").agg((F.sum("s") / F.sum("n")).alias("mean"))
