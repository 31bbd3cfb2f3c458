"""Bootstraps and sign-flip tests in one pass: every row has a weight for each replicate, made where the row stands.

A weight is a function of the row's id, the replicate and the seed, so neither partitions nor retries change it.  Each task
adds up its rows for all replicates; only these sums, one row for each replicate, are shuffled.  Nothing pairs rows with
replicates, and time grows with rows times replicates in numpy, memory with one block of them.

The bootstrap draws Poisson(1) weights, the limit of drawing rows with replacement: a replicate's size varies about the
sample's, and its mean divides by the weights' sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Odd multipliers and shifts of the weights' 32-bit hash.
ROW, REPLICATE, FIRST, SECOND = 0x9E3779B1, 0x85EBCA77, 0x7FEB352D, 0x846CA68B
#: A hash from the k-th limit on is a Poisson(1) draw of more than k.
LIMITS = [int((1 << 32) * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
#: Rows and replicates that a step takes together.
ROWS, TOGETHER = 512, 1024


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(FIRST)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(SECOND)
    return x ^ (x >> np.uint32(16))


def weights(keys: np.ndarray, replicates: np.ndarray, seed: int, kind: str) -> np.ndarray:
    """A row for each key and a column for each replicate: Poisson draws or signs."""
    own = _mix(((keys.astype(np.uint64) * np.uint64(ROW) + np.uint64(seed)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    h = _mix(own[:, None] + (replicates.astype(np.uint64) * np.uint64(REPLICATE)).astype(np.uint32)[None, :])
    if kind == "sign":
        return np.where(h >> np.uint32(31), 1.0, -1.0)
    out = np.zeros(h.shape, np.uint8)
    for limit in LIMITS:
        out += h >= np.uint32(limit)
    return out.astype(np.float64)


def weighted_sums(df: DataFrame, key: str, values: Sequence[str], replicates: int, seed: int, kind: str) -> DataFrame:
    """(replicate, w, and the weighted sum of each value) over rows (key long); w adds up the weights.  Null values count as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((replicates, len(values) + 1)), False
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.stack([np.ones(len(keys)), *(batch.column(i + 1).fill_null(0).to_numpy(zero_copy_only=False) for i in range(len(values)))], 1)
            seen = seen or len(keys) > 0
            for at in range(0, len(keys), ROWS):
                for r in range(0, replicates, TOGETHER):
                    some = np.arange(r, min(r + TOGETHER, replicates))
                    sums[some] += weights(keys[at : at + ROWS], some, seed, kind).T @ x[at : at + ROWS]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), *(pa.array(sums[:, i]) for i in range(sums.shape[1]))], ["replicate", "w", *values])

    schema = "replicate long, w double, " + ", ".join(f"`{v}` double" for v in values)
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long"), *(F.col(v).cast("double") for v in values))
    partial = rows.mapInArrow(run, schema)
    return partial.groupBy("replicate").agg(F.sum("w").alias("w"), *(F.sum(v).alias(v) for v in values))


def bootstrap(df: DataFrame, key: str, value: Column, replicates: int = 5000, seed: int = 42) -> DataFrame:
    """(replicate, mean) of a value's mean, or of a mean difference."""
    sums = weighted_sums(df.select(key, value.alias("s")), key, ["s"], replicates, seed, "poisson")
    return sums.filter("w > 0").select("replicate", (F.col("s") / F.col("w")).alias("mean"))


def clustered(df: DataFrame, cluster: str, value: Column, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """(replicate, mean) where whole clusters (long) are drawn: each counts with all its rows."""
    sums = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = weighted_sums(sums, cluster, ["s", "n"], replicates, seed, "poisson")
    return drawn.filter("n > 0").select("replicate", (F.col("s") / F.col("n")).alias("mean"))


def sign_flips(df: DataFrame, key: str, delta: Column, permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """n, observed mean difference and two-sided p of the sign-flip test, with the +1 correction."""
    rows = df.select(key, delta.alias("s")).filter("s IS NOT NULL")
    seen = rows.agg(F.count("*").alias("n"), F.sum("s").cast("double").alias("total"))
    # Differences of 0 have no sign.
    sums = weighted_sums(rows.filter("s <> 0"), key, ["s"], permutations, seed, "sign")
    flipped = sums.agg(F.collect_list("s").alias("sums"))  # as many as permutations
    joined = seen.join(flipped)
    zero = permutations - F.size("sums")  # without a difference every flip is 0, as is the total
    hits = zero + F.size(F.filter("sums", lambda s: F.abs(s) >= F.abs(F.col("total")) - 1e-9))
    return joined.select("n", (F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("observed"), ((hits + 1) / (permutations + 1)).alias("p"))
