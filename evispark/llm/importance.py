"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k.

Words and word pairs of every document are hashed to buckets; bucket counts over all texts make the raw model, counts
over labelled good texts the target model.  A document's weight is the log ratio of both models summed over its
n-grams.  Sampling k documents without replacement in proportion to (tempered) weights is taking the k largest of
weight / temperature + Gumbel noise.  Noise comes from a hash of the id, so a task that runs again draws the same.

k is a parameter, or else ``share`` of the documents that have words; by default that is all but CAUGHT of the share of
labelled documents that are not good, so a cleaner corpus loses less.  The k-th largest key is found by counting keys in
ever finer ranges; no sort of the table, and no document list on the driver.

Results: null, empty and blank texts have weight 0 and no n-grams; they are never sampled.  Equal keys at the limit are
all taken.  Repeated rows share their noise and their verdict.  Rows without doc_id share one noise.  Without labelled
good texts nothing is rejected but texts without words.  A text longer than a block is a block by itself, weighed whole.
An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SpanHashes, buffer_of, materialize, mix, slices

#: Bits of a bucket number: a table of counts for tokens, one for token pairs and one for token beginnings.
WORD_BITS, PAIR_BITS = 17, 16
SIZE = (1 << WORD_BITS) + 2 * (1 << PAIR_BITS)
TABLES = (slice(0, 1 << WORD_BITS), slice(1 << WORD_BITS, (1 << WORD_BITS) + (1 << PAIR_BITS)), slice((1 << WORD_BITS) + (1 << PAIR_BITS), SIZE))
#: Bytes of a token's beginning.
BEGINNING = 6
#: Counts go to the reducers in so many parts; bytes of text in a block.
PARTS, BLOCK_BYTES = 64, 1 << 20
PART = SIZE // PARTS
#: Labelled documents from which the target model is learned at most; how much of the labelled share of documents that are
#: not good is left out.
MAX_LABELLED, CAUGHT = 40_000, 0.6


LETTER = np.zeros(256, bool)
LETTER[0x30:0x3A] = LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of the distinct n-grams of each document of a block: tokens, token pairs and token beginnings.

    Tokens are runs of letters and digits, or of other characters but white space; A-Z are lower-cased; nothing crosses
    documents.  An n-gram counts once in a document, so one that repeats itself does not stand for many.
    """
    low = raw + ((raw >= 0x41) & (raw <= 0x5A)).astype(np.uint8) * np.uint8(32)
    kind = np.where(SPACE[low], 0, np.where(LETTER[low], 1, 2)).astype(np.int8)
    change = np.ones(len(low) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    full = kind[at[:-1]] > 0
    start, end = at[:-1][full], at[1:][full]
    doc = np.searchsorted(offsets, start, side="right") - 1
    if not len(start):
        return np.zeros(0, np.int64), doc
    hashed = SpanHashes(low)
    word = hashed(start, end)
    inside = doc[1:] == doc[:-1]
    # A token and itself again is one and the same pair, whatever the token.
    pair = np.where(word[:-1] == word[1:], mix(np.ones(1, np.uint64)), mix(word[:-1] * np.uint64(3) + word[1:]))[inside]
    longer = end - start > BEGINNING
    begins = hashed(start[longer], start[longer] + BEGINNING)
    parts, base = [], 0
    for hashes, docs, bits in ((word, doc, WORD_BITS), (pair, doc[1:][inside], PAIR_BITS), (begins, doc[longer], PAIR_BITS)):
        parts.append(docs * SIZE + base + (hashes >> np.uint64(64 - bits)).astype(np.int64))
        base += 1 << bits
    both = np.sort(np.concatenate(parts))
    both = both[np.append(True, both[1:] != both[:-1])]
    docs = both // SIZE
    return both - docs * SIZE, docs


def gram_counts(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket in the texts of df (text, good), and in those of them that are good.

    Every task adds up its own, reducers add the tasks'; what comes to the driver has a size fixed by the buckets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE), np.int64)
        for b in slices(batches, "text", block_bytes, "spans"):
            bucket, doc = grams(*buffer_of(b.column("text")))
            total[0] += np.bincount(bucket, minlength=SIZE)
            good = b.column("good").fill_null(False).to_numpy(zero_copy_only=False)
            if good.any():
                total[1] += np.bincount(bucket[good[doc]], minlength=SIZE)
        # Buckets that the task saw, and their counts: a task of few texts sends little.
        used = [np.flatnonzero(total[0, i : i + PART]) for i in range(0, SIZE, PART)]
        parts = [i for i in range(PARTS) if len(used[i])]
        if parts:
            places = [used[i].astype("<i4").tobytes() for i in parts]
            data = [total[:, i * PART + used[i]].astype("<i8").tobytes() for i in parts]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(places, pa.binary()), pa.array(data, pa.binary())], ["part", "places", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for part, places, data in zip(*(b.column(c).to_pylist() for c in ("part", "places", "data")), strict=True):
                at = np.frombuffer(places, "<i4")
                totals.setdefault(part, np.zeros((2, PART), np.int64))[:, at] += np.frombuffer(data, "<i8").reshape(2, -1)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in totals.values()], pa.binary())], ["part", "data"])

    kind = "part int, data binary"
    out = np.zeros((2, SIZE), np.int64)
    for r in df.select("text", "good").mapInArrow(count, "part int, places binary, data binary").repartition(F.col("part")).mapInArrow(add, kind).collect():
        out[:, r["part"] * PART : (r["part"] + 1) * PART] += np.frombuffer(r["data"], "<i8").reshape(2, PART)
    return out[0], out[1]


def log_ratios(target: np.ndarray, raw: np.ndarray, rare: float = 0.001, wide: float = 4.0, narrow: float = 0.005, burst: float = 3.0) -> np.ndarray:
    """log p_target / p_raw of each bucket, smoothed: the mean of what it may be, given both counts.

    An observed log ratio varies by ``burst`` times what independent n-grams would (documents repeat themselves) around
    the true one, which has variance ``narrow`` in most buckets and ``wide`` in a ``rare`` share of them.  So buckets with
    little evidence stay near 0 without being cut off, and those whose ratio is beyond doubt keep it.
    """
    out = np.zeros(SIZE)
    for part in TABLES:
        r, t = raw[part].astype(float), target[part].astype(float)
        expected = r * (t.sum() / max(r.sum(), 1.0))
        ratio = np.log((t + 0.5) / (expected + 0.5))
        error = burst / (expected + 0.5)
        a, b = error + wide, error + narrow
        odds = rare / (1 - rare) * np.sqrt(b / a) * np.exp(np.minimum(ratio**2 / 2 * (1 / b - 1 / a), 50.0))
        real = odds / (1 + odds)
        out[part] = ratio * (real * wide / a + (1 - real) * narrow / b)
    return out


def weights(raw: np.ndarray, offsets: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, summed log ratio) of each document of a block."""
    bucket, doc = grams(raw, offsets)
    n = np.bincount(doc, minlength=len(offsets) - 1).astype(np.int64)
    return n, np.bincount(doc, ratios[bucket], len(offsets) - 1).astype(float)


def weigh(df: DataFrame, ratios: np.ndarray, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_grams long, log_weight double), a row for each row of df."""
    shared = df.sparkSession.sparkContext.broadcast(ratios)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", block_bytes, "spans"):
            n, total = weights(*buffer_of(b.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(total)], ["doc_id", "n_grams", "log_weight"])

    return df.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def kth_largest(df: DataFrame, column: str, k: int, ways: int = 4096) -> float:
    """The k-th largest value of a column, by counting values in ever finer ranges between the smallest and largest."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None or k <= 0:
        return float("inf")
    above = 0
    while True:
        step = (hi - lo) / ways
        if not step or lo + step == lo:
            return lo
        inside = df.filter((F.col(column) >= lo) & (F.col(column) <= hi))
        cell = F.least(F.floor((F.col(column) - lo) / step), F.lit(ways - 1))
        counts = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["cell"]):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
        else:
            return lo
        if lo == hi:
            return lo


def gumbel(column: str):
    """Standard Gumbel noise from a hash of a column."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit("gumbel")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


@dataclass
class Sampler:
    """Log ratios of the buckets, and the smallest key that is sampled."""

    ratios: np.ndarray
    temperature: float
    limit: float


def fit(df: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, temperature: float = 1.0, max_labelled: int = MAX_LABELLED, block_bytes: int = BLOCK_BYTES, caught: float = CAUGHT) -> tuple[Sampler, DataFrame]:
    """The sampler for df, and what it weighed: doc_id, n_grams, log_weight, gumbel_key, a row for each row of df.

    Without k and share, k leaves out ``caught`` of the labelled share of documents that are not good.
    """
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("quality"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    marked = F.broadcast(chosen.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")))  # at most max_labelled rows
    raw, target = gram_counts(df.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").join(marked, "doc_id", "left"), block_bytes)
    ratios = log_ratios(target, raw) if target.any() else np.zeros(SIZE)
    weighed = materialize(weigh(df, ratios, block_bytes).withColumn("gumbel_key", F.col("log_weight") / temperature + gumbel("doc_id")))
    with_words = weighed.filter("n_grams > 0")
    if k is None:
        if share is None:
            share = 1 - caught * (chosen.agg(F.avg(((F.col("quality") != 1) | (F.col("toxic") != 0)).cast("double"))).first()[0] or 0.0)
        k = round((share if target.any() else 1.0) * with_words.count())
    return Sampler(ratios, temperature, kth_largest(with_words, "gumbel_key", k)), weighed


def resample(df: DataFrame, labels: DataFrame, **sampling) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key and kept, a row for each row of df; ``sampling`` as for :func:`fit`."""
    sampler, weighed = fit(df, labels, **sampling)
    return weighed.withColumn("kept", (F.col("n_grams") > 0) & (F.col("gumbel_key") >= F.lit(sampler.limit)))


def sampled(df: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES, **sampling) -> DataFrame:
    """The rows of df, with all their columns, that are sampled; texts are weighed again where they stand, not shuffled."""
    sampler, _ = fit(df, labels, block_bytes=block_bytes, **sampling)
    shared = df.sparkSession.sparkContext.broadcast(sampler)
    noise = f"noise_{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in slices(batches, "text", block_bytes, "spans"):
            n, total = weights(*buffer_of(b.column("text")), s.ratios)
            keys = total / s.temperature + b.column(noise).to_numpy()
            yield b.filter(pa.array((n > 0) & (keys >= s.limit))).drop_columns([noise])

    return df.withColumn(noise, gumbel("doc_id")).mapInArrow(run, df.schema)
