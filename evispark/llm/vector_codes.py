"""Vector code compression: codebooks for the parts of vectors, entries found by annular norm pruning.

A vector is cut into equal parts, and each part is given the index of its codebook's nearest entry.  Entries are sorted by
norm.  As distances obey the triangle inequality, an entry nearer than the best one so far has a norm that differs from the
vector's by no more than that distance: a binary search gives this interval of entries, those of it nearest in norm are
evaluated first, and the interval shrinks with the best distance until all that it holds is evaluated.  Both ends count, so
ties are found too, and distances are exact integers.

Codebooks (parts x entries) are a model of fixed size.  Rounds of assigning and averaging are jobs over all rows; each task
adds up its rows for each entry, and the sums of all tasks are added by Spark.

Results: rows whose vector is null or holds null or non-finite components are dropped; those that stay are scaled and
floored to integers.  Vectors are filled with zeros to the length of the longest, rounded up to a multiple of the parts,
which changes no distance.  Equal vectors get equal codes; a repeated vec_id is two rows, the smaller vector first where
the codebooks start; a null vec_id comes after all others.  Components too large for 64-bit arithmetic are added up as
Python integers; errors beyond 2**63 - 1 are given as that.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, join_facts, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that are searched together, and entries on either side that are evaluated before the interval is searched anew.
BLOCK_ROWS, STRIDE = 2048, 24
#: Sums are shipped as high * 2**40 + low.
LOW_BITS = 40
MOST = (1 << 63) - 1


class Annuli:
    """A codebook's entries sorted by norm; nearest entries of many vectors at once, ties to the lower index."""

    def __init__(self, entries: np.ndarray) -> None:
        exact = (entries * entries).sum(1)
        order = np.argsort(exact.astype(np.float64), kind="stable")
        self.index = order
        self.entries = entries[order]
        self.norms = np.sqrt(exact[order].astype(np.float64))
        self.evaluated = 0

    def interval(self, norms: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries whose norms differ by no more than the best distances (squared); wide enough for rounding."""
        reach = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (norms + reach) + 1e-9
        return np.searchsorted(self.norms, norms - reach - slack, "left"), np.searchsorted(self.norms, norms + reach + slack, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row of x."""
        norms = np.sqrt((x * x).sum(1).astype(np.float64))
        at = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        best, entry = self._distances(x, np.arange(len(x)), at), self.index[at]
        # Entries begin .. end - 1 of each row are evaluated.
        begin, end = at.copy(), at + 1
        rows = np.arange(len(x))
        while len(rows):
            low, high = self.interval(norms[rows], best[rows])
            open_ = (low < begin[rows]) | (high > end[rows])
            rows, low, high = rows[open_], low[open_], high[open_]
            left = np.maximum(low, begin[rows] - STRIDE)
            right = np.minimum(high, end[rows] + STRIDE)
            for first, last in ((np.minimum(left, begin[rows]), begin[rows]), (end[rows], np.maximum(right, end[rows]))):
                self._evaluate(x, rows, first, last, best, entry)
            begin[rows] = np.minimum(left, begin[rows])
            end[rows] = np.maximum(right, end[rows])
        return entry, best

    def _distances(self, x: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        self.evaluated += len(rows)
        d = x[rows] - self.entries[places]
        return (d * d).sum(1) if d.dtype == object else np.einsum("ij,ij->i", d, d)

    def _evaluate(self, x: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray, best: np.ndarray, entry: np.ndarray) -> None:
        """Hold rows against the entries first .. last - 1 of each."""
        count = last - first
        some = count > 0
        rows, first, count = rows[some], first[some], count[some]
        if not len(rows):
            return
        starts = np.append(0, np.cumsum(count))
        places = np.repeat(first - starts[:-1], count) + np.arange(starts[-1])
        found = self._distances(x, np.repeat(rows, count), places)
        index = self.index[places]
        least = np.minimum.reduceat(found, starts[:-1])
        tied = np.where(found == np.repeat(least, count), index, len(self.index))
        lowest = np.minimum.reduceat(tied, starts[:-1])
        better = (least < best[rows]) | ((least == best[rows]) & (lowest < entry[rows]))
        best[rows[better]] = least[better]
        entry[rows[better]] = lowest[better]


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where squared distances fit, else as Python integers."""
    scaled = np.floor(values * float(scale))
    if not scaled.size or np.abs(scaled).max() < 2.0**24:
        return scaled.astype(np.int64)
    return np.array([int(v) for v in scaled.ravel()], object).reshape(scaled.shape)


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite components, which become doubles."""
    v = F.col(column)
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(fine).withColumn(column, v.cast("array<double>"))


def _matrix(col: pa.ListArray, length: int) -> np.ndarray:
    """Rows of a list column, filled with zeros."""
    sizes = np.diff(col.offsets.to_numpy())
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    out = np.zeros((len(col), length))
    out[np.repeat(np.arange(len(col)), sizes), np.arange(len(flat)) - np.repeat(np.append(0, np.cumsum(sizes))[:-1], sizes)] = flat
    return out


def _joint(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the same kind of number: floats where all sums are exact integers in them, else 64-bit or Python integers."""
    if x.dtype == object or book.dtype == object:
        return x.astype(object), book.astype(object)
    most = 2 * max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    kind = np.float64 if float(most) ** 2 * x.shape[1] < 2.0**52 else np.int64
    return x.astype(kind), book.astype(kind)


def _assigned(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], length: int) -> Iterator[tuple[pa.RecordBatch, list, list, np.ndarray]]:
    """(batch, entries by part, squared distances by part, integers) in blocks of rows."""
    part = length // len(books)
    ready: dict[tuple[int, np.dtype], Annuli] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            piece = batch.slice(at, BLOCK_ROWS)
            x = whole(_matrix(piece.column("embedding"), length))
            entries, errors = [], []
            for p, book in enumerate(books):
                own, other = _joint(x[:, p * part : (p + 1) * part], book)
                key = (p, own.dtype)
                if key not in ready:
                    ready[key] = Annuli(other)
                entry, error = ready[key].nearest(own)
                entries.append(entry)
                errors.append(error if error.dtype == object else error.astype(np.int64))
            yield piece, entries, errors, x
    give_back()


SUMS = "part int, entry int, place int, n long, high decimal(38,0), low long"


def _sums(vectors: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """Of each task: how many parts an entry has and their sums, a row for each component."""
    part, size = length // len(books), len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(books), size), np.int64)
        totals = [np.zeros((size, part), np.int64) for _ in books]
        for _, entries, _, x in _assigned(batches, books, length):
            for p, entry in enumerate(entries):
                counts[p] += np.bincount(entry, minlength=size)
                own = x[:, p * part : (p + 1) * part]
                if own.dtype == object and totals[p].dtype != object:
                    totals[p] = totals[p].astype(object)
                order = np.argsort(entry, kind="stable")
                cuts = np.flatnonzero(np.diff(entry[order], prepend=-1))
                totals[p][entry[order][cuts]] += np.add.reduceat(own[order], cuts, axis=0)
        for p in range(len(books)):
            used = np.flatnonzero(counts[p])
            flat = [int(v) for v in totals[p][used].ravel()]
            columns = [
                pa.array(np.full(len(flat), p, np.int32)), pa.array(np.repeat(used, part).astype(np.int32)), pa.array(np.tile(np.arange(part), len(used)).astype(np.int32)),
                pa.array(np.repeat(counts[p][used], part)), pa.array([Decimal(v >> LOW_BITS) for v in flat], pa.decimal128(38, 0)), pa.array([v & ((1 << LOW_BITS) - 1) for v in flat], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "n", "high", "low"])

    return vectors.select("embedding").mapInArrow(run, SUMS)


def first_books(vectors: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the vectors of the smallest ids."""
    first = vectors.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    rows = np.zeros((len(first), length))
    for row, r in zip(rows, first, strict=True):
        row[: len(r["embedding"])] = r["embedding"]
    return np.split(whole(rows), parts, axis=1)


def learn(vectors: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after some rounds; an entry that no part chose stays, others become floors of means."""
    books = first_books(vectors, length, parts, entries)
    for _ in range(rounds):
        # parts x entries x components rows, whatever the input.
        added = _sums(vectors, books, length).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
        after = [b.astype(object) for b in books]
        for r in added.collect():
            after[r["part"]][r["entry"], r["place"]] = ((int(r["high"]) << LOW_BITS) + int(r["low"])) // r["n"]
        books = [a if a.size and max(abs(int(v)) for v in a.ravel()) >= 1 << 24 else a.astype(np.int64) for a in after]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """vec_id, label, codes array<int> (an entry for each part) and error (squared distances, summed over the parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, entries, errors, _ in _assigned(batches, books, length):
            codes = np.stack(entries, 1).astype(np.int32)
            error = sum(e.astype(object) if e.dtype == object else e for e in errors)
            flat = pa.ListArray.from_arrays(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1], pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("label"), flat, pa.array([min(int(e), MOST) for e in error], pa.int64())], ["vec_id", "label", "codes", "error"])

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")


def decoded(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """codes with the integer vector that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[int(v) for book, entry in zip(books, code, strict=True) for v in book[entry]] for code in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows, pa.list_(pa.int64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "codes").mapInArrow(run, f"vec_id {codes.schema['vec_id'].dataType.simpleString()}, vector array<long>")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(codes with the errors of their labels, codebooks) of the rows with finite vectors.

    codes has vec_id, label, codes, error and label_error, the error summed over equal labels (nulls together).
    """
    fine = kept(vectors)
    longest = fine.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    length = max(-(-longest // parts), 1) * parts
    books = learn(fine, length, parts, entries, rounds)
    if not len(books[0]):
        return encode(fine, books, length).withColumn("label_error", F.lit(0).cast("long")), books
    codes = materialize(encode(fine, books, length))
    # The label as a key that is never null.
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    keyed = codes.withColumn("key", key)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(MOST)).cast("decimal(38,0)")).cast("long")
    facts = materialize(keyed.groupBy("key").agg(total.alias("label_error"), F.count("*").alias("n")))
    return join_facts(keyed, facts, "key", codes.count()).drop("key"), books
