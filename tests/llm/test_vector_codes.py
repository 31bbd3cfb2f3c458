"""Codebooks and codes against brute force in Python integers; the annuli against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from evispark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = max(-(-longest // parts), 1)
    cut = [[(v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), n) for n, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        chosen = assign()
        for p in range(parts):
            for n in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, chosen) if a[p][1] == n]
                if mine:
                    books[p][n] = [sum(col) // len(mine) for col in zip(*mine)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    chosen = assign()
    errors = [sum(d for d, _ in a) for a in chosen]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    most = (1 << 63) - 1
    return sorted((repr(i), [n for _, n in a], min(e, most), min(by_label[label], most)) for (i, _, label), a, e in zip(kept, chosen, errors)), sha


def got(spark, rows, **how):
    found, books = vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), **how)
    return sorted((repr(r["vec_id"]), r["codes"], r["error"], r["label_error"]) for r in found.collect()), vc.digest(books)


def some_rows(seed, n, length=8, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(length)], rng.choice([None, 0, 1, 2])) for i in range(n)]
    same = [(n + i, rows[3][1], 1) for i in range(n // 3)]
    grid = [(2 * n + i, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(length)], None) for i in range(n // 2)]
    odd = [(None, rows[0][1], 0), (5, rows[1][1], None), (-7, None, 1), (-8, [float("nan")] * length, 1), (-9, [None] * length, 1), (-10, [float("-inf")] * length, 1)]
    return rows + same + grid + odd


@pytest.mark.parametrize("n,entries", [(40, 256), (300, 32), (300, 7)])
def test_codes_equal_brute_force(spark, n, entries):
    rows = some_rows(n, n)
    assert got(spark, rows, entries=entries) == slow(rows, entries=entries)


def test_other_lengths_and_large_components(spark):
    rows = some_rows(1, 30, length=6) + [(900, [1.5, -2.0], 1), (901, [], 2), (902, [float(np.float32(3e30))] * 9, 2), (903, [float(np.float32(3.4e38)), -1.0], None), (904, [40000.0] * 4, 3)]
    assert got(spark, rows, entries=16) == slow(rows, entries=16)


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    assert vc.compress(spark.createDataFrame([], SCHEMA))[0].collect() == []
    rows = some_rows(2, 20)
    extra = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in ("key", "codes", "n", "error", "label_error", "part")))
    found, books = vc.compress(extra)
    assert (sorted((repr(r["vec_id"]), r["codes"], r["error"], r["label_error"]) for r in found.collect()), vc.digest(books)) == slow(rows)


def test_annuli_find_the_nearest_and_evaluate_fewer():
    rng = np.random.default_rng(4)
    book = rng.integers(-400, 400, (256, 16)) * rng.integers(1, 9, (256, 1))
    book[9] = book[3]  # ties
    far = rng.integers(-400, 400, (3000, 16)) * rng.integers(1, 9, (3000, 1))
    near = book[rng.integers(0, 256, 3000)] + rng.integers(-9, 10, (3000, 16)) * (rng.random((3000, 1)) < 0.9)
    for x, share in ((far, 0.8), (near, 0.1)):
        index = vc.Annuli(book)
        entry, best = index.nearest(x)
        d = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (entry == d.argmin(1)).all() and (best == d.min(1)).all()
        assert index.evaluated < share * d.size


def test_decoded_vectors_have_the_errors(spark):
    rows = some_rows(6, 40)
    found, books = vc.compress(spark.createDataFrame(rows, SCHEMA), entries=8)
    vectors = {r["vec_id"]: r["vector"] for r in vc.decoded(found.filter("vec_id < 40 AND vec_id <> 5"), books).collect()}
    errors = {r["vec_id"]: r["error"] for r in found.collect()}
    for i, v, _ in rows[:40]:
        if i != 5:
            assert sum((math.floor(1024 * x) - y) ** 2 for x, y in zip(v, vectors[i])) == errors[i]
