"""Tails against known values, exact counts and numerical integration; resampling against slow weights and plain bootstraps."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.functions import special as S
from evispark.operators import evaluation as E
from evispark.operators import resampling as RS


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def t_density_tail(t, df):
    x = np.linspace(0, abs(t), 200_001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    y = c * (1 + x * x / df) ** (-(df + 1) / 2)
    return 1 - 2 * np.trapezoid(y, x)


@pytest.mark.parametrize("t,df", [(0.0, 3), (0.5, 1), (1.0, 1), (2.0, 10), (-2.0, 10), (4.3, 2), (1.96, 1000), (0.01, 50_000), (3.0, 7)])
def test_student_tail(spark, t, df):
    assert value(spark, S.t_tail(F.lit(t), F.lit(df))) == pytest.approx(t_density_tail(t, df), abs=1e-8)


def test_known_values(spark):
    assert value(spark, S.t_tail(F.lit(1.0), F.lit(1))) == pytest.approx(0.5, abs=1e-12)
    assert value(spark, S.t_tail(F.lit(12.706204736432095), F.lit(1))) == pytest.approx(0.05, abs=1e-10)
    assert value(spark, S.t_tail(F.lit(2.2281388519649385), F.lit(10))) == pytest.approx(0.05, abs=1e-10)
    assert value(spark, S.chi_square_tail(F.lit(3.841458820694124))) == pytest.approx(0.05, abs=1e-10)
    for z in (0.0, 0.3, 1.0, 2.4, 3.5, 3.6, 6.0, 20.0):
        assert value(spark, S.normal_tail(F.lit(z))) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9, abs=1e-15)
    for x in (0.5, 1.0, 2.5, 30.0, 4000.0):
        assert value(spark, S.log_gamma(F.lit(x))) == pytest.approx(math.lgamma(x), abs=1e-9)


def test_signed_ranks_equal_all_sign_patterns(spark):
    rng = random.Random(2)
    for n in (1, 4, 9):
        d = [rng.choice([-1, 1]) * (i + 1) * 1.5 for i in range(n)] + [0.0]
        r = E.signed_rank_test(spark.createDataFrame([(x,) for x in d], "d double"), F.col("d")).first()
        sums = [sum(k for k, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
        low = min(r["w_plus"], r["w_minus"])
        assert r["method"] == "exact" and r["p"] == pytest.approx(min(1, 2 * sum(s <= low for s in sums) / 2**n))
    tied = [(1.0,)] * 30 + [(-1.0,)] * 12 + [(2.0,)] * 20 + [(-2.0,)] * 9
    r = E.signed_rank_test(spark.createDataFrame(tied, "d double"), F.col("d")).first()
    n, low = 71, 12 * 21.5 + 9 * 57.0
    dev = math.sqrt((n * (n + 1) * (2 * n + 1) - ((42**3 - 42) + (29**3 - 29)) / 2) / 24)
    assert r["method"] == "normal" and r["p"] == pytest.approx(math.erfc(abs(low - n * (n + 1) / 4) / dev / math.sqrt(2)), rel=1e-9)
    assert E.signed_rank_test(spark.createDataFrame([], "d double"), F.col("d")).first()["p"] == 1.0


def test_paired_t_edges(spark):
    def run(*d):
        return E.paired_t_test(spark.createDataFrame([(float(x),) for x in d], "d double"), F.col("d")).first()

    assert (run()["p"], run(3)["p"], run(0, 0, 0)["p"], run(2, 2)["p"]) == (1.0, 1.0, 1.0, 0.0)
    r = run(1, 2, 3, 5)
    assert r["t"] == pytest.approx(2.75 / (np.std([1, 2, 3, 5], ddof=1) / 2)) and r["p"] == pytest.approx(t_density_tail(r["t"], 3), abs=1e-8)


def slow_hash(key, replicate, seed):
    def mix(x):
        x = (x ^ x >> 16) * RS.FIRST % 2**32
        x = (x ^ x >> 15) * RS.SECOND % 2**32
        return x ^ x >> 16

    return mix((mix((key * RS.ROW + seed) % 2**32) + replicate * RS.REPLICATE) % 2**32)


def test_weights_equal_a_slow_hash_and_are_poisson(spark):
    keys = np.array([0, 1, 2, 77, 2**31 + 5])
    got = RS.weights(keys, np.arange(40), 42, "poisson")
    want = [[sum(slow_hash(int(k), r, 42) >= x for x in RS.LIMITS) for r in range(40)] for k in keys]
    assert got.tolist() == want
    many = RS.weights(np.arange(2000), np.arange(1000), 7, "poisson")
    assert abs(many.mean() - 1) < 0.003 and abs(many.var() - 1) < 0.01 and abs(np.corrcoef(many[:, 0], many[:, 1])[0, 1]) < 0.1
    assert abs(RS.weights(np.arange(2000), np.arange(1000), 7, "sign").mean()) < 0.003


def test_bootstrap_interval_is_that_of_drawing_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(2, 1, 400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double").repartition(5)
    got = E.interval(RS.bootstrap(df, "id", F.col("v"), 2000)).first()
    plain = np.percentile(x[rng.integers(0, 400, (4000, 400))].mean(1), [2.5, 97.5])
    assert got["low"] == pytest.approx(plain[0], abs=0.02) and got["high"] == pytest.approx(plain[1], abs=0.02)
    same = E.interval(RS.bootstrap(df.coalesce(1), "id", F.col("v"), 2000)).first()
    assert same["low"] == pytest.approx(got["low"], abs=1e-12)


def test_clusters_and_signs(spark):
    df = spark.createDataFrame([(i % 10, float(i % 10)) for i in range(200)], "c long, v double")
    means = {r["replicate"]: r["mean"] for r in RS.clustered(df, "c", F.col("v"), 50, 1).collect()}
    w = RS.weights(np.arange(10), np.arange(50), 1, "poisson")
    assert all(means[r] == pytest.approx((w[:, r] * np.arange(10)).sum() / w[:, r].sum()) for r in means)
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 1, 1, 1, 1, -1, 0, 0])], "id long, d double")
    got = RS.sign_flips(d, "id", F.col("d"), 4000, 5).first()
    exact = sum(abs(sum(s)) >= 4 for s in itertools.product([1, -1], repeat=6)) / 64
    assert got["observed"] == 0.5 and got["p"] == pytest.approx(exact, abs=0.03)
    flat = spark.createDataFrame([(1, 0.0)], "id long, d double")
    assert RS.sign_flips(flat, "id", F.col("d"), 100).first()["p"] == 1.0
