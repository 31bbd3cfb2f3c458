"""The sweep against all pairs, over bins of several widths, and sketches against exact figures."""

import random

import pytest
from pyspark.sql import functions as F

from evispark.operators import sketches as SK
from evispark.operators import sweep as SW


@pytest.mark.parametrize("narrowest", [True, False])
@pytest.mark.parametrize("width", [7, 64, 1 << 15])
def test_sweep_equals_all_pairs(spark, narrowest, width):
    rng = random.Random(width + narrowest)
    spans, points = [], []
    for doc in (None, "a", "b"):
        for _ in range(120):
            s = rng.randint(0, 90)
            spans.append((doc, len(spans), s, s + rng.choice([0, 1, 3, 10, 40])))
        for _ in range(80):
            s = rng.randint(0, 100)
            points.append((doc, len(points), s, s + rng.choice([0, 1, 2, 5, 20])))
    want = {}
    for doc, p, s, e in points:
        fit = [(b - a, a, i) if narrowest else (a, i) for d, i, a, b in spans if d == doc and a < b and a <= s and max(e, s + 1) <= b]
        if fit:
            want[p] = min(fit)[-1]
    a = spark.createDataFrame([*points, ("a", 999, None, 4)], "doc string, point long, start long, stop long")
    b = spark.createDataFrame([*spans, ("a", 998, None, 7)], "doc string, span long, start long, stop long")
    assert {r["point"]: r["span"] for r in SW.containing(a, b, ["doc"], narrowest, width).collect()} == want
    assert len(want) > 80


def test_one_long_document_is_dealt_into_bins(spark):
    spans = spark.range(50_000).selectExpr("1 AS doc", "id AS span", "id * 10 AS start", "id * 10 + 10 AS stop")
    points = spark.range(50_000).selectExpr("1 AS doc", "id AS point", "id * 10 + 3 AS start", "id * 10 + 5 AS stop")
    found = SW.containing(points, spans, ["doc"], width=1 << 12)
    assert found.filter("point = span").count() == 50_000


def test_sketches_of_days_add_up(spark):
    df = spark.range(60_000).selectExpr("id % 6 AS day", "id % 2 AS k", "hash(id) % 20000 AS u", "CASE WHEN id % 50 <> 0 THEN CAST(id % 1000 AS DOUBLE) END AS v")
    kept = SK.daily(df, F.col("day"), ["k"], "u", "v")
    assert kept.count() == 6
    exact = {r["k"]: (r["n"], r["u"]) for r in df.filter("day < 4").groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("u").alias("u")).collect()}
    for r in SK.merged(kept.filter("day < 4"), ["k"], [0.1, 0.5, 0.9]).collect():
        n, u = exact[r["k"]]
        assert r["n"] == n and abs(r["distinct"] - u) < 0.05 * u
        assert all(abs(q - s * 1000) < 30 for q, s in zip(r["quantiles"], (0.1, 0.5, 0.9)))
