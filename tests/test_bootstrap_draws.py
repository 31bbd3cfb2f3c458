"""Draws of the bootstrap against md5 itself, in one block of values and in several."""

import hashlib

import numpy as np
import pytest

from evispark.functions import digests as D
from evispark.operators import evaluation as E


def head(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("prefix", ["", "7|3|", "5|9999|", "x" * 43])
def test_heads_equal_md5(prefix):
    seen = 0
    for low, found in D.numbered_heads(prefix.encode(), 0, 12_000):
        assert low == seen and [int(x) for x in found[::97]] == [head(f"{prefix}{low + i}") for i in range(0, len(found), 97)]
        seen += len(found)
    assert seen == 12_000


@pytest.mark.parametrize("most", [1 << 22, 37])
def test_means_equal_draws_one_by_one(spark, monkeypatch, most):
    monkeypatch.setattr(E, "DRAWS", 30)
    values = [None if i % 11 == 0 else (i * i) % 7 - 3 for i in range(100)]
    df = spark.createDataFrame(list(enumerate(values)), "pos long, v int").repartition(5)
    found = E.bootstrap_means(df, "pos", "v", 12, 7, most)
    want = {}
    for r in range(12):
        drawn = [values[head(f"7|{r}|{k}") * 100 // (1 << 32)] for k in range(100)]
        want[r] = np.mean([v for v in drawn if v is not None])
    got = {r["replicate"]: r["mean"] for r in found.collect()}
    assert set(got) == set(want) and all(abs(got[r] - want[r]) < 1e-12 for r in want)
    assert E.bootstrap_means(df.limit(0), "pos", "v", 12, 7).collect() == []


def test_no_row_for_each_draw_is_made(spark):
    """Replicates times rows were exploded, joined and shuffled, which did not end for thousands of replicates."""
    df = spark.createDataFrame([(i, i % 2) for i in range(50)], "pos long, v int")
    plan = E.bootstrap_means(df, "pos", "v", 20, 7)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan
