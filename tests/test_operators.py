import pandas as pd
import pytest
from pyspark.sql import functions as F

from evispark.operators import evaluation as E
from evispark.operators import graph as G
from evispark.operators import matching as M
from evispark.operators import ordered as O
from evispark.operators import relational as R
from evispark.streaming import health as S


def test_any_key_dedupe_is_no_closure(spark):
    df = spark.createDataFrame([("g", 0, "a", None), ("g", 1, "a", "t"), ("g", 2, None, "t"), ("g", 3, None, None), ("h", 0, "a", "t")], "g string, pos int, doi string, title string")
    got = {(r["g"], r["pos"]) for r in O.dedupe_any_key(df, "g", "pos", ["doi", "title"]).collect()}
    assert got == {("g", 0), ("g", 2), ("g", 3), ("h", 0)}


def test_adjacent_dedupe_keeps_the_longer(spark):
    df = spark.createDataFrame([(1, 0, "a b c d"), (1, 1, "a b c d extra"), (1, 2, "other"), (1, 3, "a b c d")], "d int, pos int, t string")
    assert [r["pos"] for r in O.dedupe_adjacent(df, "d", "pos", "t").orderBy("pos").collect()] == [1, 2, 3]


def test_merge_facts(spark):
    df = spark.createDataFrame([("k", 0, 0.5, None), ("k", 1, 0.9, "s1"), ("k", 2, 0.1, "s2"), ("k", 3, 0.95, None)], "k string, pos int, conf double, src string")
    rows = [tuple(r) for r in O.merge_facts(df, ["k"], "pos", "conf", "src").collect()]
    assert rows == [("k", 3, 0.95, "s1")]


def test_canonical_fold_follows_arrival(spark):
    df = spark.createDataFrame([("i", 0, "found", 0.5, "x"), ("i", 1, "found", 0.9, "y"), ("j", 0, "found", 0.5, "x"), ("j", 1, "ocr_gap", 1.0, "x"), ("k", 0, "not_found", None, None), ("k", 1, "not_found", 0.0, None)], "id string, pos int, status string, conf double, text string")
    got = {r["id"]: (r["pos"], r["conflict_flag"]) for r in R.canonical_fold(df, ["id"], "pos", "status", "conf", "text").collect()}
    assert got == {"i": (1, False), "j": (0, True), "k": (0, False)}


def test_relational_small_cases(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    assert R.null_safe_join(df, df.groupBy("k").agg(F.count("*").alias("n")), ["k"]).filter("n = 2").count() == 2
    assert R.owned_by(df, None, "k").count() == 2 and R.owned_by(df, "a", "k").count() == 1
    rows = spark.createDataFrame([("g", True, False), ("g", False, True), ("h", True, False), (None, True, True)], "g string, a boolean, b boolean")
    assert {r["g"] for r in R.incomplete_groups(rows, "g", F.col("a"), F.col("b")).collect()} == {"h", None}
    empty = df.limit(0)
    assert R.top_one(empty, ["k"], [F.asc("v")]).count() == 0 and R.upsert(empty, df, ["k"], [F.desc("v")]).count() == 2


@pytest.mark.parametrize("definition,want", [("wrong_is_fp", (1, 3, 1)), ("wrong_is_both", (1, 3, 2)), ("extracted", (1, 1, 2)), ("adjudicated", (1, 2, 2))])
def test_field_outcomes(spark, definition, want):
    df = spark.createDataFrame([("e", "exact", 0), ("e", "wrong_value", 2), ("e", "missing", 0)], "entry string, match_type string, extra int")
    r = E.field_outcomes(df, ["entry"], definition).first()
    assert (r["tp"], r["fp"], r["fn"]) == want


def test_mcnemar_exact(spark):
    df = spark.createDataFrame([(True, False)] * 1 + [(False, True)] * 9, "a boolean, b boolean")
    r = E.mcnemar(df, F.col("a"), F.col("b")).first()
    assert (r["b"], r["c"]) == (1, 9) and abs(r["p_exact"] - 0.021484) < 1e-6


def test_interval_and_nearest_joins_equal_brute_force(spark):
    import random

    rng = random.Random(0)
    a = [(i, s := rng.randint(0, 200), s + rng.randint(1, 40)) for i in range(40)]
    b = [(i, s := rng.randint(0, 200), s + rng.randint(1, 40)) for i in range(40)]
    A, B = spark.createDataFrame(a, "i long, s long, e long"), spark.createDataFrame(b, "j long, x long, y long")
    got = sorted((r["i"], r["j"]) for r in M.interval_join(A, B, 16, ("s", "e"), ("x", "y")).collect())
    assert got == sorted((i, j) for i, s, e in a for j, x, y in b if s < y and x < e)
    near = {r["i"]: (r["distance"], r["nearest"]) for r in M.nearest(A.withColumn("k", F.lit(1)), B.withColumn("k", F.lit(1)), ["k"], "s", "x", "j").collect()}
    assert near == {i: min((abs(s - x), j) for j, x, _ in b) for i, s, _ in a}


def test_cycles_in_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    closure = {(r["node"], r["ancestor"]): r["depth"] for r in G.ancestors(e).collect()}
    assert closure[1, 4] == 3 and closure[1, 1] == 3 and (4, 1) not in closure
    pairs = spark.createDataFrame([(4, 4), (1, 4), (4, 1)], "node long, ancestor long")
    assert {(r[0], r[1]): r[2] for r in G.is_descendant(pairs, G.ancestors(e)).collect()} == {(4, 4): True, (1, 4): True, (4, 1): False}


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [(1, "queued", 1), (1, "running", 2), (1, "completed", 3), (1, "running", 4), (2, "running", 1), (2, "failed", 2), (2, "completed", 3)]
    spark.createDataFrame(rows, "job_id long, status string, ts long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id long, status string, ts long").parquet(str(tmp_path / "in"))
    q = S.job_states(stream).writeStream.format("memory").queryName("jobs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    got = sorted((r["job_id"], r["status"], r["accepted"]) for r in spark.table("jobs").collect())
    assert got == sorted([(1, "queued", True), (1, "running", True), (1, "completed", True), (1, "running", False), (2, "running", True), (2, "failed", True), (2, "completed", False)])
    calls = pd.DataFrame({"provider": ["p"] * 5, "ts": pd.to_datetime(["2024-01-01 00:01", "2024-01-01 00:20", "2024-01-01 00:50", "2024-01-01 02:30", "2024-01-01 05:00"]), "success": [True, False, False, True, True]})
    spark.createDataFrame(calls).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema("provider string, ts timestamp, success boolean").parquet(str(tmp_path / "calls"))
    q = S.streaming_stats(stream, "1 hour").writeStream.format("memory").queryName("health").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    batch = spark.read.parquet(str(tmp_path / "calls")).groupBy("provider", F.window("ts", "3600 seconds", "1 hour").alias("win")).agg(F.count_if("success").alias("s"), F.count_if(~F.col("success")).alias("f"))
    want = {(r["win"]["start"], r["s"], r["f"]) for r in batch.collect()}
    closed = {(r["win"]["start"], r["successes"], r["failures"]) for r in spark.table("health").collect()}
    assert closed and closed <= want


def test_logistic_separates_and_folds_are_held_out(spark):
    import numpy as np

    from evispark.operators import learning as N

    rng = np.random.default_rng(0)
    rows = [(f"f{i % 4}", float(a), float(b), int(a + 0.2 * b > 0)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "fold string, a double, b double, y int")
    got = N.leave_one_out(df, "fold", ["a", "b"], "y").toPandas()
    assert len(got) == 200 and ((got.probability > 0.5) == (got.label > 0.5)).mean() > 0.9
    grid = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 1.0)], "grid_id int, w_a double, w_b double")
    assert N.weighted_grid(df, ["a", "b"], grid).filter("grid_id = 1 AND abs(score - b) > 1e-9").count() == 0


def test_folds_fitted_together_equal_folds_fitted_alone(spark):
    import numpy as np

    from evispark.operators import learning as N

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.1]
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=300) > 0.4).astype(int)
    folds = [f"f{i}" for i in np.where(np.arange(300) % 3 == 0, 0, rng.integers(1, 7, 300))]  # one fold has a third of all rows
    df = spark.createDataFrame([(f, *map(float, row), int(v)) for f, row, v in zip(folds, x, y)], "fold string, a double, b double, c double, y int").repartition(5)
    got = {}
    for r in N.leave_one_out(df, "fold", ["a", "b", "c"], "y").collect():
        got.setdefault(r["fold"], []).append(r["probability"])
    for f in set(folds):
        held = np.array([g == f for g in folds])
        w, mean, dev = N.fit_logistic(x[~held], y[~held].astype(float))
        p = 1 / (1 + np.exp(-((x[held] - mean) / dev @ w[:-1] + w[-1])))
        assert np.allclose(np.sort(got[f]), np.sort(p), atol=1e-6)
    one = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1), ("b", 3.0, 1)], "fold string, a double, y int")
    assert {r["probability"] for r in N.leave_one_out(one, "fold", ["a"], "y").collect()} == {1.0}
    assert N.leave_one_out(one.limit(0), "fold", ["a"], "y").collect() == []


def test_change_rate(spark):
    from evispark.operators import learning as N

    p = spark.createDataFrame([(0, "k", "x"), (0, "l", None), (1, "k", "y"), (1, "l", None)], "grid_id int, k string, v string")
    got = {r["grid_id"]: r["changed"] for r in N.changed_rate(p, p.filter("grid_id = 0"), ["k"], "v").collect()}
    assert got == {0: 0.0, 1: 0.5}


def test_running_totals_and_bounds(spark):
    import pytest

    from evispark.operators import relational as R

    df = spark.createDataFrame([((i * 37) % 101, i % 5, 0.5 * (i % 3)) for i in range(101)], "k int, v int, x double")
    rows = sorted((r["k"], r["pos"], r["v"]) for r in R.numbered(df, ["k"], "pos").collect())
    assert [p for _, p, _ in rows] == list(range(101))
    total, got = 0.0, {r["k"]: r["t"] for r in R.running_total(df, ["k"], F.col("x"), "t").collect()}
    for r in sorted(df.collect()):
        total += r["x"]
        assert abs(got[r["k"]] - total) < 1e-9
    assert R.numbered(df.limit(0), ["k"], "pos").count() == 0
    with pytest.raises(ValueError):
        R.bounded(df, 100, "df")
