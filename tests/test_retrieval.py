"""Retrieval for many targets against plain Python, and small worked cases."""

import random

import pytest

from evispark.operators import retrieval as R

NODES = "node long, labels array<string>, size int"


def slow_surroundings(edges, seeds, hops, limit, literature, terminology_only):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for target in {t for t, _ in seeds}:
        depth = {n: 0 for t, n in seeds if t == target}
        front = set(depth)
        for d in range(1, hops + 1):
            front = {b for a in front for b in near.get(a, ())} - set(depth)
            depth |= dict.fromkeys(front, d)
        kept = sorted(depth, key=lambda n: (depth[n], n))[:limit]
        out |= {(target, n): depth[n] for n in kept if not (terminology_only and n in literature)}
    between = {(t, a, b) for t in {t for t, _ in seeds} for a, b in edges if (t, a) in out and (t, b) in out}
    return out, between


@pytest.mark.parametrize("limit", [3, 9, 500])
@pytest.mark.parametrize("mode", ["full", "terminology_only"])
def test_surroundings_of_several_seeds(spark, limit, mode):
    rng = random.Random(limit)
    edges = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(110)} | {(7, k) for k in range(0, 60, 2)})
    edges = [(a, b) for a, b in edges if a != b]
    literature = set(range(0, 60, 5))
    nodes = spark.createDataFrame([(n, ["Evidence"] if n in literature else ["Gene"] if n % 2 else None, n) for n in range(60)], NODES)
    seeds = [("a", 1), ("a", 7), ("a", 1), ("b", 7), ("c", 33), ("c", 34), ("c", 35)]
    # Seeds and edges that name no node count for nothing.
    given = spark.createDataFrame([*seeds, ("d", 99), ("a", None)], "target string, node long")
    links = spark.createDataFrame([*edges, *edges[:3], (7, 99), (99, 3), (None, 7)], "src long, dst long")
    found, between = R.surroundings(nodes, links, given, 2, limit, mode)
    want, want_edges = slow_surroundings(edges, seeds, 2, limit, literature, mode == "terminology_only")
    assert {(r["target"], r["node"]): r["depth"] for r in found.collect()} == want
    rows = [tuple(r) for r in between.select("target", "src", "dst").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want_edges


def test_surroundings_of_nothing(spark):
    nodes, links = spark.createDataFrame([], NODES), spark.createDataFrame([], "src long, dst long")
    found, between = R.surroundings(nodes, links, spark.createDataFrame([("a", 1)], "target string, node long"))
    assert found.count() == between.count() == 0
    with pytest.raises(ValueError):
        R.surroundings(nodes, links, spark.createDataFrame([("a", 1)], "target string, node long"), mode="some")


def test_find_nodes(spark):
    nodes = spark.createDataFrame([(3, ["A", "B"], 1), (1, ["A", "B"], 1), (2, ["A"], 1), (4, None, 1), (5, ["B", "A"], None)], NODES)
    ids = lambda df: [r["node"] for r in df.collect()]
    assert ids(R.find_nodes(nodes, ("A", "B"))) == [1, 3, 5]
    assert ids(R.find_nodes(nodes, ("A",), {"size": 1}, 2)) == [1, 2]
    assert ids(R.find_nodes(nodes, (), {"size": None})) == []
    assert ids(R.find_nodes(nodes)) == [1, 2, 3, 4, 5]


def test_citations_keep_the_answers_order(spark):
    found = spark.createDataFrame([("t", 1, 0), ("t", 2, 1), ("t", 3, 1), ("u", 1, 0)], "target string, node long, depth int")
    evidence = spark.createDataFrame([(1, "one"), (2, ""), (4, "four")], "node long, quote string")
    answers = spark.createDataFrame([(9, "t", 0, 2), (9, "t", 1, 4), (9, "t", 2, 1), (9, "t", 3, 3), (9, "t", 4, 2), (8, "u", 0, 2), (8, "u", 1, 1), (8, None, 2, 1)], "answer long, target string, pos int, node long")
    got = sorted(tuple(r) for r in R.citations(answers, found, evidence, ["quote"]).collect())
    assert got == [(8, 1, 1, "one"), (9, 1, 2, None), (9, 2, 1, "one"), (9, 3, 2, None)]


def test_scoped_or_full(spark):
    schema = "g string, id int, matches boolean"
    scoped = spark.createDataFrame([("a", 1, True), ("b", 2, False), ("c", 3, None), (None, 4, False), ("e", 5, False), ("e", 5, False)], schema)
    full = spark.createDataFrame([("a", 1, True), ("a", 6, True), ("b", 2, False), ("b", 7, True), ("c", 8, False), (None, 4, False), (None, 9, True), ("d", 10, True), ("f", 11, None)], schema)
    got = sorted((r["g"] or "", r["id"]) for r in R.scoped_or_full(scoped, full, "g").collect())
    assert got == [("", 4), ("", 9), ("a", 1), ("b", 2), ("b", 7), ("c", 3), ("d", 10), ("e", 5), ("e", 5)]
    assert R.scoped_or_full(scoped.limit(0), full.limit(0), "g").count() == 0
