"""Template mining against a slow tree in plain Python, on shuffled partitions."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evispark.operators import templates as T
from evispark.plans import catalog

SCHEMA = "level string, location string, message string"


def slow(rows, buckets, sim_th=0.5, depth=5, max_children=100):
    seqs, of = Counter(), {}
    for _, _, m in rows:
        t = [x for x in re.split(r"[\s|]+", m or "") if x]
        if t:
            of[m] = " ".join("<*>" if re.search("[0-9]", x) else x for x in t)
            seqs[of[m]] += 1
    leaf = {s: str(len(s.split(" "))) for s in seqs}
    for k in range(depth - 2):
        token = {s: (s.split(" ") + [""] * depth)[k] for s in seqs}
        count = defaultdict(Counter)
        for s in seqs:
            if token[s] != "<*>":
                count[leaf[s]][token[s]] += seqs[s]
        named = {p: {t for t, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:max_children]} for p, c in count.items()}
        leaf = {s: leaf[s] + " " + (token[s] if token[s] in named.get(leaf[s], ()) else "<*>") for s in seqs}
    groups, template = defaultdict(list), {}
    for s in seqs:
        groups[leaf[s]].append(s)
    for mine in groups.values():
        found = []
        for s in sorted(mine, key=lambda s: (-seqs[s], s)):
            t = s.split(" ")
            shares = [sum(a == b for a, b in zip(f, t)) / len(t) for f, _ in found]
            if shares and max(shares) >= sim_th:
                f, members = found[shares.index(max(shares))]
                f[:] = [a if a == b else "<*>" for a, b in zip(f, t)]
                members.append(s)
            else:
                found.append((t, [s]))
        for f, members in found:
            template |= {s: " ".join(f) for s in members}
    out = {}
    for t in set(template.values()):
        own = [(level, place, m) for level, place, m in rows if m in of and template[of[m]] == t]
        levels = {level for level, _, _ in own}
        places = sorted(Counter(p for _, p, _ in own).items(), key=lambda x: (-x[1], x[0]))[:3]
        bucket = next((b for b, words in buckets.items() if any(w in t.lower() for w in words)), "other")
        out[t] = (len(own), "ERROR" if "ERROR" in levels else min(levels), sorted({m for _, _, m in own})[:3], places, bucket)
    return out


def some_log(seed=1, n=1500):
    rng = random.Random(seed)
    kinds = ["request {} timed out after {} ms", "user {} | logged in from {}", "phase {} failed, stopping", "retry {}", "{w} {w} {w} {w} {w} {w}", "{w} not found in document", "{}", ""]
    rows = []
    for _ in range(n):
        k = re.sub(r"\{w\}", lambda _: rng.choice("alpha beta gamma delta eps zeta eta".split()), rng.choice(kinds))
        k = re.sub(r"\{\}", lambda _: str(rng.choice([1, 2, 33, "a7", "host"])), k)
        rows.append((rng.choice(["ERROR", "WARNING"]), rng.choice(["a:1", "b:2", "c:3", "d:4"]), k))
    return rows + [("WARNING", "z:9", None)]


def results(frame):
    return {r["template"]: (r["n"], r["level"], r["samples"], [tuple(x) for x in r["locations"]], r["bucket"]) for r in frame.collect()}


@pytest.mark.parametrize("how", [{}, {"sim_th": 0.3, "depth": 4, "max_children": 2}, {"sim_th": 0.9, "max_children": 1}])
def test_templates_equal_a_slow_tree_whatever_the_partitions(spark, how):
    rows, buckets = some_log(), {"late": ["timed out"], "failed": ["phase ", "not found"]}
    want = slow(rows, buckets, **how)
    for parts in (1, 7):
        random.Random(parts).shuffle(rows)
        assert results(T.mine(spark.createDataFrame(rows, SCHEMA).repartition(parts), buckets, **how)) == want


def test_leaves_beyond_their_size_are_clustered_in_rounds(spark):
    rows = [("WARNING", "a", f"job {a}{b} ended in {c}") for a in "abcdefghij" for b in "abcdefghij" for c in ("time", "vain")]
    one = results(T.mine(spark.createDataFrame(rows, SCHEMA), {}, leaf_size=1000, max_children=1, depth=3))
    many = results(T.mine(spark.createDataFrame(rows, SCHEMA), {}, leaf_size=30, max_children=1, depth=3))
    assert one == many and list(one) == ["job <*> ended in <*>"]


def test_registered_query_covers_all_lines(spark):
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("m"))
    n = lines.filter(F.col("m").rlike(r"[^\s|]")).count()
    found = catalog.QUERIES["d29_log_templates"](spark, sf)
    assert found.agg(F.sum("n")).first()[0] == n


def test_leaves_do_not_keep_texts_at_each_level(spark):
    """Each level of the tree wrote all texts, and none was deleted: 28 times the input lay on disk or was shuffled."""
    from evispark.sources import scratch

    before = set(scratch._STORED)
    rows = spark.createDataFrame([(f"line {w} of some {w} text", 1) for w in "abcdefghij"], "seq string, n long")
    found = T.leaves(rows, 5, 100)
    assert found.count() == 10 and len(set(scratch._STORED) - before) == 1
    assert {r["leaf"] for r in found.collect()} == {f"6 line {w} of" for w in "abcdefghij"}
