"""Merged facts against a plain loop over all rows, and how they are merged."""

import random

from evispark.operators import ordered as O


def plain(rows):
    groups, out = {}, []
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0)):
        facts = groups.setdefault(r[0], [])  # [source it came with, row]
        source = r[3]
        hit = next((f for f in facts if f[0] == source), None) or (facts[0] if source is None and facts else next((f for f in facts if f[0] is None), None))
        if hit is None:
            facts.append([source, list(r)])
            continue
        old = hit[1]
        if r[2] is not None and old[2] is not None and r[2] > old[2]:
            hit[1] = [*r[:3], old[3] if source is None else source, r[4]]
        elif old[3] is None and source is not None:
            old[3] = source
    for facts in groups.values():
        out += [tuple(f[1]) for f in facts]
    return out


def test_facts_equal_a_plain_loop_and_keep_long_ids(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(200)]), i, rng.choice([None, 0.1, 0.5, 0.9, float("nan")]), rng.choice([None, "a", "b", "c"]), rng.choice([None, (1 << 53) + 2 * i + 1])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, pos int, conf double, src string, id long").repartition(7)
    found = O.merge_facts(df, ["k"], "pos", "conf", "src")
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(map(repr, plain(rows)))
    # A call of Python for each fact took most of the time.
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
