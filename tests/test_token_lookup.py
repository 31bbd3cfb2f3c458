"""Aliases that hold all tokens of a query, against brute force, in one shard and in many."""

import random
import re
import time

from evispark.operators import matching as M


def tokens(text):
    return [w for w in dict.fromkeys(re.findall("[a-z0-9]+", text.lower())) if len(w) > 2 and w not in M.COMMON_WORDS]


def test_tokens_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["abc", "abcd", "bcd", "x1y", "the", "syndrome", "of", "zzz", "ABC", "cdab"]
    say = lambda n: rng.choice([" ", "-", ""]).join(rng.choice(words) for _ in range(rng.randint(0, n)))
    queries = [(i, say(3)) for i in range(40)] + [(90, None), (91, "")]
    aliases = [(i, say(8)) for i in range(80)] + [(90, None), (91, "")]
    want = {}
    for q, text in queries:
        a = tokens(text or "")
        fits = [(d, low or "", set(tokens(low or ""))) for d, low in aliases if a and low and all(w in low.lower() for w in a)]
        if fits:
            want[q] = min((-len(own & set(a)) / len(own | set(a)), d) for d, _, own in fits)
    qs, ds = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(aliases, "alias_id long, text string")
    for size in (1 << 20, 900):
        got = {r["query_id"]: (-r["score"], r["alias_id"]) for r in M.resolve_by_tokens(qs, ds, size).collect()}
        assert got == want and len(got) > 10


def test_time_grows_with_the_length_of_a_text_only(spark):
    """Substrings of every place would be found from the start of the text each: 1e11 steps here."""
    long = " ".join(f"w{i}" for i in range(100_000))
    qs = spark.createDataFrame([(1, "w99999 w5000"), (2, "missing w5000")], "query_id long, text string")
    start = time.monotonic()
    assert [tuple(r)[:2] for r in M.resolve_by_tokens(qs, spark.createDataFrame([(7, long)], "alias_id long, text string")).collect()] == [(1, 7)]
    assert time.monotonic() - start < 60
