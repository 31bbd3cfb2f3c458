"""Chunks against their budgets and sources, early stops against a plain simulation, thresholds against reading depth by depth."""

import random

from pyspark.sql import functions as F

from evispark.operators import chunking as CH
from evispark.operators import fanout as FO
from evispark.plans import catalog

SF = "/root/testdata/sf0.001"


def squeezed(text):
    return "".join(text.split())


def test_text_chunks_keep_everything_within_the_budget(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    docs[-3] = "日本語。" * 300 + "\n\n" + "x" * 2000
    df = spark.createDataFrame([*docs.items(), (-1, None), (-2, "")], "doc_id long, text string")
    for r in CH.text_chunks(df, F.col("text"), 100).collect():
        got.setdefault(r["doc_id"], {})[r["chunk"]] = r["body"]
        # A sentence beyond the budget is cut by characters; where letters are wider than the text's average, tokens may be more.
        hard = not CH.SENTENCE_END.search(r["body"])
        assert 1 <= r["chunk"] <= r["n_chunks"] and len(r["body"]) <= CH.Budget(docs[r["doc_id"]], 80).chars and (CH.tokens(r["body"]) <= 80 or hard)
    assert not {-1, -2} & set(got)
    for i, text in docs.items():
        assert squeezed("".join(got.get(i, {}).get(k, "") for k in range(1, len(got.get(i, {})) + 1))) == squeezed(text or "")
    assert catalog.QUERIES["h101_text_chunks"](spark, SF).count() == sum(len(CH.segments(t or "", 100)) for i, t in docs.items() if i >= 0)


def test_segments_cut_at_paragraphs_then_sentences_then_hard():
    assert CH.segments("a b c.\n\nd e f.", 1000) == ["a b c.\n\nd e f."]
    long = "One sentence here. " * 20
    cut = CH.segments(long, 60)
    assert len(cut) > 1 and all(c.endswith("here.") for c in cut)
    assert "".join(CH.segments("y" * 1000, 60)) == "y" * 1000
    assert CH.segments("", 60) == []


def test_block_chunks_have_their_indices_and_seams(spark):
    rows = [(1, ["first block " * 10, "", None, "second " * 25, "third"]), (2, []), (3, None), (4, ["z. " * 400])]
    df = spark.createDataFrame(rows, "id int, blocks array<string>")
    out = sorted((r["id"], r["chunk"], r["n_chunks"], r["block_indices"]) for r in CH.block_chunks(df, F.col("blocks"), 70, 10).collect())
    assert out[:2] == [(1, 1, 2, [0]), (1, 2, 2, [3, 4])] and {i for i, *_ in out} == {1, 4} and all(set(b) == {0} for i, _, _, b in out if i == 4)
    bodies = CH.with_seams(["aaaa", "bbbb", "cccc"], 2)
    assert bodies[1] == "bbbb" + CH.PREVIOUS + "aa" + CH.NEXT + "cc" and bodies[0] == "aaaa" + CH.NEXT + "bb"
    assert CH.with_seams(["aaaa", "bbbb"], 0) == ["aaaa", "bbbb"]


def test_answers_are_taken_until_there_are_enough(spark):
    rng = random.Random(6)
    plan, counts, want = [], [], set()
    for request in range(30):
        n = rng.randint(1, 8)
        done = rng.sample(range(100), n)
        items = [rng.choice([0, 0, 3, 9]) for _ in range(n)]
        have, came = 0, 0
        for d, p in sorted(zip(done, range(n))):
            if have >= 8 and came >= max(2, n // 2):
                break
            want.add((request, p))
            have, came = have + items[p], came + 1
        plan += [(request, p, d) for p, d in enumerate(done)]
        counts += [(request, p, items[p]) for p in range(n) if items[p]]
    got = FO.answered(spark.createDataFrame(plan, "request int, provider int, done int"), spark.createDataFrame(counts, "request int, provider int, n long"), 4)
    assert {(r["request"], r["provider"]) for r in got.collect()} == want
    assert FO.answered(spark.createDataFrame(plan, "request int, provider int, done int"), spark.createDataFrame(counts, "request int, provider int, n long"), 4, False).count() == len(plan)


def test_depth_is_that_of_reading_level_by_level(spark):
    rng = random.Random(8)
    rows, depth, best = [], {}, {}
    for request in range(25):
        lists = {p: sorted(((rng.randint(0, 20), i) for i in rng.sample(range(30), rng.randint(1, 12))), reverse=True) for p in range(rng.randint(1, 4))}
        total = {}
        for p, ranked in lists.items():
            rows += [(request, p, r, i, s) for r, (s, i) in enumerate(ranked, 1)]
            for s, i in ranked:
                total[i] = total.get(i, 0) + s
        deepest, seen = max(map(len, lists.values())), set()
        for d in range(1, deepest + 1):
            seen |= {x[d - 1][1] for x in lists.values() if len(x) >= d}
            bound = sum(x[d - 1][0] for x in lists.values() if len(x) >= d)
            if sum(total[i] >= bound for i in seen) >= 3:
                break
        depth[request] = d
        best[request] = sorted(total.values(), reverse=True)[:3]
    df = spark.createDataFrame(rows, "request int, provider int, rank int, item int, score long")
    assert {r["request"]: r["depth"] for r in FO.threshold_depth(df, 3).collect()} == depth
    got = {}
    for r in FO.top_items(df, 3).orderBy("request", "place").collect():
        got.setdefault(r["request"], []).append(r["score"])
    assert got == best
