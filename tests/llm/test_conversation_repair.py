"""Conversation repair against a search over all edit strings and against a slow path over whole conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from evispark.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def slow_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub(r"[.!?]", "", text)
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def slow_repair(rows):
    """Shortest path by a heap over whole (cost, edit string) pairs, messages carried along."""
    seen, kinds = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    out = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0}
    out |= {k: kinds.count(k) for k in ("blank", "duplicate", "truncated")}
    out["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, at, state, messages = heapq.heappop(heap)
        # Strings of one cost leave the heap in order, so the first at a place is the least up to it.
        if (at, state) in done:
            continue
        if at == len(rows) and state in ("", "a"):
            text = "\n".join(messages)
            return out | {"cost": cost, "audit": edits, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
        done.add((at, state))
        for initial, name in (("u", "user"), ("a", "assistant")):
            if (state, initial) in STEP:
                heapq.heappush(heap, (cost + 5, edits + "I", at, initial, (*messages, name + ":")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, edits + "D", at + 1, state, messages))
            if kinds[at] in ("", "truncated"):
                more = 5 if kinds[at] else 0
                if (state, role[:1]) in STEP:
                    heapq.heappush(heap, (cost + more, edits + "K", at + 1, role[:1], (*messages, f"{role}:{text}")))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if (state, initial) in STEP:
                        heapq.heappush(heap, (cost + 1 + more, edits + "R", at + 1, initial, (*messages, f"{name}:{text}")))


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for _ in range(rng.randint(0, longest)):
            turn = None if rng.random() < 0.05 else rng.randint(0, longest)
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "ux"])
            text = rng.choice(["Yes.", "No", "Well!", "é?", "a ", "x. ", "so. \n", "  ", "", None, f"t{rng.randint(0, 30)}.", f"t{rng.randint(0, 30)}"])
            rows.append((conv, turn, role, text))
    return rows + [(None, 3, "user", "Hi."), (None, 4, "assistant", "Ho."), (None, None, None, None)]


def results(frame):
    return {r["conv_id"]: {k: r[k] for k in r.asDict() if k != "conv_id"} for r in frame.collect()}


def all_strings(rows, least):
    """The least (cost, edits) by trying every edit string without insertions beyond two in a row."""
    best = None
    kinds = [f for _, f, _ in rows]

    def go(at, state, cost, edits, free):
        nonlocal best
        if cost > least:
            return
        if at == len(rows) and state in ("", "a"):
            best = min(best or (cost, edits), (cost, edits))
        for x in "ua":
            if free and (state, x) in STEP:
                go(at, x, cost + 5, edits + "I", free - 1)
        if at < len(rows):
            go(at + 1, state, cost + 2, edits + "D", 2)
            if kinds[at] in (cr.CLEAN, cr.CUT):
                more = 5 if kinds[at] == cr.CUT else 0
                if (state, rows[at][0]) in STEP:
                    go(at + 1, rows[at][0], cost + more, edits + "K", 2)
                for x in "ua":
                    if (state, x) in STEP:
                        go(at + 1, x, cost + 1 + more, edits + "R", 2)

    go(0, "", 0, "", 2)
    return best


def test_path_is_the_least_of_all_edit_strings():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice("sua-"), rng.choice([0, 0, 1, 2, 3]), 1) for _ in range(rng.randint(0, 6))]
        costs, ranks, edits = cr.paths(rows, 0)
        cost, at, tail = cr.ending(costs, ranks)
        assert (cost, edits[at] + tail) == all_strings(rows, cost)


@pytest.mark.parametrize("block_rows", [1, 3, 1024])
def test_repair_equals_a_slow_path(spark, block_rows):
    rows = random_rows(7, 60, 14)
    want = {c: slow_repair(r) for c, r in slow_damage(rows).items()}
    df = cr.damaged(spark.createDataFrame(rows, SCHEMA))
    assert results(cr.digests(cr.repair(df, block_rows))) == want


def test_one_long_conversation_spans_blocks_and_tasks(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"t{t}.", f"t{t // 2}"])) for t in range(3000)]
    rows += [(1, 40, "user", "again.")] * 500 + [(c, 0, "user", "Hi.") for c in range(2, 40)]
    want = {c: slow_repair(r) for c, r in slow_damage(rows).items()}
    found = cr.repair(cr.damaged(spark.createDataFrame(rows, SCHEMA).repartition(5)), 64)
    assert found.filter("conv_id = 1").select("part").distinct().count() > 1
    assert results(cr.digests(found)) == want
    kept = cr.messages(found).filter("conv_id = 1").orderBy("part", "seq", "pos").collect()
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r["role"][0] for r in kept))


def test_empty_dropped_and_clashing(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], SCHEMA)
    assert cr.digests(cr.repair(cr.damaged(empty))).collect() == []
    gone = spark.createDataFrame([(5, 1, "user", "Hi.", 0)], SCHEMA + ", times int")
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in cr.digests(cr.repair(gone)).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", nothing)]
    rows = random_rows(3, 20, 9)
    extra = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in ("key", "first", "n", "fault", "part", "times", "cost")))
    assert results(cr.digests(cr.repair(cr.damaged(extra)))) == {c: slow_repair(r) for c, r in slow_damage(rows).items()}


def test_blank_and_truncated_by_the_last_character(spark):
    ends = ["\t", "\n", "\v", "\f", "\r", " ", "\v\f", "\f \v", *"\\bcx0vfnr", "0x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2028", "\u3000", "'"]
    texts = [body + end for body in ("", "So.", "So", "Oh! b") for end in ends]
    rows = [(c, t, role, text) for c, text in enumerate(texts) for t, role in enumerate(["user", "assistant", "user", "assistant"])]
    want = {c: slow_repair(r) for c, r in slow_damage(rows).items()}
    assert results(cr.digests(cr.repair(cr.damaged(spark.createDataFrame(rows, SCHEMA))))) == want


def test_very_long_texts_stay_whole(spark):
    rows = [(1, 0, "user", "x" * 700_000 + "."), (1, 1, "assistant", "y" * 700_000 + "!"), (1, 2, "user", "z")]
    want = {c: slow_repair(r) for c, r in slow_damage(rows).items()}
    assert results(cr.digests(cr.repair(cr.damaged(spark.createDataFrame(rows, SCHEMA)))))[1] == want[1]
