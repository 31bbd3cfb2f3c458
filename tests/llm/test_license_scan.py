"""Licence scans against every notice held against every place, and the phrases against regular expressions."""

import math
import random

import pytest

from evispark.llm import license_scan as ls
from evispark.llm import queries

from .fixtures import documents, odd_texts


def notices():
    return [t for _, t, _ in ls.TEMPLATES]


def texts():
    rng = random.Random(8)
    out = [*odd_texts(), "ALL rights\x00reserved, All rights reserved cc-by CC_BY cc by", "général public license général_public license General Public-License", "mit license " * 400]
    for t in notices():
        w = t.split()
        out += [t, t.upper(), "x " * 50 + t + "\n" + t, " ".join(w[: len(w) // 2]), " ".join(w[1:]), "é" + t + "é"]
        for _ in range(4):
            changed = [rng.choice(["the", "zzz", "license", x, x, x, x, x, x]) for x in w]
            out.append(" ".join(rng.choice(["the", "of", "license", "mit", "software"]) for _ in range(rng.randint(0, 60))) + " " + " ".join(changed) + " the end")
    return out


def slow(rows, templates, phrases, least):
    """Spans of each text, every notice at every place."""
    split = [ls.words(t or "") for t in rows]
    total = len(split)
    count = {}
    for w in split:
        for x in set(w):
            count[x] = count.get(x, 0) + 1
    weight = {x: math.log((2 + total) / (1 + count.get(x, 0))) for t in [*templates, *((0, p) for p in phrases.values())] for x in ls.words(t[1])}
    out = []
    for w in split:
        found = []
        for label, p in phrases.items():
            p = ls.words(p)
            found += [(i, i + len(p), "phrase", label, 1.0) for i in range(len(w)) if w[i : i + len(p)] == p]
        for label, t, keys in templates:
            t = ls.words(t)
            n, mine = len(t), []
            for i in range(1 - n, len(w)):
                agree = [0 <= i + k < len(w) and w[i + k] == t[k] for k in range(n)]
                share = sum(weight[x] for x, a in zip(t, agree) if a) / sum(weight[x] for x in t)
                spans = [next(j for j in range(n) if t[j : j + len(k)] == k) for k in map(ls.words, keys)]
                if share >= least - 1e-9 and all(all(agree[j : j + len(ls.words(k))]) for j, k in zip(spans, keys)):
                    mine.append((-share, i))
            taken = []
            for share, i in sorted((round(s, 9), i) for s, i in mine):
                if all(abs(i - x) >= n for x in taken):
                    taken.append(i)
                    found.append((i, i + n, "notice", label, -share))
        out.append((len(w), sorted((a, b, c, d, round(e, 6)) for a, b, c, d, e in found)))
    return out


@pytest.mark.parametrize("least,block", [(0.7, 1 << 21), (0.3, 300)])
def test_spans_equal_every_notice_at_every_place(spark, least, block):
    rows = texts()
    got = {r["doc_id"]: (r["n_words"], sorted((s["start"], s["stop"], s["kind"], s["label"], round(s["score"], 6)) for s in r["spans"])) for r in ls.scan(documents(spark, rows, extra=True), least=least, block_bytes=block).collect()}
    want = slow(rows, ls.TEMPLATES, ls.PHRASES, least)
    assert [got[i] for i in range(len(rows))] == want
    assert sum(len(s) for _, s in want) > 100


def test_digest_columns(spark):
    rows = ["All rights reserved. Licensed under CC BY-NC 4.0.", None, "nothing here", "Released under the MIT License. x all rights reserved"]
    found = {r["doc_id"]: r for r in queries._license_columns(ls.scan(documents(spark, rows))).collect()}
    first = found[0].asDict()
    assert {k: first[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")} == {"n_words": 10, "n_base": 2, "first_word": 0, "last_word": 5, "base_labels": "cc-by,reserved", "labels": "cc-by,cc-by-nc-4.0,reserved"}
    assert first["score"] == 1.0
    assert tuple(found[1])[1:] == (0, 0, None, None, "", "", 0.0) and tuple(found[2])[2:] == (0, None, None, "", "", 0.0)
    assert found[3]["labels"] == "mit,reserved"


def test_empty_table_other_templates_and_keys(spark):
    assert ls.scan(documents(spark, [])).collect() == []
    assert ls.scan(documents(spark, ["a b"]), templates=[], phrases={}).first()["spans"] == []
    with pytest.raises(ValueError, match="key phrase"):
        ls.Index([("x", "a b c", ["a c"])], {})


def test_repeated_rows_and_very_long_texts(spark):
    text = "word " * 300_000 + notices()[0] + " word" * 300_000
    rows = ls.scan(documents(spark, [text, "a", text]).repartition(2)).collect()
    assert {(r["doc_id"], [s["start"] for s in r["spans"]][0]) for r in rows if r["doc_id"] != 1} == {(0, 300_000), (2, 300_000)}
