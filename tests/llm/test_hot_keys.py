"""Keys that hold many rows, with the sizes from which rows stay where they stand brought down to a few."""

import random

import pytest

from evispark.llm import common, simhash, suffix_dedup

from .fixtures import documents, words


@pytest.fixture
def small_limits(monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_SHARE", 1_000_000)


def near_copies(rng, base, n):
    out = []
    for _ in range(n):
        w = base.split()
        w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        out.append(" ".join(w))
    return out


def kept_by(texts, least=0.8):
    """The first text of each component of five-word similarity, by brute force."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


def test_a_band_of_many_near_copies(spark, small_limits):
    rng = random.Random(2)
    base, other = words(rng, 150), words(rng, 90)
    texts = [*near_copies(rng, base, 60), *(words(rng, 80) for _ in range(12)), *near_copies(rng, other, 8), base, base]
    for together in (simhash.TOGETHER, 2000):
        got = {r["doc_id"] for r in simhash.one_of_each(documents(spark, texts), together=together).collect()}
        assert got == kept_by(texts)


def test_a_passage_that_many_documents_share(spark, small_limits):
    rng = random.Random(3)
    passage = words(rng, 80)
    texts = [f"{words(rng, 12)} {passage} {words(rng, 9)}" for _ in range(40)]
    plain = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(documents(spark, texts)).collect()}
    hot = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(documents(spark, texts), hot=5).collect()}
    assert plain == hot and plain[0][0] == 0 and all(n >= len(passage) for i, (n, _) in plain.items() if i)
