import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq

from .fixtures import documents, odd_texts, words


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    texts = [*odd_texts(), *odd_texts()[9:12]]
    rows = {"doc_id": list(range(len(texts))), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": [len(t or "") for t in texts]}
    pq.write_table(pa.table(rows), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [5, 9, 11, 13], "quality": pa.array([1, 1, 1, 0], pa.int32()), "toxic": pa.array([0, 0, 0, 0], pa.int32())}), tmp_path / "labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = out.cache()
    ids = {r["doc_id"] for r in docs.collect()}
    assert not ids & {0, 1, 2} and 6 not in ids and len(ids & {5, 7}) == 1
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == ids


def test_near_duplicates_are_those_of_five_word_similarity(spark):
    """One stays of each component of exact five-word similarity 0.8 or more, whatever the fingerprints say."""
    rng = random.Random(8)
    texts = []
    for edits in range(0, 13):
        base = words(rng, 245).split()
        copy = list(base)
        for at in rng.sample(range(3, 240), edits):
            copy[at] = words(rng, 1)
        texts += [" ".join(base), " ".join(copy)]
    # Shuffled halves keep most word pairs: fingerprints lie near each other, five-word similarity is far below 0.8.
    base = words(rng, 240).split()
    parts = [base[i : i + 4] for i in range(0, 240, 4)]
    rng.shuffle(parts)
    texts += [" ".join(base), " ".join(w for p in parts for w in p), None, "  ", "x", "X", "y"]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if (not a and not b) or (a | b and len(a & b) / len(a | b) >= 0.8):
                    root[i] = root[j] = min(root[i], root[j])
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, documents(spark, texts), "").collect()}
    assert kept == {i for i, r in enumerate(root) if i == r}
    # The same when large groups are compared part by part.
    from evispark.llm import simhash

    parts = {r["doc_id"] for r in simhash.one_of_each(documents(spark, texts), **corpus_pipeline.NEAR, together=300).collect()}
    assert parts == kept


def test_a_chain_of_copies_is_one_group_however_it_is_dealt(spark):
    """Each text is similar to its neighbours only; comparing part by part must join them all."""
    from evispark.llm import simhash

    rng = random.Random(2)
    base = words(rng, 400).split()
    texts = []
    for i in range(40):
        texts.append(" ".join(base))
        for at in range(3, 400, 57):
            base[(at + i * 5) % 400] = words(rng, 1)
    texts += [words(rng, 50), texts[7]]
    for together in (800, 1 << 20):
        got = {r["doc_id"] for r in simhash.one_of_each(documents(spark, texts), **corpus_pipeline.NEAR, together=together).collect()}
        assert got == {0, 40}
