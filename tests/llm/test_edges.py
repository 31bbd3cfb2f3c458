"""Structured strings that weak hashes confuse, borders of blocks and caches, and the draw of the sampler."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from evispark.llm import importance, packing, quality_rules
from evispark.llm.common import SpanHashes, buffer_of

from .fixtures import SCHEMA, documents, odd_texts

WORD = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def morse_texts():
    """Documents whose lines and words are Thue-Morse strings and their complements: all different."""
    out = []
    for n in (1024, 2048, 4096, 8192):
        a, b = thue_morse(n), thue_morse(n, "ba")
        out += [f"{a}\n{b}", f"{a} {b} x {b} {a} x {a} {a}", a, b]
    return out


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    return len(words), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_of_structured_strings_and_small_blocks(spark):
    texts = [*odd_texts(), *morse_texts()]
    for size in (700, 1 << 21):
        got = {r["doc_id"]: r for r in quality_rules.measured(documents(spark, texts), size).collect()}
        assert [(got[i]["n_words"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) for i in range(len(texts))] == [slow_counts(t) for t in texts]


def test_quality_counts_of_many_short_documents_in_one_block():
    rng = random.Random(11)
    short = ["p\nq\n \n  \n   \n    \na", "q"]
    for _ in range(400):
        lines = [rng.choice(["", " " * rng.randint(1, 9), " ".join(f"w{rng.randint(0, 39)}" for _ in range(rng.randint(1, 20)))]) for _ in range(rng.randint(1, 6))]
        short.append("\n".join(lines))
    for size in (len(short), 7):
        for i in range(0, len(short), size):
            s = quality_rules.statistics(*buffer_of(pa.array(short[i : i + size])))
            got = list(zip(s["n_words"].tolist(), s["n_dup_lines"].tolist(), s["n_repeat_words"].tolist(), strict=True))
            assert got == [slow_counts(t) for t in short[i : i + size]]


def test_quality_fit_takes_one_row_of_a_repeated_id(spark):
    df = documents(spark).union(documents(spark, list(reversed(odd_texts()))))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(17)], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(df, labels).count() == df.count()


def test_ids_of_structured_words_are_the_librarys():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    texts = [*morse_texts(), *odd_texts()]
    tiny = packing.WordTokenizer(WORD, remembered=3, remembered_chunks=5)
    for size in (1, 3, len(texts)):
        for i in range(0, len(texts), size):
            ids, counts = tiny.encode(*buffer_of(pa.array(texts[i : i + size])))
            want = [library.encode(t or "", add_special_tokens=False).ids for t in texts[i : i + size]]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_packing_in_small_blocks_keeps_every_id(spark):
    df = documents(spark, [*odd_texts(), *morse_texts()[:6]])
    keys = ("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset")
    one, two = ({tuple(r[k] for k in keys) for r in packing.pack(df, WORD, length=128, block_bytes=n).collect()} for n in (600, 1 << 21))
    assert one == two


def test_span_hashes_tell_structured_strings_apart():
    raw = np.frombuffer((thue_morse(8192) + thue_morse(8192, "ba")).encode(), np.uint8)
    h = SpanHashes(raw)
    for n in (1024, 2048, 4096, 8192):
        assert h(np.array([0]), np.array([n])) != h(np.array([8192]), np.array([8192 + n]))
        assert h(np.array([3]), np.array([n])) == SpanHashes(raw[3:n])(np.array([0]), np.array([n - 3]))


def test_inclusion_follows_the_weights(spark):
    """With k of 30,000 documents, a document is drawn about e times as often as one whose log weight is less by 1."""
    df = spark.range(30_000).withColumn("log_weight", (F.col("id") % 3).cast("double"))
    keyed = df.withColumn("key", F.col("log_weight") + importance.gumbel("id"))
    limit = importance.kth_largest(keyed, "key", 1500)
    drawn = {r["w"]: r["n"] for r in keyed.filter(F.col("key") >= limit).groupBy(F.col("log_weight").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert sum(drawn.values()) == 1500
    assert 2.0 < drawn[1.0] / drawn[0.0] < 3.6 and 2.0 < drawn[2.0] / drawn[1.0] < 3.6


def test_weights_equal_a_slow_model_and_the_draw_is_no_cut(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.6, 40) % 500) + (" bad words" if i % 9 == 0 else "") for i in range(400)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in importance.resample(df, labels, k=200, block_bytes=300).collect()}
    own = [importance.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in texts]
    assert all(len(set(b.tolist())) == len(b) for b in own)
    raw, good = Counter(), Counter()
    for i, b in enumerate(own):
        raw.update(b.tolist())
        if i % 2 == 0 and i % 9:
            good.update(b.tolist())
    ratios = importance.log_ratios(*(np.array([c[x] for x in range(importance.SIZE)]) for c in (good, raw)))
    assert all(abs(got[i]["log_weight"] - ratios[b].sum()) < 1e-9 and got[i]["n_grams"] == len(b) for i, b in enumerate(own))
    assert sum(r["kept"] for r in got.values()) == 200 and all(r["log_weight"] != 0 for r in got.values())
    plain = {i for i, _ in sorted(got.items(), key=lambda x: -x[1]["log_weight"])[:200]}
    drawn = {i for i, r in got.items() if r["kept"]}
    assert plain != drawn
    clean = [i for i in range(400) if i % 9]
    assert np.mean([got[i]["kept"] for i in clean]) > np.mean([got[i]["kept"] for i in range(0, 400, 9)])


def test_blocks_are_sorted_by_suffix():
    """Cover ranks and the order of tied suffixes are those of plain sorting."""
    from evispark.llm import suffix_dedup

    rng = np.random.default_rng(2)
    core = "".join(rng.choice(list("ab"), 200))
    stretches = [(core[int(rng.integers(0, 4)) : 150 + int(rng.integers(0, 50))] + "\0" * int(rng.integers(0, 2))).encode() for _ in range(30)] + [b"a" * n for n in (100, 130, 131, 168)]
    raw = np.frombuffer(b"".join(stretches), np.uint8)
    offsets = np.append(0, np.cumsum([len(x) for x in stretches]))
    block = suffix_dedup.BlockSort(raw, offsets)
    where = {int(b) + k: x[k:] for b, x in zip(block.begin, stretches, strict=True) for k in range(len(x))}
    cover = [p for p in where if p % suffix_dedup.PERIOD in suffix_dedup.COVER]
    assert sorted(np.flatnonzero(block.rank)) == cover
    distinct = {s: i + 1 for i, s in enumerate(sorted({where[p] for p in cover}))}
    assert [int(block.rank[p]) for p in cover] == [distinct[where[p]] for p in cover]
    full = [p for p in where if len(where[p]) >= 100]
    heads = sorted({where[p][:32] for p in full})
    at, group = np.array(full), np.array([heads.index(where[p][:32]) for p in full])
    order = block.order(at, group)
    assert [where[int(p)] for p in at[order]] == sorted(where[p] for p in full)
    seen, want = set(), []
    for r, x in enumerate(stretches):
        for k in range(len(x) - 99):
            if x[k : k + 100] in seen:
                want.append((r, k))
            seen.add(x[k : k + 100])
    row, nth = suffix_dedup.repeated(raw, offsets, np.zeros(len(stretches), np.int64), 100)
    assert list(zip(row.tolist(), nth.tolist(), strict=True)) == want


CLASH = ["rep", "same", "root", "band", "fp", "e", "place", "need", "calls", "good", "gumbel_key", "log_weight", "x", "hkey", "at", "part", "label", "shard", "replica", "v"]


def odd_documents(spark):
    """Nulls in every column, repeated rows and ids, ties, very long texts, and columns with clashing names."""
    base = documents(spark)
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, odd_texts()[5], None, None, None), (3, None, "en", None, 1), (40, odd_texts()[11] * 30, None, "s", None)], SCHEMA)
    return base.unionByName(base.filter("doc_id IN (5, 9)")).unionByName(nulls).select("*", *(F.lit(1).alias(c) for c in CLASH))


def test_operators_take_odd_tables(spark):
    """Every operator on documents gives a row for each row, whatever stands in the columns; results of equal rows are equal."""
    from evispark.llm import byte_bpe, language_id, simhash, suffix_dedup

    df, n = odd_documents(spark), odd_documents(spark).count()
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, None), (None, None, None), (9, None, 1), (11, 0, 0), (11, 0, 0)], "doc_id long, quality int, toxic int")
    pattern = public_tokenizers.PATTERN
    found = {
        "importance": importance.resample(df, labels), "quality": quality_rules.judge(df, labels), "suffix": suffix_dedup.deduplicate(df), "language": language_id.predict(df, language_id.learn(df)),
        "bpe": byte_bpe.round_trip_digest(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern), "simhash": simhash.near_duplicates(df),
    }
    for name, out in found.items():
        rows = [tuple(str(v) for v in r) for r in out.collect()]
        same = [r for r in rows if r[0] == "5"]
        assert len(rows) == n or name == "simhash" and len(rows) == n, name
        assert len(same) == 2 and len(set(same)) == 1, name
    pieces = packing.pack(df, WORD, with_ids=False).filter("start = 0").count()
    assert pieces == n
    assert quality_rules.judge(df.limit(0), labels.limit(0)).count() == 0 and language_id.predict(df.limit(0), language_id.learn(df.limit(0))).count() == 0


def test_pipeline_takes_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, df in (("odd", odd_documents(spark)), ("empty", odd_documents(spark).limit(0))):
        folder = f"{tmp_path}/{name}"
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(5, 1, 0), (11, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            out = run(spark, docs, folder)
            assert out.columns == docs.columns, stage
        rows = corpus_pipeline.run(spark, folder).collect()
        assert bool(rows) == (name == "odd")
        assert not {r["doc_id"] for r in rows} & {0, 1, 2}


def test_small_blocks_change_no_result(spark):
    from evispark.llm import byte_bpe, language_id

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    df = documents(spark, [*odd_texts(), *morse_texts()])
    parser = language_id.learn(df, max_symbols=300)
    for run in (lambda n: byte_bpe.round_trip_digest(df, path, pattern, n), lambda n: language_id.predict(df, parser, n)):
        assert sorted(map(tuple, run(300).collect())) == sorted(map(tuple, run(1 << 22).collect()))


def test_verdicts_are_those_of_the_trees(spark):
    """kept is the base rule and a walk down each tree, node by node."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "Beta", "42", "#", "x.", "gamma"], int(rng.integers(20, 200)))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, int(t.count("#") < 10), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    trees = quality_rules.fit(df, labels)
    rows = {r["doc_id"]: r for r in quality_rules.judge(df, labels).collect()}
    for r in quality_rules.measured(df).collect():
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if r["x"][f[node]] > t[node] else 1)
            total += v[node - len(f)]
        score, got = 1 / (1 + np.exp(-total)), rows[r["doc_id"]]
        assert abs(got["score"] - score) < 1e-12 and got["kept"] == (not got["base_failed"] and score >= 0.5)
    assert len({r["kept"] for r in rows.values()}) == 2


def test_default_share_follows_the_labels(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(30)), "en", "s", 0) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = importance.resample(spark.createDataFrame(rows, SCHEMA), labels).filter("kept").count()
    assert got == round(200 * (1 - 0.6 * 0.25))


def test_block_shingles_equal_those_of_single_texts():
    import pyarrow as pa

    from evispark.llm import simhash

    texts = [*odd_texts(), "a", "A  b", "a b c d", "a b c d e", "a b c d e f", "", "f a b c d e"]
    whole = simhash.BlockWords(*buffer_of(pa.array(texts)))
    for k in (2, 5):
        sets, prints = whole.sets(k), whole.fingerprints(k)
        names = {}
        for t, s, f in zip(texts, sets, prints, strict=True):
            w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
            want = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
            alone = simhash.BlockWords(*buffer_of(pa.array([t], pa.string())))
            assert len(s) == len(want) and alone.sets(k)[0].tolist() == s.tolist() and alone.fingerprints(k)[0] == f
            for x in want:
                names.setdefault(x, set()).update(s.tolist())
        # Texts share as many hashes as they share shingles.
        for a, b in ((5, 7), (5, 8), (9, 10), (-6, -5), (-4, -3), (-3, -1)):
            wa, wb = (texts[i].lower().split() for i in (a, b))
            sa, sb = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (wa, wb))
            assert len(set(sets[a].tolist()) & set(sets[b].tolist())) == len(sa & sb)


def test_votes_are_added_up_in_stretches(monkeypatch):
    import tracemalloc

    from evispark.llm import simhash

    rng = random.Random(3)
    texts = ["", *(" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.choice([0, 1, 2, 3, 40, 900]))) for _ in range(200)), ""]
    whole = simhash.BlockWords(*buffer_of(pa.array(texts)))
    want = whole.fingerprints(2)
    for votes in (1, 7, 64, 1000):
        monkeypatch.setattr(simhash, "VOTES", votes)
        assert whole.fingerprints(2).tolist() == want.tolist()
    monkeypatch.undo()
    large = simhash.BlockWords(*buffer_of(pa.array(["so it is " * 100] * 2000)))
    tracemalloc.start()
    large.fingerprints(2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # 600,000 shingles: added up at once they took 350 MB


def test_clusters_equal_all_pairs():
    from evispark.llm import simhash

    rng = np.random.default_rng(4)
    for _ in range(20):
        bases = [rng.integers(0, 1 << 62, 30, dtype=np.uint64) for _ in range(4)]
        sets = [np.unique(np.append(b[rng.random(30) < 0.93], rng.integers(0, 1 << 62, rng.integers(0, 3), dtype=np.uint64))) for b in bases for _ in range(6)]
        sets += [np.zeros(0, np.uint64)] * 2
        root = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.union1d(sets[i], sets[j]))
                if not both or len(np.intersect1d(sets[i], sets[j])) / both >= 0.8:
                    x, y = sorted((root[i], root[j]))
                    root = [x if r == y else r for r in root]
        assert simhash.clusters(sets, 0.8) == root
    assert simhash.clusters([], 0.8) == []


def test_workers_keep_what_one_operator_needs():
    from evispark.llm import common

    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_pydict({"text": ["so", "it"]})
    tokenizer = packing._loaded(path)
    assert list(common.slices(iter([batch]), "text", 100, "packing")) and packing._loaded(path) is tokenizer
    SpanHashes(np.zeros(9, np.uint8))
    assert common._POWERS and list(common.slices(iter([batch]), "text", 100, "spans")) and common._POWERS and not packing._LOADED
    assert list(common.slices(iter([batch]), "text", 100)) and not common._POWERS


def test_chunks_of_letters_are_one_piece_without_splitting(monkeypatch):
    class Never:
        def findall(self, text):
            raise AssertionError(text)

    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    letters = [chr(c) for c in range(0x41, 0x180) if chr(c).isalpha() and c != 0x130]
    rng = random.Random(8)
    words = ["Word", "WORD", "ZÜRICH", "ªº", "ŉ", "ſ", *letters, *("".join(rng.choices(letters, k=rng.randint(2, 30))) for _ in range(3000))]
    want = tokenizer._library(words)
    for name in ("PIECES", "ASCII_PIECES"):
        monkeypatch.setattr(packing, name, Never())
    assert tokenizer.encode_chunks([w.encode() for w in words]) == want


def test_known_and_new_chunks_are_numbered_alike():
    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), remembered_chunks=40)
    rng = random.Random(2)
    vocabulary = [f"w{i}x" for i in range(30)] + ["Über", "it's", "a-b", "x.y", "naïve", "12", "日本", "<|x|>", "..", "A"]
    for _ in range(30):
        texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(6)]
        ids, counts = tokenizer.encode(*buffer_of(pa.array(texts)))
        want = [e.ids for e in tokenizer.library.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_rows_of_no_key_are_left_out_before_a_join(spark):
    from evispark.llm import simhash

    ids = [0, 1, -1, 32768, 32769, 2**62, -(2**63), *range(100, 3000, 7)]
    rows = spark.createDataFrame([(i,) for i in {*ids, *range(5000)}] + [(None,)], "rep long")
    keys = spark.createDataFrame([(i,) for i in ids + ids[:3]], "rep long")
    for bits in (3, 10, 25):
        found = [r["rep"] for r in simhash.likely(rows, keys, "rep", bits).collect()]
        assert set(ids) <= set(found)
    assert len(found) < len(set(ids)) + 20
    assert simhash.likely(rows, keys.limit(0), "rep").collect() == []


def test_ids_of_random_signs_are_the_librarys():
    """Letters, signs, apostrophes, digits and other scripts in any order: cutting at signs changes no id."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    library, tok = Tokenizer.from_file(WORD), packing.WordTokenizer(WORD)
    rng = np.random.default_rng(12)
    parts = [*"abZ.,;:!?()\"-'<|>#@/&_09 \n", "'s", "'ll", "é", "日", "—", "«", "́", " ", "ﬁ", "İ", "ß", "<|end|>"]
    texts = ["".join(rng.choice(parts, int(rng.integers(1, 60)))) for _ in range(3000)]
    ids, counts = tok.encode(*buffer_of(pa.array(texts)))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
