"""Alias places against a naive search, in one shard and in many; groups, packs and recovery on worked cases."""

import random

from pyspark.sql import functions as F

from evispark.operators import aliases as A


def naive(docs, aliases, whole):
    out = []
    for d, text in docs:
        low = A.lowered(text or "")
        for a, alias in aliases:
            alias = A.lowered(alias or "")
            at = low.find(alias) if alias else -1
            while at >= 0:
                end = at + len(alias)
                if not whole or not ((at and low[at - 1].isalnum()) or (end < len(low) and low[end].isalnum())):
                    out.append((d, a, at, end))
                at = low.find(alias, at + 1)
    return sorted(out)


def test_places_equal_a_naive_search(spark):
    rng = random.Random(4)
    letters = ["a", "b", "A", " ", ".", "é", "İ", "ß", "日"]
    docs = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))) for i in range(60)] + [(60, None), (61, "")]
    aliases = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))) for i in range(80)] + [(90, None), (91, ""), (92, "ab"), (93, "AB")]
    d, a = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(aliases, "alias_id long, alias string")
    for whole in (True, False):
        want = naive(docs, aliases, whole)
        for size in (1 << 20, 900):
            assert sorted(tuple(r) for r in A.scan(d, a, whole, size).collect()) == want
    assert A.scan(d, a.limit(0)).collect() == []


def test_groups_named_in_their_documents(spark):
    docs = spark.createDataFrame([(1, "the TP53 gene with c.5 A>G"), (2, "nothing"), (3, None)], "doc_id long, text string")
    groups = spark.createDataFrame([(1, "g2", "TP53", "__missing__"), (1, "g1", "TP53", "c.5A>G"), (1, "g0", "KRAS", None), (2, "g3", "TP53", "c.5A>G"), (2, "g4", None, "__missing__"), (3, "g5", "TP53", None)], "doc_id long, group_id string, gene string, variant string")
    assert {(r["doc_id"], r["group_id"]) for r in A.groups_named(docs, groups).collect()} == {(1, "g1"), (2, "g4")}


def test_packs_and_genes(spark):
    packs = A.context_packs(spark.createDataFrame([("e", " brca1 ", "Breast  cancer (type 1)"), ("f", None, None)], "entry_id string, gene_symbol string, disease_label string"))
    got = {r["entry_id"]: (r["gene"], r["gene_aliases"], r["disease_aliases"]) for r in packs.collect()}
    assert got == {"e": ("BRCA1", ["BRCA1"], ["Breast cancer (type 1)", "breast cancer (type 1)", "Breast cancer", "breast cancer"]), "f": ("", [], [])}
    genes = spark.createDataFrame([("in BRCA-2 and TP53",), ("none here",), (None,)], "t string").select(A.infer_gene(F.col("t")).alias("g"))
    assert [r["g"] for r in genes.collect()] == ["BRCA-2", "", ""]


def test_recovery_takes_the_first_snippet_for_missing_fields_only(spark):
    items = [
        (1, 1, "A.x", "found", "v", "autosomal dominant"), (1, 2, "A.x", "found", "v", "biallelic, missense"), (1, 3, "A.variant_type", "found", " ", "nonsense"), (1, 4, "J.clinvar_assertion", "found", "Benign", "pathogenic"),
        (2, 1, "A.x", "missing", None, "missense"), (2, 2, "A.x", "found", None, "患儿父母均未携带"), (3, 1, "A.x", "found", "v", "STR testing: not found in the parents"),
    ]
    df = spark.createDataFrame(items, "document_id long, pos int, field_id string, status string, value string, snippet string")
    targets = spark.createDataFrame([(i, "TP53", "Lynch syndrome", "c.5del" if i == 9 else None) for i in (1, 2, 3)], "document_id long, gene string, disease string, variant string")
    got = {(r["document_id"], r["field_id"]): (r["value"], r["pos"]) for r in A.recovered(df, targets).collect()}
    assert got == {
        (1, "B.mode_of_inheritance_reported"): ("AD", 1), (1, "A.variant_type"): ("missense", 2), (2, "C.maternal_genotype"): ("target_absent", 2), (2, "C.paternal_genotype"): ("target_absent", 2), (2, "C.de_novo_status"): ("de_novo", 2),
        (2, "C.parentage_confirmed"): ("not_confirmed", 2), (3, "C.maternal_genotype"): ("target_absent", 1), (3, "C.paternal_genotype"): ("target_absent", 1), (3, "C.de_novo_status"): ("de_novo", 1),
    }


def test_places_from_left_to_right_do_not_overlap(spark):
    """A text is split at an alias, as SQL splits it: a place within a word still uses up its characters."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["the", "bathe", "then", "of", "x"]) for _ in range(40))) for i in range(50)] + [(60, "the the the"), (61, "the the the the"), (62, "bathe the the")]
    aliases = [(1, "the the"), (2, "The the"), (3, "the of the"), (4, "x x"), (5, "the")]
    want = []
    for d, text in docs:
        for a, alias in aliases:
            alias, at = alias.lower(), 0
            for part in text.split(alias)[:-1]:
                at += len(part)
                if not (text[at - 1 : at].isalnum() or text[at + len(alias) : at + len(alias) + 1].isalnum()):
                    want.append((d, a, at, at + len(alias)))
                at += len(alias)
    d, a = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(aliases, "alias_id long, alias string")
    for size in (1 << 20, 200):
        got = sorted(tuple(r) for r in A.scan(d, a, True, size, overlapping=False).collect())
        assert got == sorted(want) and len(got) < A.scan(d, a).count()
