import pytest
from pyspark.sql import functions as F

from evispark.operators import evidence as E

ITEM = "document_id string, group_id string, field_id string, value string, status string, confidence double, block int, snippet string, track string, pos int"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


@pytest.fixture
def some(spark):
    g = "gene=BRCA1|variant=c.1A>G"
    return items(
        spark,
        ("d", g, E.GENE_FIELD, "BRCA1", "found", 0.9, 1, "BRCA1 variant", "original", 0),
        ("d", g, "A.variant_hgvs_c", "c.1A>G", "found", 0.8, 1, "c.1A>G", "original", 1),
        ("d", g, E.DISEASE_FIELD, "Cancer", "found", 0.7, 2, "cancer", "original", 2),
        ("d", g, E.DISEASE_FIELD, "Ataxia", "found", 0.6, 2, "", "translated", 3),
        ("d", "gene=X|variant=__missing__", E.GENE_FIELD, "X", "not_found", 0.1, 5, None, "original", 4),
        ("d", "gene=X|variant=__missing__", "C.note", "n", "found", 0.1, 5, None, "original", 5),
    )


def test_chains_contradictions_gate(spark, some):
    got = {r["group_id"]: r for r in E.chains(some).collect()}
    full = got["gene=BRCA1|variant=c.1A>G"]
    assert (full["gene"], full["disease"], full["variant"], full["level"]) == ("BRCA1", "Cancer", "c.1A>G", "full")
    assert got["gene=X|variant=__missing__"]["level"] == "empty"
    assert [r["values"] for r in E.contradictions(some).collect()] == [["Ataxia", "Cancer"]]
    kept = E.gated_items(some, [E.GENE_FIELD])
    assert sorted(r["pos"] for r in kept.collect()) == [0, 1, 2, 3, 4]
    full_row = some.withColumns({c: F.lit("x") for c in ("run_id", "gene_id", "variant_id", "disease_id", "review_status")})
    gated = E.ready_gate(full_row)
    why = {r["pos"]: r["reasons"] for r in gated.collect()}
    assert why[0] == [] and why[3] == ["missing_source_support"] and why[4] == ["unsupported_status", "missing_source_support"]
    report = {r["reason"]: r["n"] for r in E.gate_report(gated).collect()}
    assert report["accepted"] == 3 and report["rejected"] == 3 and report["missing_source_support"] == 3


def test_grounding(spark):
    docs = spark.createDataFrame([("d", "alpha beta gamma beta delta")], "document_id string, text string")
    it = spark.createDataFrame([("d", 0, "alpha", 0), ("d", 1, "gamma", 3), ("d", 2, "beta", 0), ("d", 3, "alpha ... delta", 0), ("d", 4, "zeta", 0), ("d", 5, None, 0), ("e", 6, "x", 0)], "document_id string, i int, snippet string, start int")
    got = {r["i"]: (r["grounding"], r["start"], r["end"]) for r in E.ground(it, docs).collect()}
    assert got == {0: ("exact", 0, 5), 1: ("corrected", 11, 16), 2: ("ambiguous", None, None), 3: ("ellipsis", None, None), 4: ("missing", None, None), 5: ("missing", None, None), 6: ("missing", None, None)}


def test_support(spark):
    rows = [
        ("BRCA1 causes cancer", "causative", 1.0, False), ("BRCA1 is not associated with cancer", "refuted", 0.65, True), ("disputed link of BRCA1", "disputed", 0.5075, True), ("nothing", "uncertain", 0.0, True), (None, "uncertain", 0.0, True),
        ("biallelic BRCA1", "causative", 0.8075, False), ("BRCA1 is linked to Cancer", "uncertain", 0.9, False), ("preliminary BRCA1 cancer", "uncertain", 0.85, False), ("conflicting BRCA1 cancer", "refuted", 0.65, False),
        ("a variant in the BRCA1 gene was associated with cancer", "causative", 1.0, False), ("variants of BRCA12 associated with cancer", "uncertain", 0.9, False), ("BRCA1 in influenza, RSV and Crohn", "uncertain", 0.0075, True), ("BRCA1 risk", "susceptibility", 0.6075, False),
    ]
    df = spark.createDataFrame([(r[0], "BRCA1", "Cancer") for r in rows], "snippet string, target_gene string, disease_alias string")
    got = {r["snippet"]: (r["label"], r["support"], r["review"]) for r in E.support(df).collect()}
    for s, label, score, review in rows:
        assert got[s][0] == label and abs(got[s][1] - score) < 1e-3 and got[s][2] == review


def test_decisions_and_alignment(spark, some):
    decided = {r["field_id"]: r for r in E.decide_fields(E.candidate_score(some)).collect()}
    d = decided[E.DISEASE_FIELD]
    assert d["value"] == "Cancer" and d["conflicting_value"] == "Ataxia" and not d["review"]
    a = items(spark, ("d", "g", "f1", "no variant", "found", 1.0, 0, "", "o", 0), ("d", "g", "f2", "12 cases", "found", 1.0, 0, "", "o", 0), ("d", "g", "f3", "early onset ataxia", "found", 1.0, 0, "", "o", 0), ("d", "g", "f4", "same", "found", 1.0, 0, "", "o", 0), ("d", "g", "f5", "x y", "found", 1.0, 0, "", "o", 0))
    b = items(spark, ("d", "g", "f1", "variant", "found", 1.0, 0, "", "t", 0), ("d", "g", "f2", "21 cases", "found", 1.0, 0, "", "t", 0), ("d", "g", "f3", "ataxia", "found", 1.0, 0, "", "t", 0), ("d", "g", "f4", "Same", "found", 1.0, 0, "", "t", 0), ("d", "g", "f5", "z", "found", 1.0, 0, "", "t", 0), ("d", "g", "f6", "only", "found", 1.0, 0, "", "t", 0))
    got = {r["field_id"]: r["alignment"] for r in E.alignment(a, b).collect()}
    assert got == {"f1": "drifted", "f2": "drifted", "f3": "partial", "f4": "aligned", "f5": "conflict", "f6": "missing"}


def test_spans_groups_blocks(spark):
    spans = spark.createDataFrame([("d", 1, 12, 15), ("d", 2, 90, 95)], "document_id string, item int, start int, end int")
    chunks = spark.createDataFrame([("d", 0, 50, 100), ("d", 10, 20, 200)], "document_id string, c_start int, c_end int, o_start int")
    assert [tuple(r) for r in E.project_span(spans, chunks).collect()] == [("d", 1, 202, 205)]
    it = spark.createDataFrame([("d", 1, 5)], "document_id string, item int, block int")
    an = spark.createDataFrame([("d", "gene=A|variant=__missing__", 4), ("d", "gene=B|variant=v", 6), ("d", "gene=C|variant=v", 9)], "document_id string, group_id string, block int")
    assert E.nearest_group(it, an).first()["group_id"] == "gene=B|variant=v"
    bl = spark.createDataFrame([("d", i, t, "text") for i, t in enumerate(["intro", "BRCA1 causes cancer", "then", "far", "a variant p.R1X"])], "document_id string, block int, text string, type string")
    scored = E.block_scores(bl, "BRCA1", ["Cancer"])
    assert {r["block"]: r["score"] for r in scored.collect()} == {1: 13.0, 4: 1.5}
    assert sorted(r["block"] for r in E.select_blocks(bl, scored).collect()) == [0, 1, 2, 4]


def test_merges_and_ranking(spark):
    m = spark.createDataFrame([("d", 0, False, ["A", "b"]), ("d", 1, True, ["a", "C"])], "document_id string, pos int, relevant boolean, genes array<string>")
    r = E.merge_maps(m, ["genes"]).first()
    assert (r["relevant"], r["genes"]) == (True, ["A", "b", "C"])
    c = spark.createDataFrame([("d", 0, ["unknown"], 0.9), ("d", 1, ["case"], 0.5), ("d", 2, ["cohort", "case"], 0.6), ("e", 0, ["unknown"], 0.2)], "document_id string, pos int, channels array<string>, confidence double")
    got = {r["document_id"]: (r["channels"], r["confidence"]) for r in E.merge_channels(c, ["case", "cohort"]).collect()}
    assert got == {"d": (["case", "cohort"], 0.6), "e": (["unknown"], 0.2)}
    s = spark.createDataFrame([("Other", "p", None, 2020, 0), ("gene therapy", "q", "10", 1999, 1), ("Gene Therapy!", "p", None, 2021, 2)], "title string, provider string, doi string, year int, pos int")
    assert [r["pos"] for r in E.rank_candidates(s, "Gene therapy", "p").collect()] == [2, 1, 0]
    g = spark.createDataFrame([("B", "v", "C"), ("b", None, "c")], "gene string, variant string, disease string")
    nodes, edges = E.literature_graph(g)
    assert nodes.count() == 3 and {(r["src"], r["evidence_count"]) for r in edges.collect()} == {("gene:b", 2), ("variant:v", 1)}


def test_channels_of_ties_nulls_and_single_chunks(spark):
    rows = [
        ("tie", 3, ["case"], 0.5), ("tie", 1, ["cohort", "x"], 0.5), ("tie", 2, ["y"], 0.9),
        ("null", 0, ["case"], None), ("null", 1, ["case", "z"], 0.1), ("null", 2, None, 0.8),
        ("plain", 1, ["u"], 0.3), ("plain", 0, ["v"], 0.3), ("one", 0, ["case", "case"], 0.2), ("none", 0, None, None),
    ]
    schema = "document_id string, pos int, channels array<string>, confidence double"
    found = E.merge_channels(spark.createDataFrame(rows, schema), ["case", "cohort"])
    got = {r["document_id"]: (r["channels"], r["confidence"], r["pos"]) for r in found.collect()}
    assert got == {
        "tie": (["cohort", "x", "case"], 0.5, 1), "null": (["case", "z"], 0.1, 1), "plain": (["v"], 0.3, 0),
        "one": (["case", "case"], 0.2, 0), "none": (None, None, 0),
    }
    assert E.merge_channels(spark.createDataFrame([], schema), ["case"]).count() == 0


def test_comparison_grades(spark):
    from evispark.operators import comparison as C

    want = spark.createDataFrame([(1, "F", "brown  cat"), (1, C.MODE_FIELDS[0], "AD"), (1, "G", "x y"), (1, "H", "z"), (2, C.PROTEIN_FIELD, "p.Arg243Ter")], "entry int, field_id string, value string")
    got = spark.createDataFrame(
        [(1, "F", 0, "a dog", "found"), (1, "F", 1, "the Brown cat", "found"), (1, "F", 2, "Brown cat", "found"), (1, "F", 3, "A  DOG", "found"), (1, "F", 4, "owl", "not_found"), (1, C.MODE_FIELDS[0], 0, "autosomal dominant", "found"), (1, "G", 0, "q", "found"), (1, "G", 1, "r", "found"), (2, C.PROTEIN_FIELD, 0, "R243X", "found")],
        "entry int, field_id string, pos int, value string, status string",
    )
    rows = {r["field_id"]: (r["match_type"], r["extracted_value"], r["extra_values"]) for r in C.compare_fields(want, got).collect()}
    assert rows["F"] == ("exact", "Brown cat", ["a dog"])
    assert rows[C.MODE_FIELDS[0]] == ("field_normalized", "autosomal dominant", []) and rows[C.PROTEIN_FIELD] == ("field_normalized", "R243X", [])
    assert rows["G"] == ("wrong_value", "q", []) and rows["H"] == ("missing", None, [])
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(C.phenotype_terms(F.lit("Global developmental\n delay, hp:0000001"))) == "HP:0000001;HP:0001263" and one(C.phenotype_terms(F.lit(" plain "))) == "plain"
    assert one(C.canonical_alias(F.lit("NM_1.2(G):c.5A>G (p.Lys2Arg)"))) == "p.K2R" and one(C.canonical_alias(F.lit("p.Gly281AlafsTer20"))) == "p.G281fs" and one(C.canonical_alias(F.lit(None).cast("string"))) == ""
    assert tuple(one(C.highlight(F.lit("see BRCA1 here"), F.lit("99"), F.lit("120"), F.lit("brca1")))) == (4, 9)
    assert tuple(one(C.highlight(F.lit("abc"), F.lit("-2"), F.lit("2"), F.lit("b")))) == (0, 2) and one(C.highlight(F.lit(""), F.lit("0"), F.lit("2"), F.lit("b"))) is None
