from pyspark.sql import functions as F

from evispark.functions import spans as S
from evispark.operators import evidence as E
from evispark.operators import matching as M


def test_repeats_and_occurrences():
    text = "intro\n\n# A\n\nbody one is long enough\n\n# B\n\nother\n\n# a\n\nbody again"
    assert S.without_repeats(text) == "intro\n\n# A\n\nbody one is long enough\n\n# B\n\nother"
    assert S.without_repeats("# A\n\nx") == "# A\n\nx" and S.without_repeats(None) is None
    assert S.without_repeats("# A\n\n" + "# a\n\n" * 50) == "# A\n\n" + "# a\n\n" * 50
    assert S.occurrences("Ab  cd AB\ncd", "ab cd") == [(0, 6), (7, 12)]
    assert S.occurrences("ﬁne fine", "fine") == [(0, 3), (4, 8)] and S.occurrences("x", "") == [] and S.occurrences(None, "x") == []


def test_pairs():
    assert S.checked_pairs("a b a", "x y x", [("a", "x"), ("a", "x"), ("a", "x"), ("", "y"), ("q", "y")]) == [(0, 1, 0, 1), (4, 5, 4, 5)]
    assert S.token_pairs("gen BRCA1 mutiert", "the BRCA1 gene mutated") == [(0, 3, 0, 3), (4, 9, 4, 9), (10, 17, 15, 22)]
    assert S.token_pairs("a b c", "a") == [(0, 1, 0, 1)] and S.token_pairs(None, "a") == []


def test_columns(spark):
    df = spark.createDataFrame([("the quote here", "quote"), ("abc", "zz"), ("abc", " ")], "t string, q string")
    got = [tuple(r["s"]) for r in df.select(S.quote_span(F.col("q"), F.col("t")).alias("s")).collect()]
    assert got == [(4, 9, "exact"), (-1, -1, "unmapped"), (-1, -1, "missing")]
    df = spark.createDataFrame([("基因突变报告", "基因突变报告。"), ("das Gen", "the gene"), ("x", None)], "a string, b string")
    assert [r[0] for r in df.select(S.untranslated(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    m = spark.createDataFrame([("Change the gene to BRCA1.",), ("disease should be ataxia;",), ("hello",)], "m string")
    assert [tuple(r[0]) for r in m.select(S.correction(F.col("m"))).collect()] == [("gene", "BRCA1"), ("disease", "ataxia"), (None, None)]


def test_gene_context_labels_references(spark):
    mentions = spark.createDataFrame([(1, "brca1"), (2, "x"), (3, "x"), (4, None)], "mention_id int, gene string")
    cands = spark.createDataFrame([(1, 9, "BRCA1", "name"), (1, 7, "BRCA1", "alias"), (1, 1, "OTHER", "primary"), (2, 5, "OTHER", "name"), (3, 5, "A", "name"), (3, 6, "B", "name"), (4, 8, "A", "name")], "mention_id int, entry_id int, gene_symbol string, alias_type string")
    assert {tuple(r) for r in M.by_gene_context(mentions, cands).collect()} == {(1, 7), (2, 5), (4, 8)}
    labels = spark.createDataFrame([("ataxia", "m1", 0), ("ataxia type 2", "m2", 1), ("ataxia", "m3", 2)], "label string, node string, pos int")
    q = spark.createDataFrame([("ataxia",), ("type 2",), ("none",)], "query string")
    assert {tuple(r) for r in M.label_lookup(q, labels).collect()} == {("ataxia", "m3"), ("type 2", "m2")}
    rel = spark.createDataFrame([("g", "a", None), ("g", "zz", None), ("g", "zz", 4)], "subject_type string, subject_alias string, subject_id int")
    al = spark.createDataFrame([("g", "a", 3), ("g", "a", 2)], "entity_type string, alias string, entry_id int")
    assert sorted(r["subject_id"] for r in M.alias_references(rel, al, "subject").collect()) == [2, 4]


def test_quality_and_missing(spark):
    it = spark.createDataFrame([("d", "f", "found", "s"), ("d", "g", "found", ""), ("d", "h", "ocr_gap", None), ("e", "x", "not_found", None)], "document_id string, field_id string, status string, snippet string")
    got = {r["document_id"]: r for r in E.quality_report(it, ["f", "x"]).collect()}
    assert (got["d"]["missing_source"], got["d"]["missing_required"], got["d"]["review"], got["d"]["passed"], got["d"]["scorable"]) == (1, ["x"], True, False, True)
    assert (got["e"]["missing_required"], got["e"]["scorable"]) == (["f", "x"], False)
    ex = spark.createDataFrame([("d", "f", "v"), ("d", "k", "Ataxia"), ("d", "l", "zz"), ("q", "k", "v")], "document_id string, field_id string, value string")
    src = spark.createDataFrame([("d", "ataxia is caused by it")], "document_id string, text string")
    assert {r["field_id"] + r["document_id"]: r["cause"] for r in E.missing_fields(ex, it, src).collect()} == {"kd": "span_selected_but_field_missing", "ld": "normalization_gap", "kq": "no_source"}
