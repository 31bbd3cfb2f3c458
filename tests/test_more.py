from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators import evaluation as E


def values(spark, f, *rows):
    df = spark.createDataFrame([tuple(r) if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"c{i} string" for i in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    return [r[0] for r in df.select(f(*(F.col(c) for c in df.columns))).collect()]


def test_disease_functions(spark):
    assert values(spark, T.disease_match, ("Rett syndrome", "syndrome of Rett-like"), ("Rett syndrome", "Down syndrome"), ("", "x"), ("ataxia", "Ataxia type 2")) == [True, False, False, True]
    assert values(spark, T.disease_tokens, "The Rett syndrome, type II of X1Y") == [["rett", "x1y"]]
    assert values(spark, T.relationship, "Causative", "associated", "MECP2 mutations cause it", "Evidence is limited", "No evidence of association", "it is disputed", "", "odd") == ["causative", "causative", "causative", "uncertain", "refuted", "disputed", "", "odd"]


def test_identifiers_and_buckets(spark):
    assert values(spark, T.whole_number, "123.0", "1.5", "n/a") == ["123", "1.5", None]
    assert values(spark, T.identifier_body, " PMID: 12", "doi:10.1/X") == ["12", "10.1/x"]
    assert values(spark, T.plain_title, "A–B  c! 基因", None) == ["a b c 基因", ""]
    assert values(spark, lambda c: T.first_bucket(c, {"net": ["timeout", "refused"], "io": ["disk"]}), "Read Timeout on disk", "disk full", "x") == ["net", "io", "other"]
    assert values(spark, lambda c: T.mapped(c, {"zh": "Chinese"}), "ZH ", "fr") == ["Chinese", "fr"]
    assert values(spark, T.difficulty, "A.x", "B.y", "C.z", "D.q") == ["simple_explicit", "medium_contextual", "complex_evidence", "other"]


def test_systems_and_tracks(spark):
    r = spark.createDataFrame([("a", 1, "f", True), ("b", 1, "f", False), ("a", 2, "f", True), ("a", 3, "f", False), ("b", 3, "f", False)], "system string, entry int, field string, matched boolean")
    got = {x["system"]: (x["n"], x["accuracy"], x["gap"]) for x in E.compared_systems(r, "a").collect()}
    assert got == {"a": (2, 0.5, 0.0), "b": (2, 0.0, -0.5)}
    order = spark.createDataFrame([(3, 0), (1, 1), (2, 2)], "entry int, pos int")
    assert tuple(E.case_study(r.filter("system = 'a'"), r.filter("system = 'b'"), order, ["f"]).first()) == (1, "f")
    t = spark.createDataFrame([(1, "f", "original", "x"), (1, "f", "translated", "x"), (1, "g", "original", "x"), (2, "f", "original", "x"), (2, "f", "translated", "y")], "entry int, field string, track string, value string")
    assert tuple(E.track_consistency(t).first()) == (3, 1, 0.333333)
    i = spark.createDataFrame([("k", True, True, True), ("k", True, False, True), ("k", False, False, True), ("k", True, True, False)], "g string, has_span boolean, in_source boolean, matched boolean")
    assert tuple(E.traceability(i, ["g"]).first()) == ("k", 4, 0.5, 0.25, 0.25)
