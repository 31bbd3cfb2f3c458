from pyspark.sql import functions as F

from evispark.functions import hgvs as H
from evispark.functions import text as T


def one(spark, column, **values):
    row = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*(v.alias(k) for k, v in row.items())).select(column.alias("x")).first()["x"]


def aliases(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", H.hgvs_aliases(F.col("t")).alias("x")).orderBy("i").collect()]


def test_hgvs_aliases(spark):
    got = aliases(
        spark, "NM_000059.4(BRCA2):c.1A>G", "p.Arg243Ter", "p.Gly281AlafsTer20", "R168X", "Arg168Ter", "['p.S242R','p.S346I']", "", None,
        "c.727C>T(p.R243X)", "p.R243X,p.R244X", "Arg5Gly/p.Arg6Ter", "NM_1.2(G):c.5A>G (p.Lys2Arg)", "p.(Arg97Profs*23)", "p.Xyz5Gly", "&gt;c.1A", "R5C", "[\"p.Arg5Gly\"]", "p.Leu4del",
    )
    assert got[0] == ["NM_000059.4(BRCA2):c.1A>G", "c.1A>G"]
    assert got[1] == ["p.Arg243Ter", "p.R243*"] and got[2] == ["p.Gly281AlafsTer20", "p.G281fs"]
    assert got[3] == ["R168X", "p.R168*"] and got[4] == ["Arg168Ter", "p.R168*"]
    assert got[5] == ["p.S242R", "p.S346I"] and got[6] == got[7] == []
    assert got[8] == ["c.727C>T(p.R243X)", "p.R243*"] and got[9] == ["p.R243X,p.R244X", "p.R243*"] and got[10] == ["Arg5Gly/p.Arg6Ter", "p.R6*"]
    assert got[11] == ["NM_1.2(G):c.5A>G(p.Lys2Arg)", "c.5A>G(p.Lys2Arg)", "p.K2R"] and got[12] == ["p.(Arg97Profs*23)", "p.R97fs"]
    assert got[13] == ["p.Xyz5Gly"] and got[14] == [">c.1A"] and got[15] == ["R5C", "p.R5C"] and got[16] == ["p.Arg5Gly", "p.R5G"] and got[17] == ["p.Leu4del", "p.L4del"]


def test_inheritance(spark):
    want = {
        "AD": "AD", "autosomal  dominant with reduced penetrance": "AD", "X-linked dominant; de novo": "XL", "xlr": "XL", "X连锁显性遗传": "XL", "常染色体隐性": "AR", "unknown": "UNKNOWN", "unknown inheritance": "Undetermined",
        "somatic": "Somatic Mosaicism", "somatic variant": "SOMATIC VARIANT", "gonadal mosaicism": "Somatic Mosaicism", "maternal": "MATERNAL", "maternal inheritance": "Mitochondrial", "semi-dominant": "SD", " ": "", "Mitochondrial": "Mitochondrial",
    }
    df = spark.createDataFrame(list(want.items()), "t string, w string")
    assert all(r["got"] == r["w"] for r in df.select("*", H.inheritance(F.col("t")).alias("got")).collect())


def test_fuzzy_and_relevance(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, T.fuzzy_match(a, b), a="Early–onset ataxia type 2", b="ataxia, early-onset, type two")
    assert not one(spark, T.fuzzy_match(a, b), a="ataxia", b="deafness")
    assert not one(spark, T.fuzzy_match(a, b), a="", b="x")
    assert one(spark, T.lexical_relevance(a, b), a="gene therapy trial", b="A trial of Gene editing") == 2 / 3
    assert one(spark, T.relevance_tokens(a), a="基因突变 test") == ["基因", "因突", "突变", "test"]


def test_levels_groups_and_anchor(spark):
    a, b = F.col("a"), F.col("b")
    assert [one(spark, T.classification_level(a), a=x) for x in ("Pathogenic", "likely pathogenic", "LB", "benign", "VUS", "")] == ["pathogenic", "likely_pathogenic", "likely_benign", "benign", "uncertain", "uncertain"]
    assert one(spark, T.group_id(a, b), a="BR CA1", b="") == "gene=BRCA1|variant=__missing__"
    assert one(spark, T.from_group_id(a, "variant"), a="gene=X|variant=__missing__") is None
    assert one(spark, T.value_anchor(a, b), a="the BR gene, br", b="BR") == (4, 6)
    assert one(spark, T.value_anchor(a, b), a="xbrca1 BRCA1.", b="brca1") == (7, 12)
    assert one(spark, T.value_anchor(a, b), a="b c", b="b") == (None, None)
    assert one(spark, T.estimate_tokens(a), a="abcdefgh基") == 3
    assert one(spark, T.fragments_in_order(a, b), a="alpha ... gamma", b="Alpha beta gamma")
    assert not one(spark, T.fragments_in_order(a, b), a="gamma ... alpha", b="Alpha beta gamma")
    assert one(spark, H.inheritance(a), a="Autosomal dominant with reduced penetrance") == "AD"
    assert one(spark, H.inheritance(a), a="weird") == "WEIRD"


def test_segments(spark):
    df = spark.createDataFrame([(1, "one two.\n\nthree four.\n\n" + "x" * 50)], "id int, t string")
    got = [r["segment"] for r in T.segment(df, "t", 6, 24).orderBy("segment_index").collect()]
    assert got[0] == "one two.\n\nthree four." and "".join(got[1:]).replace("\n\n", "") == "x" * 50
