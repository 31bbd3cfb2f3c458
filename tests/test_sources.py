import json

from pyspark.sql import functions as F

from evispark.sources import blocks as B
from evispark.sources import literature as L
from evispark.sources import vocabularies as V


def test_genes(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("HGNC ID\tApproved symbol\tApproved name\tAlias symbols\tPrevious symbols\n5\tBrca1\tone\tA1, A2\tP1\n\tX\t\t\t\n6\t\t\t\t\n7\tTP53\ttwo\t\t\n")
    entries, aliases = V.genes(spark, str(tmp_path / "g.tsv"), "v1")
    assert {(r["external_id"], r["normalized_name"]) for r in entries.collect()} == {("HGNC:5", "BRCA1"), ("HGNC:7", "TP53")}
    assert {(r["alias_text"], r["alias_type"]) for r in aliases.collect()} == {("Brca1", "primary"), ("A1", "alias"), ("A2", "alias"), ("P1", "previous_symbol"), ("TP53", "primary")}


def test_phenotypes_and_ontology(spark, tmp_path):
    (tmp_path / "h.obo").write_text("format-version: 1.2\n\n[Term]\nid: HP:1\nname: Ataxia\n\n[Term]\nid: HP:2\nname: Old\nis_obsolete: true\n\n[Typedef]\nid: HP:3\nname: no\n\n[Term]\nid: HP:4\n")
    entries, _ = V.phenotypes(spark, str(tmp_path / "h.obo"), "v")
    assert [(r["external_id"], r["display_name"]) for r in entries.collect()] == [("HP:1", "Ataxia")]
    graph = {"graphs": [{"nodes": [{"id": "http://x/MONDO_1", "lbl": "A"}, {"id": "http://x/MONDO_2", "lbl": "a "}, {"id": "http://x/HP_7", "lbl": "P"}], "edges": [{"sub": "http://x/MONDO_1", "pred": "is_a", "obj": "http://x/MONDO_2"}, {"sub": "http://x/MONDO_1", "pred": "part_of", "obj": "http://x/MONDO_9"}]}]}
    (tmp_path / "m.json").write_text(json.dumps(graph))
    labels, edges = V.ontology(spark, str(tmp_path / "m.json"))
    assert {(r["label"], r["node"]) for r in labels.collect()} == {("a", "MONDO:2"), ("p", "HP:7")}
    assert [tuple(r) for r in edges.collect()] == [("MONDO:1", "MONDO:2")]
    assert [r["external_id"] for r in V.phenotypes_json(spark, str(tmp_path / "m.json"), "v")[0].collect()] == ["HP:7"]


def test_variants_and_diseases(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("#AlleleID\tName\tGeneSymbol\tReviewStatus\tRS# (dbSNP)\tVariationID\n1\tNM_1.2(G):c.5A>G (p.Lys2Arg)\tG\treviewed by expert panel\t77\t9\n2\tNM_1.2(G):c.6A>G\tG\tno assertion provided\t-1\t10\n")
    entries, aliases = V.variants(spark, str(tmp_path / "v.tsv"), "v")
    assert [(r["external_id"], r["stars"]) for r in entries.collect()] == [("ClinVar:9", 3)]
    assert {r["alias_text"] for r in aliases.collect()} == {"c.5A>G", "p.Lys2Arg", "rs77"}
    (tmp_path / "o.tsv").write_text("# Copyright\n# Prefix\tMIM Number\tPreferred Title; symbol\tAlternative Title(s); symbol(s)\tIncluded\nNULL\t100\tATAXIA ONE; AT1\tataxia one;; OTHER, INCLUDED\t\nNULL\t\tX\t\t\n")
    entries, aliases = V.diseases(spark, str(tmp_path / "o.tsv"), "v")
    assert [(r["external_id"], r["display_name"]) for r in entries.collect()] == [("OMIM:100", "ATAXIA ONE")]
    assert {(r["alias_text"], r["alias_type"]) for r in aliases.collect()} == {("ATAXIA ONE", "primary"), ("AT1", "alias"), ("OTHER", "alias")}


def test_items(spark):
    raw = [
        ("crossref", {"title": ["T"], "author": [{"given": "A", "family": "B"}], "DOI": "10.1/x", "issued": {"date-parts": [[2020, 1]]}}),
        ("openalex", {"title": "U", "authorships": [{"author": {"display_name": "C D"}}], "publication_year": 2019, "primary_location": {"source": {"display_name": "J"}}}),
        ("somewhere", {"name": "W", "link": "http://w"}),
    ]
    df = spark.createDataFrame([(p, json.dumps(j)) for p, j in raw], "provider string, raw string")
    got = {r["provider"]: r for r in L.items(df).collect()}
    assert (got["crossref"]["title"], got["crossref"]["authors"], got["crossref"]["year"], got["crossref"]["doi"]) == ("T", ["A B"], 2020, "10.1/x")
    assert (got["openalex"]["authors"], got["openalex"]["journal"], got["openalex"]["year"]) == (["C D"], "J", 2019)
    assert (got["somewhere"]["title"], got["somewhere"]["url"], got["somewhere"]["authors"]) == ("W", "http://w", [])


def test_blocks_and_tables(spark):
    md = "# Head\npara one\nstill\n\n- a\n- b\n1. c\n![cap](x.png)\n| h | i |\n|---|---|\n| 1 | 2 |\n<table>\n<tr><td>x</td></tr>\n</table>\nend"
    got = [(t, lv, x) for t, lv, x, _ in B.markdown_blocks(md)]
    assert got == [("title", 1, "Head"), ("text", None, "para one\nstill"), ("list", None, "a\nb\nc"), ("image", None, "cap"), ("table", None, ""), ("table", None, ""), ("text", None, "end")]
    odd = "####### no\n#no\n![open\n![a](b)c\nx\n-\n1.\tone\n| a |\nnot\n|h|\n|-|\n|1|\n\n|2|\n<TABLE>\n\nx</TABLE>\n## Two"
    assert [(t, x, b) for t, _, x, b in B.markdown_blocks(odd)] == [
        ("text", "####### no\n#no", ""), ("text", "![open", ""), ("text", "![a](b)c\nx\n-", ""), ("list", "one", ""), ("text", "| a |\nnot", ""),
        ("table", "", "<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table>"), ("text", "|2|", ""), ("table", "", "<TABLE>\n\nx</TABLE>"), ("title", "Two", ""),
    ]
    assert B.markdown_blocks("") == [] and B.markdown_blocks(None) == []
    assert B.table_markdown("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table>") == "| a | b |\n| --- | --- |\n| 1 |  |"
    df = spark.createDataFrame([(1, "x\nIntro\nbody\nReferences\nz"), (2, "plain")], "id int, t string")
    assert {r["id"]: r["body"] for r in B.body_lines(df, "id", "t", "^Intro", "^References").collect()} == {1: "Intro\nbody", 2: "plain"}


def test_logs_and_links(spark, tmp_path):
    (tmp_path / "a.log").write_text("2024 | ERROR | m.py:f:3 - took 12 ms for 'x' at /a/b/c\nnoise\n2024 | INFO | m.py - ok\n")
    rows = L.log_lines(spark, str(tmp_path)).select("level", L.template(F.col("message")).alias("t")).collect()
    assert {tuple(r) for r in rows} == {("ERROR", "took <num> ms for <str> at <path>"), ("INFO", "ok")}
    links = spark.createDataFrame([([("landing", "l"), ("pdf", "p")],)], "x array<struct<kind: string, url: string>>")
    assert links.select(L.open_copy(F.col("x"))).first()[0] == "p"
