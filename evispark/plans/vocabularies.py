"""Queries of the vocabulary readers and provider mappings: tables are written in each source's format and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import literature as L
from ..sources import vocabularies as V
from ..sources.scratch import scratch_dir
from .catalog import Tables, query


def tsv(t: Tables, df: DataFrame, quote: str = '"') -> str:
    path = scratch_dir(t.spark)
    df.write.options(sep="\t", header=True, quote=quote, escape='"').csv(path)
    return path


def lines(t: Tables, df: DataFrame, sep: str = "\n") -> str:
    path = scratch_dir(t.spark)
    df.write.option("lineSep", sep).text(path)
    return path


def text(c: str) -> Column:
    return F.col(c).cast("string")


def gene_file(t: Tables) -> str:
    rows = t.part.select(
        F.when(F.col("p_size") % 7 > 0, text("p_partkey")).alias("HGNC ID"), F.concat(F.lit("G"), text("p_partkey"), F.lit("a")).alias("Approved symbol"), F.col("p_name").alias("Approved name"),
        F.when(F.col("p_size") % 2 == 0, F.concat_ws(" , ", "p_brand", "p_type")).alias("Alias symbols"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("Previous symbols"),
    )
    return tsv(t, rows)


@query("a1_gene_entries", "SELECT 'HGNC:' || p_partkey AS external_id, 'G' || p_partkey || 'a' AS display_name, 'G' || p_partkey || 'A' AS normalized_name, 'v1' AS version FROM part WHERE p_size % 7 > 0")
def _(t: Tables):
    return V.genes(t.spark, gene_file(t), "v1")[0].select("external_id", "display_name", "normalized_name", "version")


@query(
    "a1_gene_aliases",
    "WITH p AS (SELECT * FROM part WHERE p_size % 7 > 0) SELECT 'HGNC:' || p_partkey AS external_id, 'G' || p_partkey || 'a' AS alias_text, 'G' || p_partkey || 'A' AS normalized_alias, 'primary' AS alias_type FROM p UNION ALL SELECT 'HGNC:' || p_partkey, unnest([p_brand, p_type]), unnest([upper(p_brand), upper(p_type)]), 'alias' FROM p WHERE p_size % 2 = 0 UNION ALL SELECT 'HGNC:' || p_partkey, p_name, upper(p_name), 'previous_symbol' FROM p WHERE p_size % 3 = 0",
)
def _(t: Tables):
    return V.genes(t.spark, gene_file(t), "v1")[1].select("external_id", "alias_text", "normalized_alias", "alias_type")


@query(
    "a2_disease_aliases",
    "SELECT 'OMIM:' || c_custkey AS external_id, c_name AS alias_text, lower(c_name) AS normalized_alias, 'primary' AS alias_type FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'OMIM:' || c_custkey, c_mktsegment, lower(c_mktsegment), 'alias' FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'OMIM:' || c_custkey, 'OTHER ' || c_nationkey, 'other ' || c_nationkey, 'alias' FROM customer WHERE c_nationkey <> 3",
)
def _(t: Tables):
    """Prose and a marked header above the rows; names between ``;`` and ``;;``, some of them the same but for case."""
    rows = t.customer.select(
        F.lit("# Prefix").alias("# Prefix"), F.when(F.col("c_nationkey") != 3, text("c_custkey")).otherwise(" ").alias("MIM Number"), F.concat_ws("; ", "c_name", "c_mktsegment").alias("Preferred Title; symbol"),
        F.concat(F.lower("c_name"), F.lit(";; OTHER "), text("c_nationkey"), F.lit(", INCLUDED")).alias("Alternative Title(s); symbol(s)"), F.lit("x").alias("Included"),
    ).withColumn("# Prefix", F.lit("NULL"))
    path = scratch_dir(t.spark)
    head = t.spark.createDataFrame([("# Copyright",), ("# " + "\t".join(["Prefix", *rows.columns[1:]]),)], "value string")
    head.unionByName(rows.select(F.concat_ws("\t", *(F.col(f"`{c}`") for c in rows.columns)).alias("value"))).write.text(path)
    return V.diseases(t.spark, path, "v1")[1].select("external_id", "alias_text", "normalized_alias", "alias_type")


@query("a5_phenotypes_json", "SELECT 'HP:' || lpad(CAST(n_nationkey AS VARCHAR), 7, '0') AS external_id, n_name AS display_name, lower(n_name) AS normalized_name FROM nation WHERE n_regionkey < 3")
def _(t: Tables):
    iri = F.concat(F.lit("http://x/"), F.when(F.col("n_regionkey") < 3, "HP_").otherwise("MP_"), F.lpad(text("n_nationkey"), 7, "0"))
    nodes = F.collect_list(F.struct(iri.alias("id"), F.concat(F.lit(" "), "n_name").alias("lbl")))
    graph = t.nation.agg(F.to_json(F.struct(F.array(F.struct(nodes.alias("nodes"))).alias("graphs"))).alias("value"))
    return V.phenotypes_json(t.spark, lines(t, graph), "v1")[0].select("external_id", "display_name", "normalized_name")


@query("a6_phenotypes_obo", "SELECT 'HP:' || p_partkey AS external_id, p_name || ' ' || p_partkey AS display_name FROM part WHERE p_size % 5 > 1")
def _(t: Tables):
    """Stanzas; obsolete terms, terms without a name and other kinds of stanzas are dropped."""
    kind = F.when(F.col("p_size") % 5 == 1, "[Typedef]").otherwise("[Term]")
    name = F.concat(F.lit("name: "), "p_name", F.lit(" "), text("p_partkey"))
    gone = F.when(F.col("p_size") % 5 == 0, "is_obsolete: true")
    stanza = t.part.select(F.concat_ws("\n", kind, F.concat(F.lit("id: HP:"), text("p_partkey")), name, gone).alias("value"))
    return V.phenotypes(t.spark, lines(t, stanza, "\n\n"), "v1")[0].select("external_id", "display_name")


@query("a7_rows_below_prose", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS kind FROM part")
def _(t: Tables):
    """A quoted header below a line of prose."""
    head = t.spark.createDataFrame([("CURATIONS as of today",), ('"GENE","NAME","KIND"',)], "value string")
    rows = t.part.select(F.concat(F.lit('"'), F.concat_ws('","', text("p_partkey"), "p_name", "p_type"), F.lit('"')).alias("value"))
    found = V.lines_from_header(t.spark, lines(t, head.unionByName(rows)), "GENE", ",")
    return found.select(F.col("GENE").alias("id"), F.col("NAME").alias("name"), F.col("KIND").alias("kind"))


def variant_file(t: Tables) -> str:
    status = F.element_at(F.array(*(F.lit(x) for x in ("reviewed by expert panel", "no assertion provided", "criteria provided, single submitter"))), F.col("p_size") % 3 + 1)
    name = F.concat(F.lit("NM_1.2(G):c."), text("p_partkey"), F.lit("A>G"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" (p.Lys"), text("p_partkey"), F.lit("Arg)"))).otherwise(""))
    cells = (text("p_partkey"), name, F.col("p_brand"), status, F.when(F.col("p_size") % 5 > 0, text("p_size")).otherwise("-1"), F.concat(text("p_partkey"), F.lit("7")))
    head = t.spark.createDataFrame([("#" + "\t".join(["AlleleID", "Name", "GeneSymbol", "ReviewStatus", "RS# (dbSNP)", "VariationID"]),)], "value string")
    return lines(t, head.unionByName(t.part.select(F.concat_ws("\t", *cells).alias("value"))))


@query("a8_variant_entries", "SELECT 'ClinVar:' || p_partkey || '7' AS external_id, p_brand AS gene_symbol, CASE p_size % 3 WHEN 0 THEN 3 ELSE 1 END AS stars FROM part WHERE p_size % 3 <> 1")
def _(t: Tables):
    return V.variants(t.spark, variant_file(t), "v1")[0].select("external_id", "gene_symbol", "stars")


@query(
    "a9_variant_aliases",
    "WITH p AS (SELECT * FROM part WHERE p_size % 3 <> 1) SELECT 'ClinVar:' || p_partkey || '7' AS external_id, 'c.' || p_partkey || 'A>G' AS alias_text, 'name' AS alias_type FROM p UNION ALL SELECT 'ClinVar:' || p_partkey || '7', 'p.Lys' || p_partkey || 'Arg', 'name' FROM p WHERE p_size % 2 = 0 UNION ALL SELECT 'ClinVar:' || p_partkey || '7', 'rs' || p_size, 'rsid' FROM p WHERE p_size % 5 > 0",
)
def _(t: Tables):
    return V.variants(t.spark, variant_file(t), "v1")[1].select("external_id", "alias_text", "alias_type")


@query("a15_ontology_edges", "SELECT 'MONDO:' || lpad(CAST(n_nationkey AS VARCHAR), 7, '0') AS src, 'MONDO:' || lpad(CAST(100 + n_regionkey AS VARCHAR), 7, '0') AS dst FROM nation WHERE n_nationkey % 4 > 0")
def _(t: Tables):
    iri = lambda c: F.concat(F.lit("http://x/MONDO_"), F.lpad(c.cast("string"), 7, "0"))
    nodes = F.collect_list(F.struct(iri(F.col("n_nationkey")).alias("id"), F.col("n_name").alias("lbl")))
    edge = F.struct(iri(F.col("n_nationkey")).alias("sub"), F.when(F.col("n_nationkey") % 4 > 0, "is_a").otherwise("part_of").alias("pred"), iri(F.col("n_regionkey") + 100).alias("obj"))
    graph = t.nation.agg(F.to_json(F.struct(F.array(F.struct(nodes.alias("nodes"), F.collect_list(edge).alias("edges"))).alias("graphs"))).alias("value"))
    return V.ontology(t.spark, lines(t, graph))[1]


def field(path: str, value: Column) -> Column:
    """A value nested below the names of a dotted path."""
    for name in reversed(path.split(".")):
        value = F.struct(value.alias(name))
    return value


def merged(*fields: Column) -> Column:
    """JSON objects of different names put together."""
    inner = [F.regexp_replace(F.to_json(f), r"^\{|\}$", "") for f in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}"))


def provider(name: str, row: str, record, sql_doi: str = "'10.1000/' || p_partkey", sql_url: str = "'http://x/' || p_partkey", sql_journal: str = "p_type") -> None:
    """Register the query of a provider: parts written as its records and read by its mapping."""
    sql = f"SELECT p_partkey, p_name AS title, p_brand || ' ' || p_type AS author, {sql_journal} AS journal, CAST(1990 + p_size % 30 AS INTEGER) AS year, {sql_doi} AS doi, {sql_url} AS url FROM part"

    @query(row, sql)
    def _(t: Tables):
        title, author, journal = F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type"), F.col("p_type")
        doi, url = F.concat(F.lit("10.1000/"), text("p_partkey")), F.concat(F.lit("http://x/"), text("p_partkey"))
        raw = record(title, author, journal, 1990 + F.col("p_size") % 30, doi, url)
        records = t.part.select("p_partkey", F.lit(name).alias("provider"), merged(*raw).alias("raw"))
        return L.items(records, ["p_partkey"]).select("p_partkey", "title", F.col("authors")[0].alias("author"), "journal", "year", "doi", "url")


def _named(author: Column, name: str) -> Column:
    # The same author twice counts once.
    return F.array(F.struct(author.alias(name)), F.struct(author.alias(name)))


provider("openalex", "a33_openalex", lambda t, a, j, y, d, u: [field("title", t), F.struct(F.array(field("author.display_name", a)).alias("authorships")), field("primary_location.source.display_name", j), field("publication_year", y), field("doi", d), field("id", u)])
provider("pmc", "a34_pmc", lambda t, a, j, y, d, u: [field("title", t), F.struct(_named(a, "name").alias("authors")), field("fulljournalname", j), field("pubdate", F.concat(y.cast("string"), F.lit(" Jan 3"))), F.struct(F.array(F.struct(F.lit("pmid").alias("idtype"), F.lit("1").alias("value")), F.struct(F.lit("doi").alias("idtype"), d.alias("value"))).alias("articleids")), field("url", u)])
provider("semantic_scholar", "a35_semantic_scholar", lambda t, a, j, y, d, u: [field("title", t), F.struct(_named(a, "name").alias("authors")), field("venue", j), field("publicationDate", F.concat(y.cast("string"), F.lit("-02-03"))), field("externalIds.DOI", d), field("openAccessPdf.url", u)])
provider(
    "clinical_trials", "a36_clinical_trials",
    lambda t, a, j, y, d, u: [F.struct(F.struct(F.struct(t.alias("briefTitle"), d.alias("nctId")).alias("identificationModule"), F.struct(_named(a, "name").alias("overallOfficials")).alias("contactsLocationsModule"), F.struct(field("date", F.concat(y.cast("string"), F.lit("-05"))).alias("startDateStruct")).alias("statusModule")).alias("protocolSection"))],
    "CAST(NULL AS VARCHAR)", "'https://clinicaltrials.gov/study/10.1000/' || p_partkey", "CAST(NULL AS VARCHAR)",
)
provider("unpaywall", "a38_unpaywall", lambda t, a, j, y, d, u: [field("title", t), F.struct(F.array(F.struct(F.col("p_brand").alias("given"), F.col("p_type").alias("family"))).alias("z_authors")), field("journal_name", j), field("year", y), field("doi", d), field("best_oa_location.url", u)])
provider("europepmc", "a39_europepmc", lambda t, a, j, y, d, u: [field("title", t), F.struct(field("author", _named(a, "fullName")).alias("authorList")), field("journalInfo.journal.title", j), field("pubYear", y.cast("string")), field("doi", d), F.struct(field("fullTextUrl", F.array(F.struct(u.alias("url")))).alias("fullTextUrlList"))])
provider("zenodo", "a40_zenodo", lambda t, a, j, y, d, u: [F.struct(F.struct(t.alias("title"), _named(a, "name").alias("creators"), field("title", j).alias("journal"), F.concat(y.cast("string"), F.lit("-01-01")).alias("publication_date"), d.alias("doi")).alias("metadata")), field("links.html", u)])
provider("unheard_of", "a41_generic", lambda t, a, j, y, d, u: [field("name", t), F.struct(_named(a, "name").alias("authors")), field("venue", j), field("date", F.concat(F.lit("in "), y.cast("string"))), field("DOI", d), field("link", u)])
