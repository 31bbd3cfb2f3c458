"""Readers of reference vocabularies: each gives entries and aliases as DataFrames.

Entry columns: entity_type, source_db, external_id, display_name, normalized_name, version.  Alias columns:
external_id, entity_type, source_db, alias_text, normalized_alias, alias_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hgvs
from ..functions.text import lookup_text


def lines_from_header(spark: SparkSession, path: str, header_prefix: str, sep: str) -> DataFrame:
    """Rows of a delimited text below prose: the header is the first line that starts with the prefix (a ``#`` aside)."""
    text = spark.read.text(path)
    bare = F.regexp_replace("value", r'^\s*#?\s*"?', "")
    header = text.filter(F.startswith(bare, F.lit(header_prefix))).select(bare.alias("h")).first()
    if header is None:
        return spark.createDataFrame([], "value string")
    names = [n.strip().strip('"') for n in header["h"].split(sep)]
    schema = ", ".join(f"`{n}` STRING" for n in names)
    body = text.filter(~F.startswith("value", F.lit("#")) & ~F.startswith(bare, F.lit(header_prefix)) & (F.size(F.split("value", f"\\{sep}" if sep != "\t" else "\t")) >= len(names) - 1))
    return body.select(F.from_csv("value", F.lit(schema), {"sep": sep, "mode": "PERMISSIVE"}).alias("r")).select("r.*")


def _entry(kind: str, source: str, external: Column, name: Column, normalized: Column, version: str) -> list[Column]:
    return [F.lit(kind).alias("entity_type"), F.lit(source).alias("source_db"), external.alias("external_id"), name.alias("display_name"), normalized.alias("normalized_name"), F.lit(version).alias("version")]


def _listed(c: str, sep: str = ",") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def genes(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Gene symbols from a TSV with id, approved symbol, aliases and previous symbols; rows without id or symbol are dropped."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    rows = raw.filter((F.trim("HGNC ID") != "") & (F.trim("Approved symbol") != "")).withColumns({"id": F.concat(F.lit("HGNC:"), F.trim("HGNC ID")), "sym": F.trim("Approved symbol")})
    entries = rows.select(*_entry("gene", "HGNC", F.col("id"), F.col("sym"), F.upper(lookup_text(F.col("sym"))), version))
    kinds = F.concat(
        F.array(F.struct(F.col("sym").alias("alias_text"), F.lit("primary").alias("alias_type"))),
        F.transform(_listed("Alias symbols"), lambda x: F.struct(x.alias("alias_text"), F.lit("alias").alias("alias_type"))),
        F.transform(_listed("Previous symbols"), lambda x: F.struct(x.alias("alias_text"), F.lit("previous_symbol").alias("alias_type"))),
    )
    flat = rows.select("id", F.explode(kinds).alias("a")).select(F.col("id").alias("external_id"), F.lit("gene").alias("entity_type"), F.lit("HGNC").alias("source_db"), "a.alias_text", "a.alias_type")
    return entries, flat.withColumn("normalized_alias", F.upper(lookup_text(F.col("alias_text"))))


def diseases(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Disease titles: ``;;`` and ``;`` separate names; the first is the preferred one; equal normal forms count once."""
    raw = lines_from_header(spark, path, "Prefix", "\t")
    titles = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";+"), lambda x: F.trim(F.regexp_replace(x, r",\s*INCLUDED\s*$", ""))), lambda x: x != "")
    rows = raw.filter(F.trim("MIM Number") != "").withColumn("names", F.array_distinct(F.concat(titles("Preferred Title; symbol"), titles("Alternative Title(s); symbol(s)")))).filter(F.size("names") > 0)
    external = F.concat(F.lit("OMIM:"), F.trim("MIM Number"))
    entries = rows.select(*_entry("disease", "OMIM", external, F.col("names")[0], lookup_text(F.col("names")[0]), version))
    flat = rows.select(external.alias("external_id"), F.posexplode("names").alias("pos", "alias_text")).withColumn("normalized_alias", lookup_text(F.col("alias_text")))
    first = flat.groupBy("external_id", "normalized_alias").agg(F.min(F.struct("pos", "alias_text")).alias("f"))
    aliases = first.select("external_id", F.lit("disease").alias("entity_type"), F.lit("OMIM").alias("source_db"), F.col("f.alias_text").alias("alias_text"), F.when(F.col("f.pos") == 0, "primary").otherwise("alias").alias("alias_type"), "normalized_alias")
    return entries, aliases


def phenotypes(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Terms of an OBO file (stanzas between blank lines): phenotype ids that have a name and are not obsolete."""
    stanza = spark.read.option("lineSep", "\n\n").text(path)
    pick = lambda p: F.nullif(F.trim(F.regexp_extract("value", p, 1)), F.lit(""))
    term = stanza.filter(F.rlike("value", F.lit(r"(?m)^\[Term\]\s*$"))).select(pick(r"(?m)^id: (HP:\S+)").alias("id"), pick(r"(?m)^name: (.*)$").alias("name"), F.rlike("value", F.lit(r"(?m)^is_obsolete: true")).alias("gone"))
    return _phenotype_tables(term.filter("id IS NOT NULL AND name IS NOT NULL AND NOT gone"), version)


def phenotypes_json(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Terms of an OBO-graph JSON file: nodes with a phenotype id and a label; obsolete ones are not told apart."""
    schema = "graphs ARRAY<STRUCT<nodes: ARRAY<STRUCT<id: STRING, lbl: STRING>>>>"
    nodes = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("graphs").alias("g")).select(F.explode("g.nodes").alias("n"))
    term = nodes.select(F.replace(F.regexp_extract("n.id", r"(HP_\d+)$", 1), F.lit("_"), F.lit(":")).alias("id"), F.trim("n.lbl").alias("name")).filter("id <> '' AND name <> ''")
    return _phenotype_tables(term, version)


def _phenotype_tables(term: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    entries = term.select(*_entry("phenotype", "HPO", F.col("id"), F.col("name"), lookup_text(F.col("name")), version))
    aliases = term.select(F.col("id").alias("external_id"), F.lit("phenotype").alias("entity_type"), F.lit("HPO").alias("source_db"), F.col("name").alias("alias_text"), F.lit("name").alias("alias_type"), lookup_text(F.col("name")).alias("normalized_alias"))
    return entries, aliases


#: Review states that carry no star.
ZERO_STAR = ["no assertion provided", "no assertion criteria provided", "no classification provided", "no classification for the single variant", "no classifications from unflagged records", "-", ""]


def variants(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Variants of a summary TSV with at least one star; aliases are the coding and protein parts of the name and the rs id."""
    raw = lines_from_header(spark, path, "AlleleID", "\t")
    kept = raw.filter(~F.lower(F.trim("ReviewStatus")).isin(ZERO_STAR) & (F.trim("VariationID") != ""))
    external = F.concat(F.lit("ClinVar:"), F.trim("VariationID"))
    entries = kept.select(*_entry("variant", "ClinVar", external, F.col("Name"), F.col("Name"), version), F.col("GeneSymbol").alias("gene_symbol"), hgvs.review_stars(F.col("ReviewStatus")).alias("stars")).dropDuplicates(["external_id"])
    names = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(c.alias("alias_text"), F.lit(k).alias("alias_type"))) for c, k in ((hgvs.coding_part(F.col("Name")), "name"), (hgvs.protein_part(F.col("Name")), "name"), (hgvs.rsid(F.col("`RS# (dbSNP)`")), "rsid")))))
    aliases = kept.select(external.alias("external_id"), F.explode(names).alias("a")).select("external_id", F.lit("variant").alias("entity_type"), F.lit("ClinVar").alias("source_db"), "a.alias_text", "a.alias_type", F.col("a.alias_text").alias("normalized_alias")).distinct()
    return entries, aliases


def ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels: label, node; the last of equal labels wins) and (edges: src child, dst parent) of an OBO-graph JSON file."""
    schema = "graphs ARRAY<STRUCT<nodes: ARRAY<STRUCT<id: STRING, lbl: STRING>>, edges: ARRAY<STRUCT<sub: STRING, pred: STRING, obj: STRING>>>>"
    graph = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("graphs").alias("g"))
    short = lambda c: F.replace(F.regexp_extract(c, r"([A-Z]+_\d+)$", 1), F.lit("_"), F.lit(":"))
    nodes = graph.select(F.posexplode("g.nodes").alias("pos", "n")).filter("n.lbl IS NOT NULL")
    labels = nodes.groupBy(F.lower(F.trim("n.lbl")).alias("label")).agg(F.max_by(short("n.id"), "pos").alias("node"))
    edges = graph.select(F.explode("g.edges").alias("e")).filter("e.pred = 'is_a'").select(short("e.sub").alias("src"), short("e.obj").alias("dst"))
    return labels, edges.filter("src <> '' AND dst <> ''").distinct()
