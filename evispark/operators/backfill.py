"""The literature graph of runs from what is stored: items, their bindings to entities, and the entities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bindings(matches: DataFrame, rows: DataFrame) -> DataFrame:
    """(item_id, entity_id, entity_type, role, binding_rank, raw_text): each match (key, entity_id, entity_type, role, raw_text)
    with each row (key, item_id) it came from; matches without an entity or without rows bind nothing."""
    joined = matches.filter("entity_id IS NOT NULL").join(rows.select("key", "item_id"), "key")
    return joined.select("item_id", "entity_id", "entity_type", "role", F.lit(0).alias("binding_rank"), "raw_text")


def literature_graph(runs: DataFrame, items: DataFrame, bound: DataFrame, entities: DataFrame, kinds: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(node, kind) and (src, dst, relation, role) of completed runs (run_id, document_id, status).

    Items (item_id, run_id) are evidence from their document and run.  A binding (item_id, entity_id, role) of a subject
    supports its entity (entity_id, entity_type, external_id: its name where it has one), any other mentions it; entities that are unknown, or whose type
    ``kinds`` does not name, are left out.  Nodes and edges occur once.  Joins are by the ids of runs, items and entities only;
    a frequent entity is a skewed key of an inner join whose other side is unique, which adaptive execution splits.
    """
    done = runs.filter("status = 'completed'").select("run_id", "document_id")
    mine = items.select("item_id", "run_id").join(done, "run_id")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    evidence, document, run = name("evidence", "item_id"), name("document", "document_id"), name("run", "run_id")
    known = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    outside = F.nullif(F.col("external_id").cast("string"), F.lit(""))
    entity = F.coalesce(F.concat("entity_type", F.lit(":"), outside), name("entity", "entity_id"))
    named = entities.select("entity_id", known[F.col("entity_type")].alias("kind"), entity.alias("entity")).filter("kind IS NOT NULL")
    links = bound.select("item_id", "entity_id", "role").join(mine.select("item_id"), "item_id", "left_semi").join(named, "entity_id")

    # A run is a node whether or not it has items.
    of_runs = done.select(F.explode(F.array(F.struct(document.alias("node"), F.lit("Document").alias("kind")), F.struct(run.alias("node"), F.lit("ProcessingRun").alias("kind")))).alias("n")).select("n.*")
    nodes = of_runs.unionByName(mine.select(evidence.alias("node"), F.lit("Evidence").alias("kind"))).unionByName(links.select(F.col("entity").alias("node"), "kind")).distinct()
    none = F.lit(None).cast("string").alias("role")
    sources = F.array(F.struct(document.alias("dst"), F.lit("FROM_DOCUMENT").alias("relation")), F.struct(run.alias("dst"), F.lit("FROM_RUN").alias("relation")))
    provenance = mine.select(evidence.alias("src"), F.explode(sources).alias("e")).select("src", "e.dst", "e.relation", none)
    relation = F.when(F.col("role") == "subject", "SUPPORTS").otherwise("MENTIONS")
    return nodes, provenance.unionByName(links.select(evidence.alias("src"), F.col("entity").alias("dst"), relation.alias("relation"), "role")).distinct()
