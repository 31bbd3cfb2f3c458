"""Queries of bindings and of the stored literature graph: orders as runs, their lines as items, parts as entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backfill as B
from .catalog import Tables, query

KINDS = {"STANDARD": "Gene", "SMALL": "Variant", "LARGE": "Disease", "MEDIUM": "Phenotype"}


def bound(t: Tables):
    """Parts and suppliers match by their ids; each line that names the part is a row of the match."""
    role = F.when(F.col("p_size") % 3 == 0, "subject").when(F.col("p_size") % 3 == 1, "object")
    matches = t.part.select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") > 2, F.col("p_partkey")).alias("entity_id"), F.col("p_type").alias("entity_type"), role.alias("role"), F.col("p_name").alias("raw_text"))
    return B.bindings(matches, t.lineitem.select(F.col("l_partkey").alias("key"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id")))


BOUND = """b AS (SELECT l_orderkey || '-' || l_linenumber AS item_id, l_orderkey, p_partkey AS entity_id, p_type AS entity_type, CASE p_size % 3 WHEN 0 THEN 'subject' WHEN 1 THEN 'object' END AS role, 0 AS binding_rank, p_name AS raw_text
    FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size > 2),
    i AS (SELECT DISTINCT 'evidence:' || l_orderkey || '-' || l_linenumber AS src, 'document:' || o_custkey AS document, 'run:' || o_orderkey AS run, l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'),
    l AS (SELECT DISTINCT src, CASE WHEN entity_id % 4 = 0 THEN entity_type || ':x' || entity_id ELSE 'entity:' || entity_id END AS dst, role, CASE entity_type WHEN 'STANDARD' THEN 'Gene' WHEN 'SMALL' THEN 'Variant' WHEN 'LARGE' THEN 'Disease' ELSE 'Phenotype' END AS kind
    FROM b JOIN i ON src = 'evidence:' || item_id WHERE entity_type IN ('STANDARD', 'SMALL', 'LARGE', 'MEDIUM'))"""


def stored_graph(t: Tables):
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    items = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"), F.col("l_orderkey").alias("run_id"))
    external = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).otherwise("")
    entities = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("entity_type"), external.alias("external_id"))
    return B.literature_graph(runs, items, bound(t), entities, KINDS)


@query("e14_bindings", f"WITH {BOUND} SELECT item_id, entity_id, entity_type, role, binding_rank, raw_text FROM b")
def _(t: Tables):
    return bound(t)


@query("e39_graph_nodes", f"WITH {BOUND} SELECT 'document:' || o_custkey AS node, 'Document' AS kind FROM orders WHERE o_orderstatus = 'F' UNION SELECT 'run:' || o_orderkey, 'ProcessingRun' FROM orders WHERE o_orderstatus = 'F' UNION SELECT src, 'Evidence' FROM i UNION SELECT dst, kind FROM l")
def _(t: Tables):
    return stored_graph(t)[0]


@query("e39_graph_edges", f"WITH {BOUND} SELECT src, document AS dst, 'FROM_DOCUMENT' AS relation, NULL AS role FROM i UNION SELECT src, run, 'FROM_RUN', NULL FROM i UNION SELECT src, dst, CASE WHEN role = 'subject' THEN 'SUPPORTS' ELSE 'MENTIONS' END, role FROM l")
def _(t: Tables):
    return stored_graph(t)[1]
