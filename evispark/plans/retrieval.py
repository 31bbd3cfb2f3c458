"""Queries of retrieval: surroundings of every brand's first part, what orders cite of them, rows of scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from .catalog import Tables, query
from .graphs import LINKS, part_links


def part_nodes(t: Tables):
    """Parts as nodes: promoted ones are evidence, economy ones documents, the others terms."""
    kind = F.when(F.col("p_type") == "PROMO", "Evidence").when(F.col("p_type") == "ECONOMY", "Document").otherwise("Term")
    return t.part.select(F.col("p_partkey").alias("node"), F.array(F.col("p_type"), kind).alias("labels"), "p_brand", "p_size", F.col("p_name").alias("quote"))


def around_brands(t: Tables, mode: str):
    seeds = t.part.groupBy(F.col("p_brand").alias("target")).agg(F.min("p_partkey").alias("node"))
    return R.surroundings(part_nodes(t), part_links(t), seeds, 2, 200, mode)


AROUND = f"""{LINKS}, u AS MATERIALIZED (SELECT src, dst FROM c UNION SELECT dst, src FROM c),
    w AS (SELECT p_brand AS target, min(p_partkey) AS node, 0 AS depth FROM part GROUP BY p_brand UNION SELECT w.target, u.dst, depth + 1 FROM w JOIN u ON u.src = w.node WHERE depth < 2),
    n AS MATERIALIZED (SELECT target, node, min(depth) AS depth FROM w GROUP BY target, node QUALIFY row_number() OVER (PARTITION BY target ORDER BY min(depth), node) <= 200)"""
TERMS = "k AS MATERIALIZED (SELECT n.* FROM n JOIN part ON p_partkey = node WHERE p_type NOT IN ('PROMO', 'ECONOMY'))"


@query("k5_find_nodes", "SELECT p_partkey AS node, p_brand, p_size, p_name AS quote FROM part WHERE p_type = 'PROMO' AND p_size = 10 ORDER BY p_partkey LIMIT 100")
def _(t: Tables):
    return R.find_nodes(part_nodes(t), ("PROMO", "Evidence"), {"p_size": 10}, 100).drop("labels")


@query("k6_surroundings", f"WITH RECURSIVE {AROUND} SELECT target, node, depth FROM n")
def _(t: Tables):
    return around_brands(t, "full")[0]


@query("k6_terminology_edges", f"WITH RECURSIVE {AROUND}, {TERMS} SELECT a.target, src, dst FROM c JOIN k AS a ON a.node = src JOIN k AS b ON b.node = dst AND b.target = a.target")
def _(t: Tables):
    return around_brands(t, "terminology_only")[1]


@query(
    "k8_citations",
    f"""WITH RECURSIVE {AROUND}
    SELECT l_orderkey AS answer, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INTEGER) AS place, l_partkey AS node, nullif(p_name, '') AS quote
    FROM lineitem JOIN n ON target = 'Brand#' || (1 + l_orderkey % 25) AND node = l_partkey JOIN part ON p_partkey = l_partkey WHERE p_type = 'PROMO'""",
)
def _(t: Tables):
    """Each order is an answer about one brand and names its parts line by line."""
    target = F.concat(F.lit("Brand#"), (F.col("l_orderkey") % 25 + 1).cast("string"))
    answers = t.lineitem.select(F.col("l_orderkey").alias("answer"), target.alias("target"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("node"))
    return R.citations(answers, around_brands(t, "full")[0], part_nodes(t).filter(R.labelled(["Evidence"])), ["quote"])


@query(
    "c45_scoped_or_full",
    """WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority = '1-URGENT' AS scoped, coalesce(o_totalprice > 250000, FALSE) AS matches FROM orders),
    g AS (SELECT o_custkey, bool_or(scoped AND matches) AS s, bool_or(matches) AS f FROM r GROUP BY o_custkey)
    SELECT o_orderkey, r.o_custkey, matches FROM r JOIN g ON r.o_custkey IS NOT DISTINCT FROM g.o_custkey WHERE (f AND NOT s) OR scoped""",
)
def _(t: Tables):
    rows = t.orders.withColumn("matches", F.coalesce(F.col("o_totalprice") > 250000, F.lit(False)))
    pick = ["o_orderkey", "o_custkey", "matches"]
    return R.scoped_or_full(rows.filter("o_orderpriority = '1-URGENT'").select(*pick), rows.select(*pick), "o_custkey")
