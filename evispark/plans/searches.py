"""Queries of searches that stop early and of texts cut into chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as CH
from ..operators import fanout as FO
from .catalog import Tables, query

#: Suppliers are requests and line numbers providers; each lists parts by quantity.
LISTS = """
    WITH b AS (SELECT l_suppkey AS request, l_linenumber AS provider, l_partkey % 40 AS item, CAST(max(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY ALL),
    l AS (SELECT *, row_number() OVER (PARTITION BY request, provider ORDER BY score DESC, item) AS rank FROM b)
"""


def lists(t: Tables):
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("request"), F.col("l_linenumber").alias("provider"), (F.col("l_partkey") % 40).alias("item")).agg(F.max("l_quantity").cast("long").alias("score"))
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("request", "provider").orderBy(F.desc("score"), "item")))


@query(
    "l6_answered",
    f"""{LISTS}, c AS (SELECT request, provider, count(*) AS n FROM l WHERE rank <= 6 AND item % 3 <> provider % 3 GROUP BY ALL), p AS (SELECT DISTINCT request, provider, (provider * 3 + request) % 7 AS done FROM l),
    j AS (SELECT p.request, p.provider, done, coalesce(n, 0) AS n FROM p LEFT JOIN c ON p.request = c.request AND p.provider = c.provider),
    w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY request ORDER BY done, provider ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had, row_number() OVER (PARTITION BY request ORDER BY done, provider) - 1 AS came, count(*) OVER (PARTITION BY request) AS asked FROM j)
    SELECT request, provider, done, n FROM w WHERE NOT (had >= 10 AND came >= greatest(2, asked // 2))""",
)
def _(t: Tables):
    l = lists(t)  # noqa: E741
    counts = l.filter("rank <= 6 AND item % 3 <> provider % 3").groupBy("request", "provider").agg(F.count("*").alias("n"))
    plan = l.select("request", "provider", ((F.col("provider") * 3 + F.col("request")) % 7).alias("done")).distinct()
    return FO.answered(plan, counts, 5)


@query(
    "l9_threshold_depth",
    f"""{LISTS}, g AS (SELECT request, rank AS depth, sum(score) AS bound FROM l GROUP BY ALL), i AS (SELECT request, item, sum(score) AS total, min(rank) AS seen FROM l GROUP BY ALL),
    s AS (SELECT g.request, g.depth FROM g JOIN i ON i.request = g.request AND i.seen <= g.depth AND i.total >= g.bound GROUP BY ALL HAVING count(*) >= 10)
    SELECT e.request, coalesce(min(s.depth), any_value(e.deepest)) AS depth FROM (SELECT request, max(rank) AS deepest FROM l GROUP BY 1) AS e LEFT JOIN s ON s.request = e.request GROUP BY e.request""",
)
def _(t: Tables):
    return FO.threshold_depth(lists(t), 10)


@query("l9_top_items", f"{LISTS}, i AS (SELECT request, item, CAST(sum(score) AS BIGINT) AS score FROM l GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS place FROM i QUALIFY place <= 10")
def _(t: Tables):
    return FO.top_items(lists(t), 10)


@query("h103_block_chunks")
def _(t: Tables):
    """Conversations as lists of blocks, their turns, in chunks of 120 tokens."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda b: b["text"])
    rows = t.conversations.groupBy("conv_id").agg(blocks.alias("blocks"))
    return CH.block_chunks(rows, F.col("blocks"), 120, 30).select("conv_id", "chunk", "n_chunks", F.md5(F.col("body").cast("binary")).alias("body_md5"), F.array_join(F.col("block_indices").cast("array<string>"), ",").alias("block_indices"))


@query("h101_text_chunks")
def _(t: Tables):
    """Every document in chunks of 100 tokens."""
    return CH.text_chunks(t.documents.select("doc_id", "text"), F.col("text"), 100).select("doc_id", "chunk", "n_chunks", F.length("body").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("body_md5"))
