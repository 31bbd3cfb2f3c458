"""Queries of parsers, order-dependent operators, health windows and job states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as O
from ..sources import blocks as B
from ..sources import literature as L
from ..streaming import health as S
from .catalog import Tables, query


@query("a19_tables", "SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS row, CAST(l_partkey AS VARCHAR) || '|' || l_returnflag || ' & ' || l_linestatus AS cells FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 0, 'part|flag' FROM lineitem")
def _(t: Tables):
    """Orders written as HTML tables and read back."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("<tr><td> "), "l_partkey", F.lit("</td><td><b>"), "l_returnflag", F.lit("</b> &amp; "), "l_linestatus", F.lit("</td></tr>")).alias("tr"))
    rows = F.transform(F.array_sort(F.collect_list(line)), lambda r: r["tr"])
    html = t.lineitem.groupBy("l_orderkey").agg(F.concat(F.lit("<table><thead><tr><th>part</th><th>flag</th></tr></thead><tr></tr>"), F.array_join(rows, "\n"), F.lit("</table>")).alias("html"))
    cells = html.select("l_orderkey", F.posexplode(B.html_rows("html")).alias("row", "cells"))
    return cells.select("l_orderkey", F.col("row").cast("long").alias("row"), F.array_join("cells", "|").alias("cells"))


@query("a20_table_markdown")
def _(t: Tables):
    return t.pages.select("page_id", F.md5(B.html_markdown("html").cast("binary")).alias("h"))


@query("a23_markdown")
def _(t: Tables):
    rows = t.documents.select("doc_id", F.posexplode(B.blocks_of_markdown("text")).alias("pos", "b"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "b.type", F.length("b.text").alias("n_chars"))


@query("c8_body_text")
def _(t: Tables):
    return B.body_lines(t.documents, "doc_id", "text", r"^[A-Z].{80,}", r"rights reserved|^Licensed under").select("doc_id", F.length("body").alias("n_chars"))


@query("a31_log_lines", "SELECT event_type AS level, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    lines = t.events.select(F.concat(F.lit("2024 | "), F.upper("event_type"), F.lit(" | mod.py:1 - took "), F.col("value").cast("string")).alias("value"))
    pattern = r"\|\s*([A-Z]+)\s*\|\s*(\S+)\s+-\s+(.*)$"
    parsed = lines.select(F.lower(F.regexp_extract("value", pattern, 1)).alias("level"), L.template(F.regexp_extract("value", pattern, 3)).alias("template"))
    return parsed.filter("template = 'took <num>'").groupBy("level").agg(F.count("*").alias("n"))


@query("a32_items", "SELECT p_partkey, 'crossref' AS provider, p_name AS title, 1990 + p_size % 30 AS year, '10.1000/' || CAST(p_partkey AS VARCHAR) AS doi FROM part")
def _(t: Tables):
    raw = F.to_json(F.struct(F.array("p_name").alias("title"), F.concat(F.lit("10.1000/"), F.col("p_partkey").cast("string")).alias("DOI"), (1990 + F.col("p_size") % 30).alias("issued")))
    rec = t.part.select(F.lit("crossref").alias("provider"), raw.alias("raw"))
    return L.items(rec).select(F.substring_index("doi", "/", -1).cast("long").alias("p_partkey"), "provider", "title", "year", "doi")


@query("g1_dedupe")
def _(t: Tables):
    """A conversation is a request, and its turns are candidates in order, known by their text and by their first word."""
    c = t.conversations.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("h"), F.lower(F.split("text", " ")[0]).alias("word"))
    return O.dedupe_any_key(c, "conv_id", "turn", ["h", "word"]).select("conv_id", "turn")


@query("g9_adjacent")
def _(t: Tables):
    return O.dedupe_adjacent(t.conversations.select("conv_id", "turn", "text"), "conv_id", "turn", "text", least=0.3).select("conv_id", "turn")


@query("f11_merge_facts")
def _(t: Tables):
    e = t.events.select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id", "value", F.when(F.col("event_id") % 3 > 0, F.col("props")).alias("source"))
    return O.merge_facts(e, ["user_id", "event_type", "day"], "event_id", "value", "source").select("user_id", "event_type", "event_id", "value", "source")


NOW = "TIMESTAMP '2024-01-15 12:00:00'"


def calls(t: Tables):
    return t.events.select((F.col("user_id") % 10).alias("provider"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency_ms"))


CALLS = "c AS (SELECT user_id % 10 AS provider, event_id, ts, event_type <> 'error' AS success, value AS latency_ms FROM events)"


@query(
    "l1_health_window",
    f"WITH {CALLS} SELECT provider, count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE NOT success) AS failures, round(count(*) FILTER (WHERE success) / count(*), 6) AS rate, round(avg(latency_ms), 6) AS latency_ms FROM c WHERE ts <= {NOW} AND ts >= {NOW} - INTERVAL 3600 SECONDS GROUP BY provider",
)
def _(t: Tables):
    s = S.stats(calls(t), F.expr(NOW))
    return s.select("provider", "successes", "failures", F.round("rate", 6).alias("rate"), F.round("latency_ms", 6).alias("latency_ms"))


@query(
    "l2_sliding_rates",
    f"WITH {CALLS} SELECT event_id, count(*) OVER w AS n, count(*) FILTER (WHERE NOT success) OVER w AS failures FROM c WINDOW w AS (PARTITION BY provider ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)",
)
def _(t: Tables):
    return S.sliding_rates(calls(t)).select("event_id", "n", "failures")


@query(
    "l3_circuit",
    f"WITH {CALLS}, s AS (SELECT provider, count(*) FILTER (WHERE NOT success) AS f, count(*) FILTER (WHERE success) / count(*) AS r, max(ts) FILTER (WHERE NOT success) AS last FROM c WHERE ts <= {NOW} AND ts >= {NOW} - INTERVAL 3600 SECONDS GROUP BY provider) SELECT provider, f >= 3 AND r < 0.3 AND coalesce(last > {NOW} - INTERVAL 120 SECONDS, false) AS skip FROM s",
)
def _(t: Tables):
    return S.should_skip(S.stats(calls(t), F.expr(NOW)), F.expr(NOW))


@query(
    "l14_transitions",
    """
    WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status FROM events),
         p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM s)
    SELECT user_id, event_id, previous, status FROM p WHERE previous IS NOT NULL AND previous <> status
      AND previous || '>' || status NOT IN ('queued>running', 'queued>cancelled', 'running>completed', 'running>failed', 'running>cancelled', 'running>queued', 'failed>queued', 'cancelled>queued')
    """,
)
def _(t: Tables):
    e = F.col("event_type")
    status = F.when(e == "signup", "queued").when(e == "view", "running").when(e == "click", "completed").when(e == "error", "failed").otherwise("cancelled")
    return S.violations(t.events.select("user_id", "event_id", status.alias("status")), "user_id", ["event_id"], "status")


@query("l17_cache_lookup", "SELECT d.doc_id, c.n FROM documents d LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY source) c ON c.source = d.source")
def _(t: Tables):
    cache = t.documents.filter("doc_id % 2 = 0").groupBy("source").agg(F.count("*").alias("n"))
    return t.documents.join(cache, "source", "left").select("doc_id", "n")


@query("l18_invalidate", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t: Tables):
    gone = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(gone, "o_custkey", "left_anti").select("o_orderkey")
