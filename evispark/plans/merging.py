"""Queries that merge what chunks and tracks say of one document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import evidence as E
from .catalog import Tables, query


def chunks(t: Tables):
    """Three events in a row are the chunks of a document; confidences tie often."""
    other = F.when(F.col("event_id") % 4 == 0, "view").otherwise(F.concat(F.lit("k"), (F.col("event_id") % 5).cast("string")))
    name = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.col("event_type"), F.lit(" ")))
    return t.events.select(
        F.floor(F.col("event_id") / 3).alias("document_id"), F.col("event_id").alias("pos"), F.array(other, F.col("event_type")).alias("channels"),
        F.floor(F.col("value") / 100).alias("confidence"), (F.col("value") > 200).alias("relevant"), F.array(name, F.lit("  ")).alias("genes"), F.array(F.lit("K"), other, name).alias("diseases"),
    )


CHUNKS = """c AS (SELECT event_id // 3 AS document_id, event_id AS pos, CASE WHEN event_id % 4 = 0 THEN 'view' ELSE 'k' || (event_id % 5) END AS other, event_type,
    CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type || ' ' END AS name, CAST(floor(value / 100) AS BIGINT) AS confidence, value > 200 AS relevant FROM events)"""


@query(
    "d37_merged_maps",
    f"""WITH {CHUNKS}, v AS (SELECT document_id, pos, 'genes' AS list, 0 AS i, name AS v FROM c UNION ALL SELECT document_id, pos, 'diseases', 0, 'K' FROM c UNION ALL SELECT document_id, pos, 'diseases', 1, other FROM c UNION ALL SELECT document_id, pos, 'diseases', 2, name FROM c),
    f AS (SELECT document_id, list, arg_min(v, pos * 3 + i) AS v, min(pos * 3 + i) AS place FROM v GROUP BY document_id, list, lower(trim(v))),
    r AS (SELECT document_id, bool_or(relevant) AS relevant FROM c GROUP BY document_id)
    SELECT document_id, relevant, string_agg(v, '|' ORDER BY place) FILTER (list = 'genes') AS genes, string_agg(v, '|' ORDER BY place) FILTER (list = 'diseases') AS diseases FROM f JOIN r USING (document_id) GROUP BY ALL""",
)
def _(t: Tables):
    lists = ["genes", "diseases"]
    return E.merge_maps(chunks(t), lists).select("document_id", "relevant", *(F.array_join(c, "|").alias(c) for c in lists))


@query(
    "d38_merged_channels",
    f"""WITH {CHUNKS}, m AS (SELECT *, other IN ('purchase', 'view', 'k1') OR event_type IN ('purchase', 'view', 'k1') AS has FROM c),
    w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY has DESC, confidence DESC, pos) = 1),
    n AS (SELECT document_id, count(*) AS n FROM m GROUP BY document_id),
    e AS (SELECT document_id, channel, min(place) AS place FROM (SELECT document_id, other AS channel, pos * 2 AS place FROM m WHERE has UNION ALL SELECT document_id, event_type, pos * 2 + 1 FROM m WHERE has) GROUP BY document_id, channel),
    u AS (SELECT document_id, string_agg(channel, '|' ORDER BY place) AS joined FROM e GROUP BY document_id)
    SELECT document_id, CASE WHEN n > 1 AND joined IS NOT NULL THEN joined ELSE other || '|' || event_type END AS channels, confidence, pos FROM w JOIN n USING (document_id) LEFT JOIN u USING (document_id)""",
)
def _(t: Tables):
    return E.merge_channels(chunks(t), ["purchase", "view", "k1"]).withColumn("channels", F.array_join("channels", "|"))


@query(
    "j18_track_consistency",
    """WITH g AS (SELECT user_id, event_type, list_distinct(list(CAST(floor(value / 20) AS BIGINT)) FILTER (event_id % 2 = 0)) AS a, list_distinct(list(CAST(floor(value / 20) AS BIGINT)) FILTER (event_id % 2 = 1)) AS b FROM events GROUP BY ALL),
    s AS (SELECT coalesce(list_has_any(a, b), FALSE) AS same FROM g)
    SELECT count(*) AS compared, count(*) FILTER (same) AS agreed, round(count(*) FILTER (same) / count(*), 6) AS rate FROM s""",
)
def _(t: Tables):
    track = F.when(F.col("event_id") % 2 == 0, "original").otherwise("translated")
    return V.track_consistency(t.events.select(F.col("user_id").alias("entry"), track.alias("track"), F.col("event_type").alias("field"), F.floor(F.col("value") / 20).alias("value")))


@query(
    "j16_traceability",
    """WITH i AS (SELECT l_returnflag AS field, l_tax > 0.01 AS has_span, coalesce(l_shipdate >= o_orderdate, FALSE) AS in_source, l_discount > 0.03 AS matched FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey)
    SELECT field, count(*) AS n, round(count(*) FILTER (has_span AND in_source) / count(*), 6) AS cvr, round(count(*) FILTER (has_span AND NOT in_source) / count(*), 6) AS hcr,
           round(count(*) FILTER (has_span AND in_source AND matched) / count(*), 6) AS esr FROM i GROUP BY field""",
)
def _(t: Tables):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    items = joined.select(F.col("l_returnflag").alias("field"), (F.col("l_tax") > 0.01).alias("has_span"), F.coalesce(F.col("l_shipdate") >= F.col("o_orderdate"), F.lit(False)).alias("in_source"), (F.col("l_discount") > 0.03).alias("matched"))
    return V.traceability(items, ["field"])


@query(
    "d34_quality_report",
    """WITH i AS (SELECT l_orderkey AS document_id, CASE WHEN l_tax > 0.02 THEN 'found' WHEN l_returnflag = 'A' THEN 'not_found' WHEN l_returnflag = 'N' THEN 'source_invalid' WHEN l_linestatus = 'O' THEN 'ocr_gap' ELSE 'table_ungrounded' END AS status,
                 l_discount <= 0.01 AS bare, 'f' || l_linenumber AS field_id FROM lineitem),
    g AS (SELECT document_id, count(*) FILTER (status = 'found') AS found, count(*) FILTER (status = 'not_found') AS not_found, count(*) FILTER (status = 'source_invalid') AS source_invalid, count(*) FILTER (status = 'ocr_gap') AS ocr_gap,
                 count(*) FILTER (status = 'table_ungrounded') AS table_ungrounded, count(*) FILTER (status = 'found' AND bare) AS missing_source,
                 concat_ws(',', CASE WHEN NOT bool_or(status = 'found' AND field_id = 'f1') THEN 'f1' END, CASE WHEN NOT bool_or(status = 'found' AND field_id = 'f2') THEN 'f2' END) AS missing_required FROM i GROUP BY document_id)
    SELECT *, source_invalid + ocr_gap + table_ungrounded > 0 AS review, missing_source = 0 AND missing_required = '' AS passed, found > 0 AS scorable FROM g""",
)
def _(t: Tables):
    """Order lines as items: what taxes, flags and discounts say stands for a status and a quoted source."""
    flag = F.col("l_returnflag")
    status = F.when(F.col("l_tax") > 0.02, "found").when(flag == "A", "not_found").when(flag == "N", "source_invalid").when(F.col("l_linestatus") == "O", "ocr_gap").otherwise("table_ungrounded")
    snippet = F.when(F.col("l_discount") > 0.01, F.col("l_shipdate").cast("string"))
    items = t.lineitem.select(F.col("l_orderkey").alias("document_id"), status.alias("status"), snippet.alias("snippet"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field_id"))
    return E.quality_report(items, ["f2", "f1"]).withColumn("missing_required", F.array_join("missing_required", ","))
