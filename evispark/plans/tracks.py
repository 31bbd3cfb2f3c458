"""Queries of spans within spans, and of sketches kept by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches as SK
from ..operators import sweep as SW
from .catalog import Tables, query


def line_spans(t: Tables):
    """Suppliers as documents: each of their order lines is a span of parts, and a point within some of them.

    Of lines of one id the first in the table counts, by file and place in it, whichever tasks read them.
    """
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("_place")
    lines = t.lineitem.select(F.expr("l_orderkey * 10 + l_linenumber").alias("id"), place, F.struct(F.col("l_suppkey").alias("document"), F.col("l_partkey").alias("start"), F.col("l_quantity").cast("long").alias("q"), F.expr("CAST(l_linenumber AS BIGINT)").alias("n")).alias("_line"))
    rows = lines.groupBy("id").agg(F.min_by("_line", "_place").alias("_line")).select("id", "_line.*")
    spans = rows.select("document", F.col("id").alias("span"), "start", (F.col("start") + F.col("q") * 8).alias("stop"), (F.col("start") * 3).alias("o_start"), (F.col("start") * 3 + F.col("q") * 7).alias("o_stop"))
    points = rows.select("document", F.col("id").alias("point"), (F.col("start") + F.col("q")).alias("start"), (F.col("start") + F.col("q") + F.col("n") * 4 - 4).alias("stop"))
    return points, spans


SPANS = """
    WITH r AS (SELECT DISTINCT ON (id) * FROM (SELECT l_suppkey AS document, l_orderkey * 10 + l_linenumber AS id, l_partkey AS start, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n FROM lineitem) ORDER BY id),
    s AS (SELECT document, id AS span, start, start + q * 8 AS stop, start * 3 AS o_start, start * 3 + q * 7 AS o_stop FROM r), p AS (SELECT document, id AS point, start + q AS start, start + q + n * 4 - 4 AS stop FROM r),
    j AS (SELECT p.document, point, span, s.start, s.stop, s.o_start, s.o_stop, p.start AS p_start, p.stop AS p_stop FROM p JOIN s ON p.document = s.document AND s.start <= p.start AND greatest(p.stop, p.start + 1) <= s.stop)
"""


@query("e21_narrowest_pair", f"{SPANS} SELECT document, point, arg_min(span, (stop - start, start, span)) AS span FROM j GROUP BY ALL")
def _(t: Tables):
    return SW.containing(*line_spans(t), ["document"], width=512)


@query("e22_projected", f"{SPANS} SELECT document, point, span, least(o_start + p_start - start, o_stop) AS o_from, least(o_start + p_stop - start, o_stop) AS o_to FROM j QUALIFY row_number() OVER (PARTITION BY document, point ORDER BY stop - start, start, span) = 1")
def _(t: Tables):
    return SW.projected(*line_spans(t), ["document"], width=512)


@query("e23_first_block", f"{SPANS} SELECT document, point, arg_min(span, (start, span)) AS span FROM j GROUP BY ALL")
def _(t: Tables):
    return SW.containing(*line_spans(t), ["document"], narrowest=False, width=512)


@query(
    "n_merged_sketches",
    """SELECT event_type, count(*) AS n, TRUE AS distinct_close, TRUE AS median_close, count(DISTINCT user_id) AS users FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-03' GROUP BY event_type""",
)
def _(t: Tables):
    """Users and values of each kind of event from the third day on, from sketches by day; held against the exact figures."""
    kept = SK.daily(t.events, F.to_date("ts"), ["event_type"], "user_id", "value")
    found = SK.merged(kept.filter("day >= DATE '2024-01-03'"), ["event_type"], [0.45, 0.55])
    exact = t.events.filter(F.to_date("ts") >= F.lit("2024-01-03").cast("date")).groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.percentile("value", F.lit(0.5)).alias("median"))
    j = found.join(exact, "event_type")
    near = F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(1.0), 0.06 * F.col("users"))
    return j.select("event_type", "n", near.alias("distinct_close"), ((F.col("median") >= F.get("quantiles", F.lit(0))) & (F.col("median") <= F.get("quantiles", F.lit(1)))).alias("median_close"), "users")
