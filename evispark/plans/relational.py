"""Queries of the relational operators: search, rollups, upserts, gates, windows, joins, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import relational as R
from .catalog import Tables, query


@query(
    "d1_group_search",
    """
    SELECT user_id AS group_id, count(*) AS n_items, round(avg(value), 6) AS mean_value, arg_min(event_id, ts) AS oldest_id,
           arg_min(value, event_id) FILTER (event_type = 'view') AS first_view,
           arg_min(value, event_id) FILTER (event_type = 'click') AS first_click,
           arg_min(value, event_id) FILTER (event_type = 'purchase') AS first_purchase
    FROM events WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY user_id LIMIT 100
    """,
)
def _(t: Tables):
    pick = lambda k: F.min_by(F.when(F.col("event_type") == k, F.col("value")), F.when(F.col("event_type") == k, F.col("event_id")))
    groups = t.events.filter("user_id IS NOT NULL").groupBy(F.col("user_id").alias("group_id")).agg(
        F.count("*").alias("n_items"), F.round(F.avg("value"), 6).alias("mean_value"), F.min_by("event_id", "ts").alias("oldest_id"),
        pick("view").alias("first_view"), pick("click").alias("first_click"), pick("purchase").alias("first_purchase"),
    )
    return R.page(groups, [F.asc("group_id")], 1, 100)


@query(
    "d2_nested_rollup",
    """
    SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR) || ':' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS items,
           CAST(max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) AS INTEGER) AS worst, count(*) AS n
    FROM lineitem GROUP BY l_orderkey
    """,
)
def _(t: Tables):
    item = F.struct("l_linenumber", "l_partkey", F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("long").cast("string")).alias("s"))
    return t.lineitem.groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), ",").alias("items"),
        F.max(R.decode(F.col("l_returnflag"), {"R": 2, "A": 1}, 0)).alias("worst"), F.count("*").alias("n"),
    )


@query(
    "d3_variant_aggregate",
    """
    WITH s AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS site FROM part),
         j AS (SELECT s.site, l.* FROM s JOIN lineitem l ON l.l_partkey = s.p_partkey)
    SELECT site, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders,
           round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_discount
    FROM j GROUP BY site
    """,
)
def _(t: Tables):
    sites = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("site"))
    j = t.lineitem.join(sites, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("site").agg(F.count("*").alias("n_rows"), F.countDistinct("l_orderkey").alias("n_orders"), F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("weighted_discount"))


@query(
    "d4_review_progress",
    """
    SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS approved, count(*) FILTER (WHERE o_orderstatus = 'O') AS provisional, count(*) FILTER (WHERE o_orderstatus = 'P') AS corrected,
           round(count(*) FILTER (WHERE o_orderstatus <> 'O') / count(*), 6) AS reviewed_ratio
    FROM orders GROUP BY o_custkey
    """,
)
def _(t: Tables):
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_custkey").agg(F.count_if(s == "F").alias("approved"), F.count_if(s == "O").alias("provisional"), F.count_if(s == "P").alias("corrected"), F.round(F.count_if(s != "O") / F.count("*"), 6).alias("reviewed_ratio"))


@query(
    "d5_worst_status",
    """
    SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN 1 ELSE 0 END) WHEN 2 THEN 'corrected' WHEN 1 THEN 'approved' ELSE 'provisional' END AS status
    FROM orders GROUP BY o_custkey
    """,
)
def _(t: Tables):
    worst = F.max(R.decode(F.col("o_orderstatus"), {"P": 2, "F": 1}, 0))
    return t.orders.groupBy("o_custkey").agg(F.when(worst == 2, "corrected").when(worst == 1, "approved").otherwise("provisional").alias("status"))


@query(
    "d6_cross_stats",
    """
    WITH g AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS a, list(DISTINCT o_orderstatus) AS b FROM orders GROUP BY o_custkey),
         x AS (SELECT o_custkey, unnest(a) AS a, b FROM g), y AS (SELECT o_custkey, a, unnest(b) AS b FROM x)
    SELECT count(*) AS n_pairs, count(DISTINCT (a, b)) AS n_distinct FROM y
    """,
)
def _(t: Tables):
    g = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"), F.collect_set("o_orderstatus").alias("b"))
    pairs = g.select("o_custkey", F.explode("a").alias("a"), "b").select("o_custkey", "a", F.explode("b").alias("b"))
    return pairs.agg(F.count("*").alias("n_pairs"), F.countDistinct("a", "b").alias("n_distinct"))


@query("d7_candidates", "SELECT 'brand' AS kind, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY p_type")
def _(t: Tables):
    """Distinct values as rows: no task holds a whole set."""
    values = F.explode(F.array(F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("value")), F.struct(F.lit("type").alias("kind"), F.col("p_type").alias("value"))))
    return t.part.select(values.alias("v")).groupBy("v.kind", "v.value").agg(F.count("*").alias("n"))


@query("d8_group_pairs", "SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY user_id, event_type")
def _(t: Tables):
    return group_pairs_rows(t, t.events)


@query("d8_group_pairs_whole")
def _(t: Tables):
    return group_pairs_rows(t, t.events)


def group_pairs_rows(t: Tables, events):
    return R.first_wins(events.select("user_id", "event_type", F.col("event_id").alias("first_id")), ["user_id", "event_type"], "first_id")


@query(
    "d9_latest_histograms",
    """
    WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
    SELECT event_type, CAST(floor(value / 50) AS BIGINT) AS bucket, count(*) AS n, round(avg(value), 6) AS mean_value FROM l GROUP BY ALL
    """,
)
def _(t: Tables):
    latest = R.top_one(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return latest.groupBy("event_type", F.floor(F.col("value") / 50).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("d28_audit", "SELECT 'c_custkey' AS name, count(c_custkey) AS n FROM customer UNION ALL SELECT 'c_name', count(c_name) FROM customer UNION ALL SELECT 'c_nationkey', count(c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', count(c_acctbal) FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment) FROM customer UNION ALL SELECT 'duplicate_keys', count(*) FROM (SELECT 1 FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1)")
def _(t: Tables):
    return R.profile(t.customer, ["c_nationkey", "c_mktsegment"])


@query(
    "d31_reason_counts",
    """
    WITH r AS (SELECT unnest(list_filter([CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax = 0 THEN 'untaxed' END, CASE WHEN l_quantity > 45 THEN 'bulk' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem)
    SELECT reason, count(*) AS n FROM r GROUP BY reason ORDER BY reason
    """,
)
def _(t: Tables):
    why = R.reasons({"discount": F.col("l_discount") > 0.08, "untaxed": F.col("l_tax") == 0, "bulk": F.col("l_quantity") > 45})
    return t.lineitem.select(F.explode(why).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "d33_chain",
    """
    WITH g AS (SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'view') AS a, arg_min(value, event_id) FILTER (event_type = 'signup') AS b, arg_min(value, event_id) FILTER (event_type = 'purchase' AND value > 100) AS c FROM events GROUP BY user_id)
    SELECT user_id, a, b, c, CASE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT WHEN 3 THEN 'full' WHEN 2 THEN 'partial' ELSE 'singleton' END AS level FROM g
    """,
)
def _(t: Tables):
    e = t.events.withColumn("kind", F.when((F.col("event_type") == "purchase") & (F.col("value") <= 100), None).otherwise(F.col("event_type")))
    g = R.pivot_first(e, ["user_id"], "event_id", "kind", "value", {"a": "view", "b": "signup", "c": "purchase"})
    n = sum((F.col(x).isNotNull().cast("int") for x in "abc"), F.lit(0))
    return g.withColumn("level", F.when(n == 3, "full").when(n == 2, "partial").otherwise("singleton"))


@query("d35_conflicts", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def _(t: Tables):
    return t.orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n")).filter("n > 1")


@query(
    "d36_densify",
    """
    SELECT u.user_id, k.event_type, coalesce(c.n, 0) AS n
    FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['view', 'signup', 'error', 'click', 'purchase', 'refund']) AS event_type) k
    LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) c ON c.user_id = u.user_id AND c.event_type = k.event_type
    """,
)
def _(t: Tables):
    kinds = t.spark.createDataFrame([(k,) for k in ("view", "signup", "error", "click", "purchase", "refund")], "event_type string")
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.densify(counts, t.events.select("user_id").distinct(), kinds, ["user_id", "event_type"], {"n": 0}).select("user_id", "event_type", F.col("n").cast("long").alias("n"))


@query("d39_sessions", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' GROUP BY c.c_custkey")
def _(t: Tables):
    n = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["n"])


@query("d40_running_count", "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS running FROM orders")
def _(t: Tables):
    return t.orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("running"))


@query(
    "d44_incomplete_groups",
    """
    WITH ok AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND bool_or(l_linestatus = 'F'))
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l LEFT JOIN ok ON ok.l_orderkey = l.l_orderkey WHERE ok.l_orderkey IS NULL
    """,
)
def _(t: Tables):
    rows = R.incomplete_groups(t.lineitem, "l_orderkey", F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "d50_cumulative_offsets",
    "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at FROM conversations",
)
def _(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t.conversations.select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)).cast("long").alias("start_at"))


@query(
    "b1_upsert",
    """
    WITH u AS (SELECT *, 0 AS src FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT * REPLACE (o_totalprice + 1 AS o_totalprice), 1 FROM orders WHERE o_orderkey % 2 = 0)
    SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM u QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, src DESC) = 1
    """,
)
def _(t: Tables):
    base, new = t.orders.filter("o_orderkey % 3 <> 0"), t.orders.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return R.upsert(base, new, ["o_orderkey"], [F.desc("o_orderdate")]).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(
    "b3_nullsafe",
    """
    WITH a AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS k FROM orders), b AS (SELECT nullif(o_orderpriority, '5-LOW') AS k, count(*) AS n FROM orders GROUP BY 1)
    SELECT a.o_orderkey, a.k, b.n FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k
    """,
)
def _(t: Tables):
    a = t.orders.select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("k"))
    return R.null_safe_join(a, a.groupBy("k").agg(F.count("*").alias("n")), ["k"])


@query(
    "b7_merge_entities",
    "SELECT s_nationkey, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS aliases, arg_max(s_suppkey, struct_pack(a := s_acctbal, b := s_suppkey)) AS payload FROM supplier GROUP BY s_nationkey",
)
def _(t: Tables):
    return t.supplier.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_set("s_name")), ",").alias("aliases"), F.max_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("payload"))


@query(
    "b8_canonical_fold",
    """
    WITH s AS (SELECT *, CASE event_type WHEN 'purchase' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS p FROM events),
         b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, value DESC, event_id) AS r, max(event_id) OVER (PARTITION BY user_id) AS last_id FROM s),
         best AS (SELECT * FROM b WHERE r = 1), last AS (SELECT * FROM b WHERE event_id = last_id)
    SELECT best.user_id, best.event_id, best.event_type, best.value, (best.event_type <> last.event_type OR best.props <> last.props) AS conflict_flag
    FROM best JOIN last USING (user_id)
    """,
)
def _(t: Tables):
    status = {"purchase": "found", "click": "source_invalid", "view": "ocr_gap", "signup": "table_ungrounded", "error": "not_found"}
    named = F.lit("not_found")
    for k, v in status.items():
        named = F.when(F.col("event_type") == k, v).otherwise(named)
    rows = t.events.select("user_id", "event_id", "event_type", "value", "props", named.alias("status"))
    return R.canonical_fold(rows, ["user_id"], "event_id", "status", "value", "props").select("user_id", "event_id", "event_type", "value", "conflict_flag")


@query("b9_search_index", "SELECT o.o_orderkey, c.c_name, n.n_name, coalesce(n.n_name, '') || '|' || lower(coalesce(c.c_name, '')) AS search_text FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING' LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def _(t: Tables):
    c = t.customer.filter("c_mktsegment = 'BUILDING'")
    j = t.orders.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.select("o_orderkey", "c_name", "n_name", F.concat_ws("|", F.coalesce("n_name", F.lit("")), F.lower(F.coalesce("c_name", F.lit("")))).alias("search_text"))


@query(
    "b12_property_merge",
    """
    WITH e AS (SELECT user_id, event_type AS k, value AS v, event_id FROM events)
    SELECT user_id, k, arg_max(v, event_id) AS v FROM e GROUP BY ALL
    """,
)
def _(t: Tables):
    rows = t.events.select("user_id", "event_id", F.create_map(F.col("event_type"), F.col("value")).alias("props"))
    return R.merge_properties(rows, ["user_id"], "event_id", "props").select("user_id", F.explode("props").alias("k", "v"))


@query("b13_replace_node", "SELECT o_custkey AS node_id, arg_max(o_orderpriority, o_orderkey) AS props FROM orders GROUP BY 1")
def _(t: Tables):
    return R.replace_all(t.orders.select(F.col("o_custkey").alias("node_id"), "o_orderkey", F.col("o_orderpriority").alias("props")), ["node_id"], "o_orderkey").select("node_id", "props")


@query("b14_merge_edge", "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def _(t: Tables):
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return R.with_endpoints(R.with_endpoints(edges, t.part.filter("p_size > 25"), "p_partkey", ("src",)), t.supplier.filter("s_acctbal > 0"), "s_suppkey", ("dst",))


@query("b15_first_node", "SELECT o_custkey AS node_id, arg_min(o_orderpriority, o_orderkey) AS props FROM orders GROUP BY 1")
def _(t: Tables):
    return R.first_wins(t.orders.select(F.col("o_custkey").alias("node_id"), F.col("o_orderpriority").alias("props"), "o_orderkey"), ["node_id"], "o_orderkey").drop("o_orderkey")


@query(
    "b18_overlay",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'patched' ELSE s_name END AS s_name, s_nationkey FROM supplier",
)
def _(t: Tables):
    patch = t.supplier.filter("s_suppkey % 5 = 0").select("s_suppkey", F.lit("patched").alias("s_name"))
    return R.overlay(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), patch, ["s_suppkey"], ["s_name"])


@query(
    "b19_deltas",
    """
    SELECT s_suppkey, 's_nationkey' AS field, CAST(s_nationkey AS VARCHAR) AS old_value, CAST(s_nationkey + 1 AS VARCHAR) AS new_value FROM supplier WHERE s_suppkey % 7 = 0
    UNION ALL SELECT s_suppkey, 's_name', s_name, NULL FROM supplier WHERE s_suppkey % 11 = 0
    """,
)
def _(t: Tables):
    new = t.supplier.withColumn("s_nationkey", F.when(F.col("s_suppkey") % 7 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey"))).withColumn("s_name", F.when(F.col("s_suppkey") % 11 != 0, F.col("s_name")))
    return R.deltas(t.supplier, new, ["s_suppkey"], ["s_name", "s_nationkey"])


@query("b22_edges", "SELECT c.c_custkey AS src, coalesce(n.n_nationkey, -1) AS dst, CASE WHEN n.n_nationkey IS NULL THEN 'self' ELSE 'in' END AS rel FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey < 3")
def _(t: Tables):
    n = F.broadcast(t.nation.filter("n_regionkey < 3"))
    j = t.customer.join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.select(F.col("c_custkey").alias("src"), F.coalesce("n_nationkey", F.lit(-1)).alias("dst"), F.when(F.col("n_nationkey").isNull(), "self").otherwise("in").alias("rel"))


@query("b24_cleanup", "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '^(red|blue) [a-z]+$')")
def _(t: Tables):
    return t.part.filter(~F.rlike("p_name", F.lit("^(red|blue) [a-z]+$"))).select("p_partkey", "p_name")


@query(
    "c1_filter_intersection",
    "SELECT user_id FROM events WHERE event_type = 'error' AND value > 100 INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100 INTERSECT SELECT user_id FROM events WHERE props LIKE '%9%'",
)
def _(t: Tables):
    ids = lambda c: t.events.filter(c).select("user_id")
    return ids("event_type = 'error' AND value > 100").join(ids("event_type = 'purchase' AND value > 100"), "user_id", "left_semi").join(ids("props LIKE '%9%'"), "user_id", "left_semi").distinct()


@query("c4_or_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%Ring%' OR p_brand = 'Brand#3' OR list_has_any(string_split(p_name, ' '), ['red', 'blue']) ORDER BY p_partkey LIMIT 50")
def _(t: Tables):
    hit = F.ilike(F.col("p_name"), F.lit("%Ring%")) | (F.col("p_brand") == "Brand#3") | F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("blue")))
    return t.part.filter(hit).select("p_partkey", "p_name").orderBy("p_partkey").limit(50)


@query("c5_exists", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R' AND l_quantity > 49)")
def _(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).alias("ok")).filter("ok").select("l_orderkey")


@query("c6_point_lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def _(t: Tables):
    return t.customer.filter("c_custkey = 42").select("c_custkey", "c_name", "c_mktsegment")


@query("c7_page_sort", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_brand) DESC, lower(p_name), p_partkey LIMIT 25 OFFSET 50")
def _(t: Tables):
    return R.page(t.part, [F.desc(F.lower("p_brand")), F.asc(F.lower("p_name")), F.asc("p_partkey")], 3, 25).select("p_partkey", "p_name")


@query(
    "c13_gate",
    """
    WITH g AS (SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 10000 THEN 'long' END, CASE WHEN contains(text, 'Licensed under') THEN 'license' END, CASE WHEN regexp_matches(text, '[#$%&]{3}') THEN 'symbols' END], lambda x: x IS NOT NULL) AS why FROM documents)
    SELECT doc_id, array_to_string(why, ',') AS reasons, len(why) = 0 AS accepted FROM g
    """,
)
def _(t: Tables):
    why = R.reasons({"short": F.col("n_chars") < 200, "long": F.col("n_chars") > 10000, "license": F.contains("text", F.lit("Licensed under")), "symbols": F.rlike("text", F.lit("[#$%&]{3}"))})
    return t.documents.select("doc_id", why.alias("why")).select("doc_id", F.array_join("why", ",").alias("reasons"), (F.size("why") == 0).alias("accepted"))


@query("c14_complete_groups", "SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type = 'signup') AND (bool_or(event_type = 'click' AND value > 200) OR bool_or(event_type = 'purchase' AND value > 200))")
def _(t: Tables):
    e, v = F.col("event_type"), F.col("value") > 200
    ok = F.bool_or(e == "signup") & (F.bool_or((e == "click") & v) | F.bool_or((e == "purchase") & v))
    return t.events.groupBy("user_id").agg(ok.alias("ok")).filter("ok").select("user_id")


@query("c18_prepare_items", "SELECT user_id, event_type, event_id, value FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def _(t: Tables):
    return R.top_one(t.events.filter("event_type <> 'error'").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.desc("value"), F.asc("event_id")])


@query("c20_route", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'target' WHEN event_type IN ('click', 'view') AND value > 50 THEN 'context' ELSE 'other' END AS route FROM events")
def _(t: Tables):
    e = F.col("event_type")
    return t.events.select("event_id", F.when(e == "purchase", "target").when(e.isin("click", "view") & (F.col("value") > 50), "context").otherwise("other").alias("route"))


@query("c25_list_runs", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority ILIKE '%urgent%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20")
def _(t: Tables):
    rows = t.orders.filter((F.col("o_orderstatus") == "O") & F.ilike(F.col("o_orderpriority"), F.lit("%urgent%")))
    return R.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 2, 20).select("o_orderkey", "o_orderstatus")


@query("c29_messages", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3")
def _(t: Tables):
    return R.top_n(t.conversations, ["conv_id"], [F.asc("turn")], 3).select("conv_id", "turn", "role")


@query(
    "c30_tiers",
    "SELECT lang, count(*) FILTER (WHERE n_chars >= 2000) AS keep, count(*) FILTER (WHERE n_chars < 300) AS reject, count(*) FILTER (WHERE n_chars >= 300 AND n_chars < 2000) AS borderline FROM documents GROUP BY lang",
)
def _(t: Tables):
    n = F.col("n_chars")
    return t.documents.groupBy("lang").agg(F.count_if(n >= 2000).alias("keep"), F.count_if(n < 300).alias("reject"), F.count_if((n >= 300) & (n < 2000)).alias("borderline"))


@query(
    "c38_side_by_side",
    "SELECT conv_id, min(text) FILTER (role = 'user' AND turn < 2) AS user_text, min(text) FILTER (role = 'assistant' AND turn < 2) AS assistant_text FROM conversations GROUP BY conv_id",
)
def _(t: Tables):
    first = lambda r: F.min(F.when((F.col("role") == r) & (F.col("turn") < 2), F.col("text")))
    return t.conversations.groupBy("conv_id").agg(first("user").alias("user_text"), first("assistant").alias("assistant_text"))


@query(
    "f1_rank",
    "SELECT doc_id FROM documents ORDER BY (lang = 'en') DESC, round(n_chars / 1000.0, 4) DESC, source, doc_id LIMIT 100",
)
def _(t: Tables):
    return t.documents.orderBy(F.desc(F.col("lang") == "en"), F.desc(F.round(F.col("n_chars") / 1000.0, 4)), "source", "doc_id").limit(100).select("doc_id")


@query(
    "f2_argmax_conflict",
    """
    WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type, event_id) AS rk FROM events),
         b AS (SELECT user_id, event_type AS best, value AS best_value FROM r WHERE rk = 1),
         c AS (SELECT r.user_id, arg_min(r.event_type, rk) AS other, arg_min(r.value, rk) AS other_value FROM r JOIN b ON b.user_id = r.user_id AND r.event_type <> b.best GROUP BY r.user_id)
    SELECT b.user_id, best, best_value, other, round(best_value - other_value, 6) AS margin, coalesce(best_value - other_value < 10, false) AS review FROM b LEFT JOIN c USING (user_id)
    """,
)
def _(t: Tables):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_type", "event_id")
    r = t.events.select("user_id", "event_type", "value", F.row_number().over(w).alias("rk"), F.first("event_type").over(w).alias("best"))
    differs = F.col("event_type") != F.col("best")
    g = r.groupBy("user_id", "best").agg(F.max("value").alias("best_value"), F.min(F.when(differs, F.struct("rk", "event_type", "value"))).alias("o"))
    margin = F.col("best_value") - F.col("o.value")
    return g.select("user_id", "best", "best_value", F.col("o.event_type").alias("other"), F.round(margin, 6).alias("margin"), F.coalesce(margin < 10, F.lit(False)).alias("review"))


@query("f3_score", "SELECT l_orderkey, l_linenumber, l_partkey, round(0.45 * l_discount + 0.30 * l_tax + 0.15 * (l_returnflag = 'R')::INT + 0.10 * (l_linestatus = 'F')::INT, 6) AS score FROM lineitem")
def _(t: Tables):
    score = 0.45 * F.col("l_discount") + 0.30 * F.col("l_tax") + 0.15 * (F.col("l_returnflag") == "R").cast("int") + 0.10 * (F.col("l_linestatus") == "F").cast("int")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(score, 6).alias("score"))


@query("f8_best_sparse", "SELECT l_orderkey, l_returnflag, arg_max(l_linenumber, struct_pack(a := l_discount, b := l_partkey, c := l_linenumber)) AS l_linenumber FROM lineitem GROUP BY ALL")
def _(t: Tables):
    return t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.max_by("l_linenumber", F.struct("l_discount", "l_partkey", "l_linenumber")).alias("l_linenumber"))


@query(
    "f12_neighbors",
    """
    WITH s AS (SELECT conv_id, turn, length(text) AS score, max((length(text) > 300)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM conversations)
    SELECT conv_id, turn FROM s WHERE near = 1 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY (score > 300) DESC, score DESC, turn) <= 12
    """,
)
def _(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 1)
    s = t.conversations.select("conv_id", "turn", F.length("text").alias("score")).withColumn("near", F.max(F.col("score") > 300).over(w))
    return R.top_n(s.filter("near"), ["conv_id"], [F.desc(F.col("score") > 300), F.desc("score"), F.asc("turn")], 12).select("conv_id", "turn")


@query(
    "f16_budget",
    """
    WITH s AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
    SELECT conv_id, turn FROM s WHERE upto <= 1500 OR r = 1
    """,
)
def _(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = t.conversations.select("conv_id", "turn", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(w).alias("r"))
    return s.filter("upto <= 1500 OR r = 1").select("conv_id", "turn")


@query("f21_claim_next", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def _(t: Tables):
    return t.orders.filter("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("f22_latest_status", "SELECT o_custkey, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS status FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))


@query("g5_intersect", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45")
def _(t: Tables):
    p = lambda f: t.lineitem.filter(f"l_returnflag = '{f}' AND l_quantity > 45").select("l_partkey")
    return p("R").intersect(p("A"))


@query("g6_except", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def _(t: Tables):
    return t.lineitem.filter("l_returnflag = 'R'").select("l_partkey").subtract(t.lineitem.filter("l_quantity > 48").select("l_partkey"))


@query("g7_ordered_distinct", "SELECT lower(p_name) AS k, arg_min(p_name, p_partkey) AS first_name FROM part GROUP BY 1")
def _(t: Tables):
    return t.part.groupBy(F.lower("p_name").alias("k")).agg(F.min_by("p_name", "p_partkey").alias("first_name"))


@query("g11_hash", "SELECT doc_id, sha256(text) AS h, sha256(text || chr(0) || source) AS scoped FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"), F.sha2(F.concat("text", F.lit("\u0000"), "source").cast("binary"), 256).alias("scoped"))


@query("g13_exact_duplicates", "SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables):
    return t.documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("g16_count_report", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer")
def _(t: Tables):
    c = lambda n: getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return c("orders").unionByName(c("lineitem")).unionByName(c("customer"))


@query(
    "e1_alias_lookup",
    """
    WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS tok FROM documents), v AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS alias FROM part UNION SELECT DISTINCT 'the')
    SELECT w.doc_id, w.tok, count(*) AS n FROM w JOIN v ON w.tok = v.alias GROUP BY ALL
    """,
)
def _(t: Tables):
    words = t.documents.select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("tok"))
    vocab = t.part.select(F.lower(F.split("p_name", " ")[0]).alias("tok")).union(t.spark.sql("SELECT 'the'")).distinct()
    return words.join(vocab, "tok", "left_semi").groupBy("doc_id", "tok").agg(F.count("*").alias("n"))


@query(
    "e3_priority",
    "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 99 END) = 1",
)
def _(t: Tables):
    return R.best_tier(t.lineitem, ["l_orderkey"], R.decode(F.col("l_returnflag"), {"R": 0, "A": 1}, 99)).select("l_orderkey", "l_partkey", "l_suppkey")


@query(
    "e6_finalize",
    """
    WITH c AS (SELECT l_orderkey AS mention_id, l_suppkey AS entry_id FROM lineitem WHERE l_quantity > 40)
    SELECT o.o_orderkey AS mention_id, CASE WHEN count(DISTINCT entry_id) = 1 THEN 'standardized' WHEN count(DISTINCT entry_id) > 1 THEN 'ambiguous' ELSE 'unmapped' END AS status,
           CASE WHEN count(DISTINCT entry_id) = 1 THEN min(entry_id) END AS entry_id
    FROM orders o LEFT JOIN c ON c.mention_id = o.o_orderkey GROUP BY 1
    """,
)
def _(t: Tables):
    c = t.lineitem.filter("l_quantity > 40").select(F.col("l_orderkey").alias("mention_id"), F.col("l_suppkey").alias("entry_id"))
    return M.finalize(t.orders.select(F.col("o_orderkey").alias("mention_id")), c)


TOKENS = "list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: length(w) > 2 AND w NOT IN ('disease', 'syndrome', 'type', 'the', 'of', 'and', 'with', 'due', 'to', 'a', 'in', 'for', 'disorder', 'deficiency', 'mutation'))"


@query(
    "e8_jaccard",
    f"""
    WITH q AS (SELECT item_id AS query_id, {TOKENS} AS a FROM benchmark), d AS (SELECT doc_id AS target_id, lower(text) AS low, {TOKENS} AS b FROM documents),
         s AS (SELECT query_id, target_id, len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) AS score FROM q, d WHERE len(a) > 0 AND contains(low, a[1]) AND contains(low, a[-1]) AND len(list_filter(a, lambda w: NOT contains(low, w))) = 0)
    SELECT query_id, target_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id) = 1
    """,
)
def _(t: Tables):
    found = M.resolve_by_tokens(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), t.documents.select(F.col("doc_id").alias("alias_id"), "text"))
    return found.select("query_id", F.col("alias_id").alias("target_id"), F.round("score", 6).alias("score"))


@query(
    "e19_label_lookup",
    "WITH q AS (SELECT DISTINCT lower(n_name) AS query FROM nation UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part), l AS (SELECT p_name AS label, p_partkey AS node, p_partkey AS pos FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT lower(n_name), n_nationkey, 1000000 + n_nationkey FROM nation WHERE n_nationkey % 2 = 0), x AS (SELECT query, max_by(node, pos) AS node FROM q JOIN l ON label = query GROUP BY query) SELECT * FROM x UNION ALL SELECT query, arg_min(node, pos) FROM q JOIN l ON contains(label, query) OR contains(query, label) WHERE query NOT IN (SELECT query FROM x) GROUP BY query",
)
def _(t: Tables):
    q = t.nation.select(F.lower("n_name").alias("query")).union(t.part.select(F.split_part("p_name", F.lit(" "), F.lit(2)))).distinct()
    labels = t.part.filter("p_partkey % 3 > 0").select(F.col("p_name").alias("label"), F.col("p_partkey").alias("node"), F.col("p_partkey").alias("pos"))
    return M.label_lookup(q, labels.union(t.nation.filter("n_nationkey % 2 = 0").select(F.lower("n_name"), "n_nationkey", F.col("n_nationkey") + 1000000)))


KNN = """
    WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
         s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings WHERE vec_id <> query_id),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


@query("e9_knn", KNN + "SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def _(t: Tables):
    return M.k_nearest(every_hundredth(t), t.embeddings, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    "e10_margin",
    KNN + "SELECT query_id, CASE WHEN max(score) FILTER (rank = 1) < 0.4 THEN 'unmapped' WHEN max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) < 0.05 THEN 'ambiguous' ELSE 'standardized' END AS status, max(vec_id) FILTER (rank = 1) AS vec_id FROM r WHERE rank <= 5 GROUP BY 1",
)
def _(t: Tables):
    return M.margin_decision(M.k_nearest(every_hundredth(t), t.embeddings, 5), 0.4, 0.05)


def every_hundredth(t: Tables):
    return t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("e9_knn_whole")
def _(t: Tables):
    return M.k_nearest(every_hundredth(t), t.embeddings, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("e10_margin_whole")
def _(t: Tables):
    return M.margin_decision(M.k_nearest(every_hundredth(t), t.embeddings, 5), 0.4, 0.05)


@query(
    "e13_disjunctive_join",
    "SELECT DISTINCT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey AND (s.s_suppkey = c.c_custkey OR floor(s.s_acctbal / 100) = floor(c.c_acctbal / 100))",
)
def _(t: Tables):
    s, c = t.supplier.withColumn("b", F.floor(F.col("s_acctbal") / 100)), t.customer.withColumn("b", F.floor(F.col("c_acctbal") / 100))
    same = (F.col("s_nationkey") == F.col("c_nationkey"))
    one = s.drop("b").join(c.drop("b"), same & (F.col("s_suppkey") == F.col("c_custkey")))
    two = s.join(c, ["b"]).filter(same)
    return one.select("s_suppkey", "c_custkey").union(two.select("s_suppkey", "c_custkey")).distinct()


@query(
    "e16_topn_join",
    """
    WITH d AS (SELECT DISTINCT s.s_suppkey, l.l_partkey, p.p_retailprice FROM supplier s JOIN lineitem l ON l.l_suppkey = s.s_suppkey JOIN part p ON p.p_partkey = l.l_partkey)
    SELECT s_suppkey, l_partkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY p_retailprice DESC, l_partkey) AS INTEGER) AS rank FROM d QUALIFY rank <= 3
    """,
)
def _(t: Tables):
    j = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return R.top_n(j.select("s_suppkey", "l_partkey", "p_retailprice").distinct(), ["s_suppkey"], [F.desc("p_retailprice"), F.asc("l_partkey")], 3).select("s_suppkey", "l_partkey", "rank")


@query(
    "e20_interval",
    """
    WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 3600 AS f FROM events)
    SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.f AND b.s < a.f
    """,
)
def _(t: Tables):
    e = t.events.select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    a = e.select(F.col("event_id").alias("a"), F.col("user_id").alias("ua"), F.col("s").alias("as_"), (F.col("s") + 3600).alias("af"))
    b = e.select(F.col("event_id").alias("b"), F.col("user_id").alias("ub"), F.col("s").alias("bs"), (F.col("s") + 3600).alias("bf"))
    return M.interval_join(a, b, 3600, ("as_", "af"), ("bs", "bf")).filter("ua = ub AND a < b").select("a", "b")


@query(
    "e24_nearest",
    """
    WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT * FROM e WHERE event_type = 'view')
    SELECT p.event_id, v.event_id AS nearest, abs(p.s - v.s) AS distance FROM p JOIN v USING (user_id) QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.s - v.s), v.event_id) = 1
    """,
)
def _(t: Tables):
    e = t.events.select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    p = e.filter("event_type = 'purchase'").select("event_id", "user_id", "s")
    v = e.filter("event_type = 'view'").select("user_id", F.col("s").alias("vs"), F.col("event_id").alias("vid"))
    return M.nearest(p, v, ["user_id"], "s", "vs", "vid").filter("nearest IS NOT NULL").select("event_id", "nearest", "distance")


@query(
    "e26_agreement",
    "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, (a.n > 1) AS agrees FROM lineitem l JOIN (SELECT l_orderkey, l_linestatus, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY ALL) a ON a.l_orderkey = l.l_orderkey AND a.l_linestatus = l.l_linestatus",
)
def _(t: Tables):
    w = Window.partitionBy("l_orderkey", "l_linestatus")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.size(F.collect_set("l_returnflag").over(w)) > 1).alias("agrees"))


@query("e27_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS left_n, b.n AS right_n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) b ON a.k = b.k")
def _(t: Tables):
    a = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("left_n"))
    b = t.customer.filter("c_acctbal > 5000").groupBy(F.col("c_custkey").alias("k")).agg(F.count("*").alias("right_n"))
    return a.join(b, "k", "full_outer")


@query("e29_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t: Tables):
    return t.customer.join(t.orders.filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("e30_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def _(t: Tables):
    return R.distinct_on(t.orders.filter("o_orderstatus = 'F'"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("e31_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(t: Tables):
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("e28_stale", "SELECT o_orderkey FROM orders WHERE coalesce(o_orderdate, TIMESTAMP '1992-01-01') < TIMESTAMP '1998-01-01' - INTERVAL 300 SECONDS AND o_orderstatus = 'O'")
def _(t: Tables):
    return t.orders.filter("coalesce(o_orderdate, TIMESTAMP_NTZ '1992-01-01') < TIMESTAMP_NTZ '1998-01-01' - INTERVAL 300 SECONDS AND o_orderstatus = 'O'").select("o_orderkey")


@query("n_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t: Tables):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("n_cube", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)")
def _(t: Tables):
    return t.customer.cube("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("n_revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def _(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("n_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def _(t: Tables):
    return t.lineitem.filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("n"))


@query("n_tumbling", "SELECT event_type, CAST(epoch(time_bucket(INTERVAL 1 hour, ts)) AS BIGINT) AS w, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL")
def _(t: Tables):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return t.events.groupBy("event_type", w.alias("win")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s")).select("event_type", F.unix_timestamp("win.start").alias("w"), "n", "s")


@query(
    "n_session_windows",
    """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 hour THEN 0 ELSE 1 END AS new FROM events),
         s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_at, count(*) AS n FROM s GROUP BY user_id, sid
    """,
)
def _(t: Tables):
    w = F.session_window(F.col("ts").cast("timestamp"), "2 hours")
    return t.events.groupBy("user_id", w.alias("win")).agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("win.start").alias("start_at"), "n")


@query(
    "n_as_of",
    """
    WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT c.event_id, v.value AS last_value FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts
    """,
)
def _(t: Tables):
    c = t.events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    v = t.events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return M.as_of(c, v, ["user_id"], "ts", "value").select("event_id", "last_value")
