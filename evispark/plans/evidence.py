"""Queries of the evidence operators, on the driver's tables by their shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hgvs as H
from ..operators import evidence as E
from ..operators import matching as M
from ..operators import relational as R
from .catalog import Tables, query


def items(t: Tables):
    """Events as items: users are documents, hours of the day groups, event types fields."""
    e = F.col("event_type")
    field = F.when(e == "view", E.GENE_FIELD).when(e == "click", "A.variant_hgvs_c").when(e == "signup", E.DISEASE_FIELD).otherwise("C.note")
    return t.events.select(
        F.col("user_id").cast("string").alias("document_id"), F.concat(F.lit("g"), (F.col("event_id") % 4).cast("string")).alias("group_id"), field.alias("field_id"),
        F.concat(F.lit("v"), F.floor(F.col("value") / 20).cast("string")).alias("value"), F.when(e == "error", "not_found").otherwise("found").alias("status"),
        F.col("value").alias("confidence"), (F.col("event_id") % 17).cast("int").alias("block"), F.col("props").alias("snippet"),
        F.when(F.col("event_id") % 2 == 0, "original").otherwise("translated").alias("track"), F.col("event_id").alias("pos"),
    )


ITEMS = """
    i AS (SELECT CAST(user_id AS VARCHAR) AS document_id, 'g' || CAST(event_id % 4 AS VARCHAR) AS group_id,
        CASE event_type WHEN 'view' THEN 'A.gene_symbol' WHEN 'click' THEN 'A.variant_hgvs_c' WHEN 'signup' THEN 'B.disease_diagnosis' ELSE 'C.note' END AS field_id,
        'v' || CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS value, CASE WHEN event_type = 'error' THEN 'not_found' ELSE 'found' END AS status, value AS confidence,
        CAST(event_id % 17 AS INTEGER) AS block, props AS snippet, CASE WHEN event_id % 2 = 0 THEN 'original' ELSE 'translated' END AS track, event_id AS pos FROM events)
"""


@query("c16_two_tier_gate", f"WITH {ITEMS}, g AS (SELECT document_id, group_id, bool_or(status = 'found' AND field_id = 'A.gene_symbol') AND bool_or(status = 'found' AND field_id = 'A.variant_hgvs_c') AS f, bool_or(status = 'found' AND field_id IN ('A.gene_symbol', 'B.disease_diagnosis')) AS p FROM i GROUP BY ALL) SELECT i.pos FROM i JOIN g USING (document_id, group_id) WHERE f OR (p AND field_id = 'A.gene_symbol')")
def _(t: Tables):
    return E.gated_items(items(t), [E.GENE_FIELD]).select("pos")


@query("d31_gate_report", f"WITH {ITEMS} SELECT CASE WHEN status = 'found' THEN 'accepted' ELSE 'rejected' END AS reason, count(*) AS n FROM i GROUP BY 1 UNION ALL SELECT 'unsupported_status', count(*) FROM i WHERE status <> 'found'")
def _(t: Tables):
    rows = items(t).withColumns({c: F.lit("x") for c in ("run_id", "gene_id", "variant_id", "disease_id", "review_status")})
    return E.gate_report(E.ready_gate(rows))


@query(
    "d33_evidence_chains",
    f"""WITH {ITEMS}, g AS (SELECT document_id, group_id, arg_min(value, pos) FILTER (status = 'found' AND field_id = 'A.gene_symbol') AS gene, arg_min(value, pos) FILTER (status = 'found' AND field_id = 'B.disease_diagnosis') AS disease,
        arg_min(value, pos) FILTER (status = 'found' AND field_id = 'A.variant_hgvs_c') AS variant, string_agg(DISTINCT field_id, ',' ORDER BY field_id) FILTER (status = 'found') AS fields FROM i GROUP BY ALL)
    SELECT document_id, group_id, gene, disease, variant, coalesce(fields, '') AS fields, CASE (gene IS NOT NULL)::INT + (disease IS NOT NULL)::INT + (variant IS NOT NULL)::INT WHEN 3 THEN 'full' WHEN 2 THEN 'partial' WHEN 1 THEN 'singleton' ELSE 'empty' END AS level FROM g""",
)
def _(t: Tables):
    return E.chains(items(t)).select("document_id", "group_id", "gene", "disease", "variant", F.array_join("fields", ",").alias("fields"), "level")


@query("d35_contradictions", f"WITH {ITEMS} SELECT document_id, group_id, field_id, string_agg(DISTINCT value, ',' ORDER BY value) AS found FROM i WHERE status = 'found' GROUP BY ALL HAVING count(DISTINCT value) > 1")
def _(t: Tables):
    return E.contradictions(items(t)).select("document_id", "group_id", "field_id", F.array_join("values", ",").alias("found"))


@query(
    "f5_decide_fields",
    f"""WITH {ITEMS}, a AS (SELECT document_id, field_id, value, count(DISTINCT track) AS n FROM i GROUP BY ALL),
        s AS (SELECT i.*, round(0.45 + 0.30 * confidence + 0.15 * CAST(n > 1 AS INTEGER) + 0.10 * CAST(status = 'found' AS INTEGER), 6) AS score FROM i JOIN a USING (document_id, field_id, value)),
        r AS (SELECT *, row_number() OVER w AS r, first_value(value) OVER w AS best FROM s WINDOW w AS (PARTITION BY document_id, field_id ORDER BY score DESC, value, track, pos))
    SELECT document_id, field_id, arg_min(value, r) AS value, round(arg_min(score, r), 4) AS score, arg_min(value, r) FILTER (value <> best) AS conflicting_value FROM r GROUP BY ALL""",
)
def _(t: Tables):
    return E.decide_fields(E.candidate_score(items(t))).select("document_id", "field_id", "value", F.round("score", 4).alias("score"), "conflicting_value")


@query(
    "e27_alignment",
    f"""WITH {ITEMS}, b AS (SELECT track, document_id, field_id, value FROM i QUALIFY row_number() OVER (PARTITION BY track, document_id, field_id ORDER BY confidence DESC, value, pos) = 1),
        j AS (SELECT coalesce(o.document_id, x.document_id) AS document_id, coalesce(o.field_id, x.field_id) AS field_id, o.value AS original, x.value AS translated FROM (SELECT * FROM b WHERE track = 'original') o FULL JOIN (SELECT * FROM b WHERE track = 'translated') x ON o.document_id = x.document_id AND o.field_id = x.field_id)
    SELECT *, CASE WHEN original IS NULL OR translated IS NULL THEN 'missing' WHEN original = translated THEN 'aligned' ELSE 'drifted' END AS alignment FROM j""",
)
def _(t: Tables):
    rows = items(t)
    return E.alignment(rows.filter("track = 'original'"), rows.filter("track = 'translated'"))


@query(
    "e25_nearest_group",
    f"""WITH {ITEMS}, a AS (SELECT DISTINCT document_id, group_id, block FROM i WHERE field_id = 'A.gene_symbol'), n AS (SELECT document_id, pos AS item, block FROM i WHERE field_id = 'C.note')
    SELECT n.document_id, item, group_id FROM n JOIN a ON a.document_id = n.document_id QUALIFY row_number() OVER (PARTITION BY n.document_id, item ORDER BY abs(n.block - a.block), group_id) = 1""",
)
def _(t: Tables):
    rows = items(t)
    return E.nearest_group(rows.filter("field_id = 'C.note'").select("document_id", F.col("pos").alias("item"), "block"), rows.filter(F.col("field_id") == E.GENE_FIELD))


@query("h60_grounding", "SELECT CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'corrected' ELSE 'ambiguous' END AS grounding, count(*) AS rows FROM (SELECT (length(text) - length(replace(text, 'Licensed', ''))) / 8 AS n FROM documents WHERE NOT starts_with(text, 'Licensed')) GROUP BY 1 UNION ALL SELECT 'exact', count(*) FROM documents WHERE starts_with(text, 'Licensed') HAVING count(*) > 0")
def _(t: Tables):
    it = t.documents.select(F.col("doc_id").alias("document_id"), F.lit("Licensed").alias("snippet"), F.lit(0).alias("start"))
    return E.ground(it, t.documents.select(F.col("doc_id").alias("document_id"), "text")).groupBy("grounding").agg(F.count("*").alias("rows"))


@query("f7_first_chains", "SELECT o_custkey AS document_id, arg_min(o_orderkey, struct_pack(a := src, b := g)) AS g FROM (SELECT o_custkey, lower(o_orderpriority) AS k, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS src, CAST(o_orderkey AS VARCHAR) AS g FROM orders) GROUP BY o_custkey, k")
def _(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").cast("string").alias("group_id"), F.col("o_orderpriority").alias("gene"), F.lit(None).cast("string").alias("disease"), F.lit(None).cast("string").alias("variant"), "o_orderstatus")
    both = E.first_chains(rows.filter("o_orderstatus = 'O'"), rows.filter("o_orderstatus <> 'O'"))
    return both.select("document_id", F.col("group_id").cast("long").alias("g"))


@query("j23_root_cause", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 5 THEN 'candidate_absent' WHEN l_quantity < 10 THEN 'source_invalid_or_unscorable' WHEN l_discount > 0.05 THEN 'non_target_contamination' WHEN l_returnflag <> 'R' THEN 'score_ranking_error' ELSE 'evaluation_normalization_gap' END AS cause FROM lineitem")
def _(t: Tables):
    cause = E.root_cause(F.col("l_returnflag") == "R", F.floor(F.col("l_quantity") / 5), F.floor(F.col("l_quantity") / 10), (F.col("l_discount") > 0.05).cast("int"), F.lit("C.other"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", cause.alias("cause"))


@query("h18_ids_in_text", "SELECT p_partkey, CASE WHEN p_size = p_size // 2 THEN 'MONDO:' || p_size ELSE 'MONDO:' || least(CAST(p_size AS VARCHAR), CAST(p_size // 2 AS VARCHAR)) || ';MONDO:' || greatest(CAST(p_size AS VARCHAR), CAST(p_size // 2 AS VARCHAR)) END AS ids FROM part")
def _(t: Tables):
    text = F.concat(F.lit("see MONDO:"), F.col("p_size").cast("string"), F.lit("|HP:7, MONDO:"), F.floor(F.col("p_size") / 2).cast("string"))
    return t.part.select("p_partkey", F.array_join(H.phenotype_ids(text, "MONDO"), ";").alias("ids"))


@query("e4_alias_tiers", "SELECT l_orderkey AS mention_id, l_suppkey AS entry_id FROM (SELECT DISTINCT l_orderkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 3 END AS tier FROM lineitem) QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY tier) = 1")
def _(t: Tables):
    f = F.col("l_returnflag")
    kind = F.when(f == "R", "primary").when(f == "A", "alias").otherwise("name")
    return M.prioritized(t.lineitem.select(F.col("l_orderkey").alias("mention_id"), F.col("l_suppkey").alias("entry_id"), kind.alias("alias_type"))).select("mention_id", "entry_id")


@query("e7_staged_match", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'precise' WHEN c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) THEN 'retry' ELSE 'unmapped' END AS stage FROM customer")
def _(t: Tables):
    precise = t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    rest = t.customer.join(precise.select("c_custkey"), "c_custkey", "left_anti")
    retry = rest.join(t.supplier.filter("s_acctbal > 9000"), F.col("s_nationkey") == F.col("c_nationkey"), "left_semi")
    none = rest.join(retry.select("c_custkey"), "c_custkey", "left_anti")
    stage = lambda df, s: df.select("c_custkey", F.lit(s).alias("stage"))
    return stage(precise, "precise").unionByName(stage(retry, "retry")).unionByName(stage(none, "unmapped"))


@query("c12_type_filter", "SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_type = 'ECONOMY' AND p_size > 45) OR left(p_name, 80) IN (SELECT left(p_name, 80) FROM part WHERE p_type = 'ECONOMY' AND p_size > 45)")
def _(t: Tables):
    kept = t.part.filter("p_type = 'ECONOMY' AND p_size > 45")
    one = t.part.join(kept.select("p_brand"), "p_brand", "left_semi").select("p_partkey")
    two = t.part.withColumn("k", F.left("p_name", F.lit(80))).join(kept.select(F.left("p_name", F.lit(80)).alias("k")), "k", "left_semi").select("p_partkey")
    return one.union(two).distinct()


@query("c19_shard", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r BETWEEN 201 AND 300")
def _(t: Tables):
    return R.page(t.customer, [F.asc("c_custkey")], 3, 100).select("c_custkey")


@query("c22_channels", "SELECT o_orderkey, o_orderstatus = 'F' OR o_orderpriority LIKE '1%' AS allowed FROM orders")
def _(t: Tables):
    base = F.array(F.when(F.col("o_orderstatus") == "F", F.lit("a")), F.when(F.startswith("o_orderpriority", F.lit("1")), F.lit("b")))
    return t.orders.select("o_orderkey", (F.size(F.array_intersect(F.array_compact(base), F.array(F.lit("a"), F.lit("b"), F.lit("c")))) > 0).alias("allowed"))


@query("c28_audit_events", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40")
def _(t: Tables):
    j = t.orders.join(t.customer.filter("c_mktsegment = 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"))
    return j.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(40).select("o_orderkey", "c_name")


@query("c42_pilot_selection", "SELECT source, count(*) FILTER (WHERE lang <> 'en') AS other, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source HAVING count(*) FILTER (WHERE lang <> 'en') > 0 ORDER BY other DESC, source LIMIT 5")
def _(t: Tables):
    g = t.documents.groupBy("source").agg(F.count_if(F.col("lang") != "en").alias("other"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
    return g.filter("other > 0").orderBy(F.desc("other"), "source").limit(5)


@query("c43_missing_languages", "SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM documents) s, (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS lang) l WHERE (s.source, l.lang) NOT IN (SELECT source, lang FROM documents)")
def _(t: Tables):
    langs = F.array(*(F.lit(x) for x in ("en", "de", "fr", "es", "it")))
    want = t.documents.select("source").distinct().select("source", F.explode(langs).alias("lang"))
    return want.join(t.documents, ["source", "lang"], "left_anti")


@query("d32_project", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS ids, max(o_totalprice) AS confidence FROM orders GROUP BY o_custkey")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("ids"), F.max("o_totalprice").alias("confidence"))


@query("d41_baseline_matrix", "SELECT source, count(*) AS n, round(count(*) FILTER (WHERE n_chars < 100) / count(*), 6) AS error_rate, round(avg(n_chars), 4) AS latency, CASE WHEN count(DISTINCT lang) = 4 THEN 'complete' ELSE 'partial' END AS coverage FROM documents GROUP BY source")
def _(t: Tables):
    n = F.count("*")
    return t.documents.groupBy("source").agg(n.alias("n"), F.round(F.count_if(F.col("n_chars") < 100) / n, 6).alias("error_rate"), F.round(F.avg("n_chars"), 4).alias("latency"), F.when(F.countDistinct("lang") == 4, "complete").otherwise("partial").alias("coverage"))


@query("d42_retry_overlay", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'P' THEN 'retried' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def _(t: Tables):
    retry = t.orders.filter("o_orderkey % 3 = 0 AND o_orderstatus <> 'P'").select("o_orderkey", F.lit("retried").alias("o_orderpriority"))
    return R.overlay(t.orders.select("o_orderkey", "o_orderpriority"), retry, ["o_orderkey"], ["o_orderpriority"])


@query("d45_best_attempt", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END DESC, o_orderkey DESC) = 1")
def _(t: Tables):
    return R.top_one(t.orders, ["o_custkey"], [F.desc(R.decode(F.col("o_orderstatus"), {"F": 2, "P": 1}, 0)), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("d47_axis_rows", "SELECT l_orderkey, l_linenumber, l_partkey, axis, v FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS quantity, l_tax AS tax FROM lineitem) UNPIVOT (v FOR axis IN (quantity, tax))")
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return rows.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["quantity", "tax"], "axis", "v")


@query("f15_select_entries", "SELECT c_custkey FROM customer ORDER BY round(abs(c_acctbal - 5000), 2), c_custkey LIMIT 30")
def _(t: Tables):
    return t.customer.orderBy(F.round(F.abs(F.col("c_acctbal") - 5000), 2), "c_custkey").limit(30).select("c_custkey")


@query("f24_sort_keys", "SELECT p_partkey FROM part ORDER BY p_size DESC, lower(p_name), p_partkey LIMIT 60")
def _(t: Tables):
    return R.page(t.part, [F.desc("p_size"), F.asc(F.lower("p_name")), F.asc("p_partkey")], 1, 60).select("p_partkey")


@query("g4_candidate_id", """SELECT p_partkey, 'cand-' || left(sha1('{"brand":' || CAST(to_json(p_brand) AS VARCHAR) || ',"name":' || CAST(to_json(p_name) AS VARCHAR) || '}'), 12) AS id FROM part""")
def _(t: Tables):
    from ..functions.text import canonical_json

    body = canonical_json(F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))))
    return t.part.select("p_partkey", F.concat(F.lit("cand-"), F.left(F.sha1(body.cast("binary")), F.lit(12))).alias("id"))


@query("g12_content_hash", "SELECT page_id, CASE WHEN url LIKE 'https%' THEN sha256(html) ELSE sha256(url) END AS h FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", F.when(F.startswith("url", F.lit("https")), F.sha2(F.col("html").cast("binary"), 256)).otherwise(F.sha2(F.col("url").cast("binary"), 256)).alias("h"))


@query("k4_find_by_name", "SELECT n_nationkey FROM nation WHERE lower(n_name) IN ('nation_3', 'nation_7') OR lower(replace(n_name, 'NATION_', 'N')) = 'n9' LIMIT 10")
def _(t: Tables):
    names = t.nation.select("n_nationkey", F.explode(F.array(F.lower("n_name"), F.lower(F.replace("n_name", F.lit("NATION_"), F.lit("N"))))).alias("k"))
    return names.filter(F.col("k").isin("nation_3", "nation_7", "n9")).select("n_nationkey").distinct()


@query("k9_format", "SELECT string_agg(n_name || ' (' || r_name || ')', chr(10) ORDER BY n_nationkey) AS block FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(t: Tables):
    ten = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    line = F.concat(F.col("n_name"), F.lit(" ("), F.col("r_name"), F.lit(")"))
    return ten.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("s")))), lambda x: x["s"]), "\n").alias("block"))


@query("l5_routing", "SELECT d.doc_id, p.provider FROM documents d JOIN (SELECT unnest(['en', 'en', 'de', 'fr']) AS lang, unnest(['a', 'b', 'a', 'c']) AS provider) p ON p.lang = d.lang")
def _(t: Tables):
    plan = t.spark.createDataFrame([("en", "a"), ("en", "b"), ("de", "a"), ("fr", "c")], "lang string, provider string")
    return t.documents.join(F.broadcast(plan), "lang").select("doc_id", "provider")


@query("l16_lease", "SELECT user_id, arg_max(event_type, event_id) AS owner, CAST(max(event_id) AS BIGINT) AS beat FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def _(t: Tables):
    return t.events.filter("event_type IN ('view', 'click')").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("owner"), F.max("event_id").alias("beat"))
