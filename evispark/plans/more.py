"""Queries of further scalar functions, statistics and set operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import learning as N
from ..operators import relational as R
from .catalog import Tables, query
from .evaluation import J, judged


@query("h2_lookup_text", "SELECT c_custkey, lower(c_mktsegment) AS k FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", T.lookup_text(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("k"))


@query("h31_variant_sites", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS site FROM part")
def _(t: Tables):
    sites = F.filter(F.transform(F.split(F.replace("p_name", F.lit(" "), F.lit(";")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return t.part.select("p_partkey", F.explode(F.when(F.size(sites) > 1, sites).otherwise(F.array("p_name"))).alias("site"))


@query("h33_json_language", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables):
    first = F.coalesce(*(F.get_json_object("props", p) for p in ("$.language", "$.lang", "$.k")))
    return t.events.select("event_id", first.cast("long").alias("k"))


@query("h39_from_group_id", "SELECT p_partkey, regexp_replace(p_name, ' ', '', 'g') AS gene, CASE WHEN p_size > 25 THEN p_brand END AS variant FROM part")
def _(t: Tables):
    g = T.group_id(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_brand")))
    return t.part.select("p_partkey", T.from_group_id(g, "gene").alias("gene"), T.from_group_id(g, "variant").alias("variant"))


@query("h41_filename", "SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 120) AS name FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", T.safe_filename(F.col("url")).alias("name"))


@query("h42_fences", "SELECT c_custkey, c_name AS inside FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", T.strip_fences(F.concat(F.lit("```json\n"), "c_name", F.lit("\n```"))).alias("inside"))


@query("h43_abstract", "SELECT doc_id, length(regexp_extract(text, '(?s)^[^\\n]*\\n([^\\n]{31,})', 1)) AS n FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.length(F.regexp_extract("text", r"(?s)^[^\n]*\n([^\n]{31,})", 1)).cast("long").alias("n"))


@query("h52_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", T.year(F.concat(F.lit("issued "), F.col("o_orderdate").cast("string"))).alias("y"))


@query("h55_identifiers", "SELECT p_partkey, '10.5555/ab' || p_partkey AS doi, CAST(10000 + p_partkey AS VARCHAR) AS pmid FROM part")
def _(t: Tables):
    text = F.concat(F.lit("see DOI: 10.5555/AB"), F.col("p_partkey").cast("string"), F.lit(" and PMID: "), (10000 + F.col("p_partkey")).cast("string"))
    return t.part.select("p_partkey", T.doi(text).alias("doi"), T.pmid(text).alias("pmid"))


@query("h59_ellipsis", "SELECT doc_id, regexp_matches(lower(text), '(?s)the.*and') AS hit FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", T.fragments_in_order(F.lit("The ... and"), F.col("text")).alias("hit"))


@query("h80_abbreviations", "SELECT c_custkey, 'ABC' AS abbr FROM customer")
def _(t: Tables):
    text = F.concat(F.lower("c_mktsegment"), F.lit(" disease (ABC) and (ABC), (DNA)"))
    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\(([A-Z]{2,8})\)"), F.lit(1))), lambda a: ~a.isin("DNA", "RNA"))
    return t.customer.select("c_custkey", F.array_join(found, ",").alias("abbr"))


@query("h91_missing", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority END AS v FROM orders")
def _(t: Tables):
    raw = F.when(F.startswith("o_orderpriority", F.lit("5")), " N/A ").otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", T.missing_to_null(raw).alias("v"))


@query("h97_block_language", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), r AS (SELECT doc_id, CASE WHEN length(line) = 0 THEN 0.0 ELSE len(regexp_extract_all(line, '[À-ÿ]')) / CAST(length(line) AS DOUBLE) END AS r FROM l) SELECT doc_id, round(avg(CASE WHEN r > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS share FROM r GROUP BY doc_id")
def _(t: Tables):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.round(F.avg(F.when(T.script_ratio(F.col("line"), "À-ÿ") > 0.05, 1.0).otherwise(0.0)), 6).alias("share"))


@query("h98_coverage", "SELECT conv_id, round(count(*) FILTER (WHERE role = 'assistant') / count(*), 6) AS blocks, round(sum(length(text)) FILTER (WHERE role = 'assistant') / sum(length(text)), 6) AS chars FROM conversations GROUP BY conv_id")
def _(t: Tables):
    a = F.col("role") == "assistant"
    return t.conversations.groupBy("conv_id").agg(F.round(F.count_if(a) / F.count("*"), 6).alias("blocks"), F.round(F.sum(F.when(a, F.length("text"))) / F.sum(F.length("text")), 6).alias("chars"))


@query("h99_quality_flags", "SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[#$%&]{3}') THEN 'symbols' END, CASE WHEN regexp_matches(text, '[0-9]{9}') THEN 'digits' END, CASE WHEN length(text) < 60 THEN 'short' END) AS flags FROM documents")
def _(t: Tables):
    c = F.col("text")
    return t.documents.select("doc_id", F.array_join(R.reasons({"symbols": F.rlike(c, F.lit("[#$%&]{3}")), "digits": F.rlike(c, F.lit("[0-9]{9}")), "short": F.length(c) < 60}), ",").alias("flags"))


@query("j3_paired_bootstrap", f"""{J}, s AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CAST(gold = pred AS INTEGER) - CAST(gold = pred2 AS INTEGER) AS v FROM j), n AS (SELECT count(*) AS n FROM s),
      r AS (SELECT a.b AS replicate, CAST(floor(CAST(('0x' || left(md5('5|' || a.b || '|' || k.k), 8)) AS BIGINT) / 4294967296.0 * n.n) AS BIGINT) AS pos FROM n, range(100) a(b), range(n.n) k(k)),
      m AS (SELECT replicate, avg(v) AS mean FROM r JOIN s USING (pos) GROUP BY replicate) SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def _(t: Tables):
    return paired_bootstrap_of(t, 100)


@query("j3_paired_bootstrap_whole")
def _(t: Tables):
    return paired_bootstrap_of(t, 10000)


def paired_bootstrap_of(t: Tables, replicates: int):
    right = lambda p: (F.col("gold") == F.col(p)).cast("int")
    s = R.numbered(judged(t).select("doc_id", (right("pred") - right("pred2")).alias("v")), ["doc_id"], "pos")
    i = E.interval(E.bootstrap_means(s, "pos", "v", replicates, 5))
    return i.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("j10_clustered_bootstrap", f"""{J}, c AS (SELECT source, sum(CAST(gold = pred AS INTEGER)) AS s, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS pos FROM j GROUP BY source), k AS (SELECT count(*) AS k FROM c),
      r AS (SELECT a.b AS replicate, CAST(floor(CAST(('0x' || left(md5('3|' || a.b || '|' || d.d), 8)) AS BIGINT) / 4294967296.0 * k.k) AS BIGINT) AS pos FROM k, range(100) a(b), range(k.k) d(d))
      SELECT replicate, round(sum(s) / sum(n), 6) AS mean FROM r JOIN c USING (pos) GROUP BY replicate""")
def _(t: Tables):
    return clustered_bootstrap_of(t, 100)


@query("j10_clustered_bootstrap_whole")
def _(t: Tables):
    return clustered_bootstrap_of(t, 5000)


def clustered_bootstrap_of(t: Tables, replicates: int):
    d = judged(t).select("source", (F.col("gold") == F.col("pred")).cast("int").alias("d"))
    return N.clustered_bootstrap(d, "source", "d", replicates, 3).select("replicate", F.round("mean", 6).alias("mean"))


@query("j21_weight_grid", "SELECT l_orderkey, l_linenumber, l_partkey, g.id AS grid_id, round(l_discount * g.a + l_tax * g.b, 6) AS score FROM lineitem, (SELECT unnest([0, 1]) AS id, unnest([0.5, 1.0]) AS a, unnest([0.5, 0.25]) AS b) g")
def _(t: Tables):
    return weight_grid_rows(t, t.lineitem)


@query("j21_weight_grid_whole")
def _(t: Tables):
    return weight_grid_rows(t, t.lineitem)


def weight_grid_rows(t: Tables, lineitem):
    grid = t.spark.createDataFrame([(0, 0.5, 0.5), (1, 1.0, 0.25)], "grid_id int, w_l_discount double, w_l_tax double")
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax")
    return N.weighted_grid(rows, ["l_discount", "l_tax"], grid).select("l_orderkey", "l_linenumber", "l_partkey", "grid_id", F.round("score", 6).alias("score"))


@query("j25_leave_one_out")
def _(t: Tables):
    rows = t.labels.join(t.documents, "doc_id").select("lang", F.log1p("n_chars").alias("a"), F.regexp_count("text", F.lit("[#$%&]")).cast("double").alias("b"), "quality")
    return N.leave_one_out(rows, "lang", ["a", "b"], "quality").groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("probability") > 0.5).cast("double") == F.col("label")).cast("double")), 2).alias("accuracy"))


@query("j28_ablation_table", f"{J}, c AS (SELECT source, avg(CAST(gold = pred AS INTEGER)) AS a, avg(CAST(gold = pred2 AS INTEGER)) AS b FROM j GROUP BY source) SELECT source, round(a, 6) AS full_score, round(b, 6) AS ablated, round(a - b, 6) AS delta FROM c")
def _(t: Tables):
    right = lambda p: F.avg((F.col("gold") == F.col(p)).cast("int"))
    c = judged(t).groupBy("source").agg(right("pred").alias("a"), right("pred2").alias("b"))
    return c.select("source", F.round("a", 6).alias("full_score"), F.round("b", 6).alias("ablated"), F.round(F.col("a") - F.col("b"), 6).alias("delta"))


@query("d43_conditions", "SELECT lang, count(*) AS n, round(count(*) FILTER (WHERE n_chars > 300) / count(*), 6) AS completion, round(avg(n_chars) FILTER (WHERE n_chars > 300), 4) AS mean_chars FROM documents GROUP BY lang")
def _(t: Tables):
    done = F.col("n_chars") > 300
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.count_if(done) / F.count("*"), 6).alias("completion"), F.round(F.avg(F.when(done, F.col("n_chars"))), 4).alias("mean_chars"))


@query("d27_best_report", "SELECT lang, arg_max(source, struct_pack(a := n, b := source)) AS best FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 2) GROUP BY lang")
def _(t: Tables):
    n = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n")).filter("n > 2")
    return n.groupBy("lang").agg(F.max_by("source", F.struct("n", "source")).alias("best"))


@query("d46_missing_extra", "SELECT 'missing' AS kind, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'extra', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t: Tables):
    missing = t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.lit("missing").alias("kind"), F.col("c_custkey").alias("id"))
    extra = t.supplier.join(t.customer.filter("c_acctbal > 0"), F.col("s_suppkey") == F.col("c_custkey"), "left_anti").select(F.lit("extra").alias("kind"), F.col("s_suppkey").alias("id"))
    return missing.unionByName(extra)


@query("b10_document_profile", "SELECT o_custkey, count(*) AS n, CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS cents, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey")
def _(t: Tables):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice") * 100).cast("long").alias("cents"), ids.alias("ids"))


@query("b17_stale_and_new", "SELECT o_orderkey, 'kept' AS state FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 5 = 0")
def _(t: Tables):
    stale = t.orders.filter("o_orderkey % 5 = 0").select("o_orderkey")
    kept = t.orders.join(stale, "o_orderkey", "left_anti").select("o_orderkey", F.lit("kept").alias("state"))
    return kept.unionByName(stale.withColumn("state", F.lit("new")))


@query("b23_language_fallback", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 2 = 0 THEN upper(lang) END, 'und') AS language FROM documents")
def _(t: Tables):
    a, b = F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.upper("lang"))
    return t.documents.select("doc_id", F.coalesce(a, b, F.lit("und")).alias("language"))


@query("c44_slug", "SELECT p_partkey, string_split(p_name, ' ')[1] AS gene, p_brand AS variant, p_type AS disease FROM part")
def _(t: Tables):
    slug = F.split(F.concat_ws(":", F.split("p_name", " ")[0], "p_brand", "p_type"), ":")
    return t.part.select("p_partkey", slug[0].alias("gene"), slug[1].alias("variant"), F.array_join(F.slice(slug, 3, 9), ":").alias("disease"))


@query("f14_neighbour_frame", "SELECT conv_id, turn, max(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM conversations")
def _(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 1)
    return t.conversations.select("conv_id", "turn", F.max(F.length("text")).over(w).cast("long").alias("m"))


@query("f20_best_by_field", "SELECT user_id, event_type, arg_max(event_id, struct_pack(a := value, b := event_id)) AS event_id FROM events GROUP BY ALL")
def _(t: Tables):
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("event_id"))


@query("n_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def _(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersectAll(t.supplier.select("s_nationkey"))


@query("n_ranking_windows", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(ntile(3) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_linenumber) AS INTEGER) AS t FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity)")
def _(t: Tables):
    return ranking_windows_rows(t, t.lineitem)


@query("n_ranking_windows_whole")
def _(t: Tables):
    return ranking_windows_rows(t, t.lineitem)


def ranking_windows_rows(t: Tables, lineitem):
    w = Window.partitionBy("l_orderkey")
    rows = lineitem
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.dense_rank().over(w.orderBy("l_quantity")).alias("d"), F.ntile(3).over(w.orderBy("l_extendedprice", "l_partkey", "l_linenumber")).alias("t"))


@query("n_percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.percentile("l_extendedprice", F.lit(0.5)), 4).alias("median"), F.round(F.percentile("l_extendedprice", F.lit(0.9)), 4).alias("p90"))
