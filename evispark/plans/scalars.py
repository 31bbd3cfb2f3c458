"""Queries of the scalar functions over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .catalog import Tables, query

WORDS = "list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')), lambda w: w <> '')"


@query("h1_collapse", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS h FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.md5(T.collapse_spaces(F.col("text")).cast("binary")).alias("h"))


@query("h6_scope_hash", "SELECT l_orderkey, sha256(string_agg(b, '|' ORDER BY b)) AS h FROM (SELECT l_orderkey, l_returnflag || ':' || CAST(l_partkey AS VARCHAR) AS b FROM lineitem) GROUP BY l_orderkey")
def _(t: Tables):
    bindings = F.collect_list(F.struct(F.col("l_returnflag").alias("role"), F.col("l_partkey").cast("string").alias("id")))
    return t.lineitem.groupBy("l_orderkey").agg(bindings.alias("b")).select("l_orderkey", T.scope_hash(F.col("b")).alias("h"))


@query("h8_internal_id", "SELECT p_partkey, 'internal:variant:' || left(sha256(upper(p_brand) || '|' || p_name), 12) AS id FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", T.internal_variant_id(F.col("p_brand"), F.col("p_name")).alias("id"))


@query(
    "h21_fuzzy",
    f"""
    WITH f AS (SELECT doc_id, list_extract(string_split(text, chr(10)), 1) AS a, list_extract(string_split(text, chr(10)), 2) AS b FROM documents),
         n AS (SELECT doc_id, coalesce(a, '') AS a0, coalesce(b, '') AS b0, trim(regexp_replace(regexp_replace(lower(a), '[_/,;]+', ' ', 'g'), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(b), '[_/,;]+', ' ', 'g'), '\\s+', ' ', 'g')) AS b FROM f),
         w AS (SELECT *, {WORDS.replace('text', 'a')} AS wa, {WORDS.replace('text', 'b')} AS wb FROM n)
    SELECT doc_id, a0 <> '' AND b0 <> '' AND coalesce(a = b OR contains(a, b) OR contains(b, a) OR (len(wa) > 0 AND len(list_intersect(wa, wb)) / greatest(len(wa), 1) >= 0.6), false) AS matches FROM w
    """,
)
def _(t: Tables):
    lines = F.split("text", "\n")
    a, b = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    return t.documents.select("doc_id", F.coalesce(T.fuzzy_match(a, b), F.lit(False)).alias("matches"))


@query("h27_levels", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'pathogenic' ELSE 'uncertain' END AS level FROM orders")
def _(t: Tables):
    text = F.when(F.contains("o_orderpriority", F.lit("URGENT")), "Pathogenic").otherwise("VUS")
    return t.orders.select("o_orderkey", T.classification_level(text).alias("level"))


@query("h35_category", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS category FROM lineitem")
def _(t: Tables):
    return category_rows(t, t.lineitem)


@query("h35_category_whole")
def _(t: Tables):
    return category_rows(t, t.lineitem)


def category_rows(t: Tables, lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", T.field_category(F.concat_ws(".", "l_returnflag", "l_linestatus")).alias("category"))


@query("h46_title_key", "SELECT page_id, nullif(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^\\p{L}\\p{N}]+', '', 'g'), '') AS k FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", T.title_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("k"))


@query("h48_tokens", "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.size(T.relevance_tokens(F.col("text"))).cast("long").alias("n"))


@query(
    "h49_relevance",
    "SELECT doc_id, round(len(list_intersect(['the', 'of', 'der', 'que', 'zzz'], list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')))) / 5.0, 6) AS score FROM documents",
)
def _(t: Tables):
    return t.documents.select("doc_id", F.round(T.lexical_relevance(F.lit("the of der que zzz"), F.col("text")), 6).alias("score"))


@query("h50_classify", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)all rights reserved') THEN NULL WHEN regexp_matches(text, '(?i)licensed under') THEN 'license' WHEN regexp_matches(text, '[0-9]{6,}') THEN 'numeric' ELSE 'plain' END AS kind FROM documents")
def _(t: Tables):
    c = F.col("text")
    kind = F.when(F.rlike(c, F.lit("(?i)all rights reserved")), None).when(F.rlike(c, F.lit("(?i)licensed under")), "license").when(F.rlike(c, F.lit("[0-9]{6,}")), "numeric").otherwise("plain")
    return t.documents.select("doc_id", kind.alias("kind"))


@query("h56_group_id", "SELECT p_partkey, 'gene=' || regexp_replace(p_name, '\\s+', '', 'g') || '|variant=' || CASE WHEN p_size > 25 THEN p_brand ELSE '__missing__' END AS gid FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", T.group_id(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("gid"))


@query("h73_partial", f"WITH w AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations), p AS (SELECT conv_id, turn, w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM w) SELECT conv_id, turn, round(len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v))), 6) AS overlap FROM p WHERE v IS NOT NULL")
def _(t: Tables):
    from pyspark.sql import Window

    words = t.conversations.select("conv_id", "turn", T.word_set(F.col("text")).alias("w"))
    nxt = F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    return words.withColumn("v", nxt).filter("v IS NOT NULL").select("conv_id", "turn", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("overlap"))


@query("h74_numbers", "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'))) AS n FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.size(T.numbers(F.col("text"))).cast("long").alias("n"))


@query(
    "h78_section_state",
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
         f AS (SELECT *, last_value(CASE WHEN length(line) <= 60 THEN pos % 2 = 1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS keep FROM l)
    SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE coalesce(keep, true)) AS kept FROM f GROUP BY doc_id
    """,
)
def _(t: Tables):
    return section_state(t.documents)


@query("h78_section_state_whole")
def _(t: Tables):
    return section_state(t.documents)


def section_state(docs):
    from pyspark.sql import Window

    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    state = F.when(F.length("line") <= 60, (F.col("pos") + 1) % 2 == 1)
    keep = F.last(state, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("keep", F.coalesce(keep, F.lit(True))).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("keep")).alias("kept"))


@query("h88_score", "SELECT doc_id, CAST(3 * CAST(regexp_matches(text, 'c\\.[0-9]+') AS INTEGER) + 2 * len(list_distinct(regexp_extract_all(text, '[A-Z][A-Z0-9]{2,}'))) + CAST(contains(lower(text), 'licensed') AS INTEGER) + CAST(contains(lower(text), 'version') AS INTEGER) AS BIGINT) AS score FROM documents")
def _(t: Tables):
    c = F.col("text")
    names = F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(r"([A-Z][A-Z0-9]{2,})"), F.lit(1))))
    score = 3 * F.rlike(c, F.lit(r"c\.[0-9]+")).cast("int") + 2 * names + F.contains(F.lower(c), F.lit("licensed")).cast("int") + F.contains(F.lower(c), F.lit("version")).cast("int")
    return t.documents.select("doc_id", score.cast("long").alias("score"))


@query("h96_skip_translation", f"SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') AND len(list_intersect({WORDS}, ['the', 'of', 'and', 'in', 'to', 'is', 'for', 'with'])) >= 3 AS skip FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", T.skip_translation(F.col("text")).alias("skip"))


@query("h100_tokens", "SELECT doc_id, CAST(floor(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 4.0 + length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) AS BIGINT) AS n FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", T.estimate_tokens(F.col("text")).alias("n"))


@query("h104_seams", "SELECT conv_id, turn, right(coalesce(lag(text) OVER w, ''), 50) AS before, left(coalesce(lead(text) OVER w, ''), 50) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    cut = lambda f, c: f(F.coalesce(c, F.lit("")), F.lit(50))
    return t.conversations.select("conv_id", "turn", cut(F.right, F.lag("text").over(w)).alias("before"), cut(F.left, F.lead("text").over(w)).alias("after"))


@query("h105_drift", "SELECT conv_id, turn, CAST(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_at, abs(length(text) - coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0)) AS drift FROM conversations")
def _(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    return t.conversations.select("conv_id", "turn", F.sum(n + 2).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("end_at"), F.abs(n - F.coalesce(F.lag(n).over(w), F.lit(0))).cast("long").alias("drift"))


@query("h101_segments")
def _(t: Tables):
    return T.segment(t.documents.select("doc_id", "text"), "text", 200, 800).select("doc_id", F.col("segment_index").cast("long").alias("segment_index"), F.length("segment").alias("n_chars"))


@query("h37_anchor")
def _(t: Tables):
    a = T.value_anchor(F.col("text"), F.lit("Licensed"))
    return t.documents.select("doc_id", a.alias("a")).select("doc_id", "a.start", "a.end").filter("start IS NOT NULL")


@query("h86_payload_hash", "SELECT event_id, sha256(replace(props, ' ', '')) AS h FROM events")
def _(t: Tables):
    return t.events.select("event_id", T.payload_hash(F.col("props")).alias("h"))


@query("h83_embedding_text", "SELECT c_custkey, CASE WHEN lower(c_name) = c_mktsegment THEN c_name ELSE c_name || chr(10) || c_mktsegment END AS t FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", T.ordered_distinct_lines(F.col("c_name"), F.col("c_mktsegment"), F.lit(""), F.col("c_name")).alias("t"))


@query("c39_intent", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\\?$|^(What|Why|How) ') THEN 'question' WHEN regexp_matches(lower(text), '^(change|set|correct) ') THEN 'correction' ELSE 'question' END AS intent FROM conversations")
def _(t: Tables):
    c = F.col("text")
    intent = F.when(F.rlike(c, F.lit(r"\?$|^(What|Why|How) ")), "question").when(F.rlike(F.lower(c), F.lit("^(change|set|correct) ")), "correction").otherwise("question")
    return t.conversations.select("conv_id", "turn", intent.alias("intent"))


@query("a43_pdf_links", "SELECT page_id, len(regexp_extract_all(html, 'href=\"[^\"]+')) AS n_links, len(regexp_extract_all(html, '(?i)href=\"[^\"]+\\.pdf')) AS n_pdf FROM pages")
def _(t: Tables):
    links = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return t.pages.select("page_id", links('href="[^"]+').alias("n_links"), links(r'(?i)href="[^"]+\.pdf').alias("n_pdf"))
