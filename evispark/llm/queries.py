"""Queries over the driver's tables, one for each training-data operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_repair, graph_search, importance, language_id, license_scan, packing, quality_rules, simhash, suffix_dedup, tool_calls, url_rules, vector_codes
from .common import table


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_search.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def url_suffix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can express: host, path, the longest suffix rule and its verdict, through the same functions."""
    pages = table(spark, sf_dir, "pages")
    host, path = url_rules.host_and_path(pages["url"])
    parts = pages.select(pages["page_id"], host.alias("host"), path.alias("path"))
    rule, verdict = url_rules.suffix_rule(parts["host"], parts["path"])
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op7_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.learn(docs))
    return found.select("doc_id", language_id.held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score")


#: The tool of the query op8.
TOOLS = {"search": {"after": ("string", False), "limit": ("integer", True), "query": ("string", True)}}


def tool_transcript(conversations: DataFrame) -> DataFrame:
    """All conversations as transcripts of tool use: each assistant turn is a call, the user's turn after it a result.

    The driver's tables hold no calls; what a call looks like follows from its text, so that every case occurs.  A call
    asks for its text, is known by its turn, and may use the call two turns before; by the length of the text it names an
    unknown tool (every fifth), gives a limit of a wrong type (third), no query (seventh), or comes twice (eleventh).
    """
    n = F.length("text")
    number = F.col("turn").cast("string")
    after = F.when(n % 2 == 0, F.concat(F.lit("$ref:call-"), (F.col("turn") - 2).cast("string")))
    query = F.when(n % 7 != 0, F.col("text"))
    wrong = F.to_json(F.struct(after.alias("after"), n.cast("string").alias("limit"), query.alias("query")))
    right = F.to_json(F.struct(after.alias("after"), n.alias("limit"), query.alias("query")))
    call = F.struct(F.when(n % 3 == 0, wrong).otherwise(right).alias("arguments"), F.concat(F.lit("call-"), number).alias("id"), F.when(n % 5 == 0, "lookup").otherwise("search").alias("name"))
    calls = F.to_json(F.struct(F.when(n % 11 == 0, F.array(call, call)).otherwise(F.array(call)).alias("tool_calls")))
    result = F.to_json(F.struct(F.col("text").alias("content"), F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("tool_call_id")))
    is_call = (F.col("role") == "assistant") & F.col("text").isNotNull()
    is_result = (F.col("role") == "user") & (F.col("turn") > 0) & F.col("text").isNotNull()
    return conversations.select("conv_id", "turn", F.when(is_result, "tool").otherwise(F.col("role")).alias("role"), F.when(is_call, calls).when(is_result, result).otherwise(F.col("text")).alias("text"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tool_calls.link(tool_transcript(table(spark, sf_dir, "conversations")), TOOLS)
    return found.select("conv_id", "turn", "pos", "kind", "call_id", "name", "level", "status", F.array_join("errors", ",").alias("errors"), "json")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(found["fp"]).alias("fingerprint"), "component_id")


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op11_edit_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.digests(conversation_repair.repair(damaged))


def op12_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def _places(spans: F.Column, kind: str) -> F.Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _label_list(spans: F.Column) -> F.Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def _license_columns(found: DataFrame) -> DataFrame:
    base, notices = _places(found["spans"], "phrase"), _places(found["spans"], "notice")
    starts = F.transform(base, lambda s: s["start"])
    score = F.coalesce(F.array_max(F.transform(notices, lambda s: s["score"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _label_list(base).alias("base_labels"), _label_list(found["spans"]).alias("labels"), score.alias("score"),
    )


def op13_rare_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _license_columns(license_scan.scan(table(spark, sf_dir, "documents")))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op13 that SQL can express: words and the places of the base phrases, through the same functions."""
    return op13_rare_tokens(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance": op1_importance,
    "op2_quality_trees": op2_quality_trees,
    "op3_graph_search": op3_graph_search,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_url_rules": op6_url_rules,
    "url_suffix_rules": url_suffix_rules,
    "op7_cross_parsing": op7_cross_parsing,
    "op8_tool_calls": op8_tool_calls,
    "op9_simhash": op9_simhash,
    "op10_curve_packing": op10_curve_packing,
    "op11_edit_composition": op11_edit_composition,
    "op12_annular_codes": op12_annular_codes,
    "op13_rare_tokens": op13_rare_tokens,
    "license_phrases": license_phrases,
}

def _codes_sql(rounds: int = 4, entries: int = 256) -> str:
    """Codebooks by brute force: every part against every entry, round after round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
            a{r} AS (SELECT vec_id, x.p, min(CAST(x.n - 2 * list_dot_product(x.d, b.d) + b.n AS BIGINT) * {entries} + e) AS m FROM x JOIN b{r} AS b ON x.p = b.p GROUP BY vec_id, x.p)""")
        if r < rounds:
            steps.append(f"""
            s{r} AS (SELECT x.p, m % {entries} AS e, unnest(s) AS v, generate_subscripts(s, 1) AS i FROM x JOIN a{r} AS a ON x.vec_id = a.vec_id AND x.p = a.p),
            m{r} AS (SELECT p, e, list(v ORDER BY i) AS s FROM (SELECT p, e, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM s{r} GROUP BY ALL) GROUP BY p, e),
            c{r} AS (SELECT b.p, b.e, coalesce(m.s, b.s) AS s FROM b{r} AS b LEFT JOIN m{r} AS m ON b.p = m.p AND b.e = m.e),
            b{r + 1} AS MATERIALIZED (SELECT p, e, s, CAST(s AS DOUBLE[]) AS d, list_dot_product(CAST(s AS DOUBLE[]), CAST(s AS DOUBLE[])) AS n FROM c{r})""")
    return f"""
        WITH k AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), w AS (SELECT vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS s FROM k, range(4) AS r(p)),
        x AS MATERIALIZED (SELECT vec_id, p, s, CAST(s AS DOUBLE[]) AS d, list_dot_product(CAST(s AS DOUBLE[]), CAST(s AS DOUBLE[])) AS n FROM w),
        b0 AS MATERIALIZED (SELECT x.p, f.e, s, d, n FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {entries}) AS f USING (vec_id)),
        {",".join(steps)},
        t AS (SELECT vec_id, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(s) AS v, generate_subscripts(s, 1) AS i FROM b{rounds}))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM t JOIN k USING (vec_id), h
    """


ORACLE_SQL: dict[str, str] = {
    "op12_annular_codes": _codes_sql(),
    "license_phrases": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), p AS (
            SELECT doc_id, w, list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS cc,
                   list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl,
                   list_filter(range(len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS res
            FROM w
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(cc || gpl || res) AS BIGINT) AS n_base, list_min(cc || gpl || res) AS first_word, list_max(cc || gpl || res) AS last_word,
               concat_ws(',', CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(res) > 0 THEN 'reserved' END) AS base_labels
        FROM p
    """,
    "url_suffix_rules": r"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
             h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
             r AS (SELECT unnest(['com', 'example.com', 'www.example.com', 'net', 'net']) AS h, unnest(['/', '/en/', '/en/', '/es/', '/fr/']) AS p, unnest(['allow', 'block', 'allow', 'block', 'block']) AS v),
             m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM h JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule, verdict FROM h LEFT JOIN m USING (page_id)
    """,
    "op8_tool_calls": """
        WITH t AS (
            SELECT conv_id, turn, role, text, length(text) AS n, role = 'assistant' AND text IS NOT NULL AS is_call,
                   role = 'user' AND turn > 0 AND text IS NOT NULL AS is_result
            FROM conversations
        ), c AS (
            SELECT t.*, CASE WHEN n % 2 = 0 THEN '"after":"$ref:call-' || (turn - 2) || '",' ELSE '' END
                       || '"limit":' || CASE WHEN n % 3 = 0 THEN '"' || n || '"' ELSE CAST(n AS VARCHAR) END
                       || CASE WHEN n % 7 <> 0 THEN ',"query":' || CAST(to_json(text) AS VARCHAR) ELSE '' END AS arguments,
                   CASE WHEN n % 5 = 0 THEN 'lookup' ELSE 'search' END AS name,
                   CASE WHEN n % 5 = 0 THEN '*' WHEN n % 21 = 0 THEN 'limit,query' WHEN n % 3 = 0 THEN 'limit' WHEN n % 7 = 0 THEN 'query' ELSE '' END AS errors,
                   n % 2 = 0 AND EXISTS (SELECT 1 FROM t AS p WHERE p.is_call AND p.conv_id = t.conv_id AND p.turn = t.turn - 2) AS refers,
                   EXISTS (SELECT 1 FROM t AS r WHERE r.is_result AND r.conv_id = t.conv_id AND r.turn = t.turn + 1) AS answered,
                   row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS k
            FROM t WHERE is_call
        ), l AS (
            SELECT *, CAST(k - max(CASE WHEN NOT refers THEN k END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS INTEGER) AS level FROM c
        )
        SELECT conv_id, turn, CAST(0 AS INTEGER) AS pos, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id,
               CAST(NULL AS VARCHAR) AS name, CAST(0 AS INTEGER) AS level, 'message' AS status, '' AS errors,
               '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":'
                   || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS json
        FROM t WHERE NOT coalesce(is_call, FALSE) AND NOT coalesce(is_result, FALSE)
        UNION ALL
        SELECT conv_id, turn, CAST(p.pos AS INTEGER), 'call', 'call-' || turn, name, CASE WHEN p.pos = 0 THEN level END,
               CASE WHEN p.pos > 0 THEN 'duplicate_call' WHEN errors <> '' THEN 'invalid_arguments' WHEN answered THEN 'linked' ELSE 'no_result' END,
               errors, '{"arguments":{' || arguments || '},"id":"call-' || turn || '","name":"' || name || '","type":"call"}'
        FROM l, (VALUES (0), (1)) AS p(pos) WHERE p.pos = 0 OR n % 11 = 0
        UNION ALL
        SELECT t.conv_id, t.turn, CAST(0 AS INTEGER), 'result', 'call-' || (t.turn - 1), l.name, l.level,
               CASE WHEN l.conv_id IS NULL THEN 'no_call' ELSE 'linked' END, '',
               '{"content":' || CAST(to_json(t.text) AS VARCHAR) || ',"role":"tool","tool_call_id":"call-' || (t.turn - 1) || '"}'
        FROM t LEFT JOIN l ON l.conv_id = t.conv_id AND l.turn = t.turn - 1 WHERE t.is_result
    """,
}
