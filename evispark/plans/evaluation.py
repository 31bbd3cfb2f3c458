"""Queries of the evaluation, statistics and graph operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import relational as R
from ..operators import templates as MT
from .catalog import Tables, query


def judged(t: Tables):
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    return t.labels.join(d, "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("gold"), (F.col("n_chars") > 500).alias("pred"), (F.col("n_chars") > 1200).alias("pred2"))


J = "WITH j AS (SELECT l.doc_id, d.lang, d.source, l.quality = 1 AS gold, d.n_chars > 500 AS pred, d.n_chars > 1200 AS pred2 FROM labels l JOIN documents d USING (doc_id))"
COUNTS = "count(*) FILTER (WHERE gold AND pred) AS tp, count(*) FILTER (WHERE NOT gold AND pred) AS fp, count(*) FILTER (WHERE gold AND NOT pred) AS fn, count(*) FILTER (WHERE NOT gold AND NOT pred) AS tn"
PRF = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn), 6) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1"


@query(
    "d11_run_metrics",
    "SELECT d.source, count(*) AS n, round(avg(d.n_chars), 6) AS mean_chars, count(DISTINCT d.lang) AS n_langs, count(*) FILTER (WHERE l.quality = 1) AS good, count(*) FILTER (WHERE l.toxic = 1) AS toxic, round(count(DISTINCT d.lang) / 4.0, 6) AS coverage FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source",
)
def _(t: Tables):
    j = t.labels.join(t.documents.select("doc_id", "source", "lang", "n_chars"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.countDistinct("lang").alias("n_langs"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(F.countDistinct("lang") / 4.0, 6).alias("coverage"))


@query("d12_prf1", f"{J}, c AS (SELECT {COUNTS} FROM j) SELECT *, {PRF} FROM c")
def _(t: Tables):
    return E.prf1(E.outcome_counts(judged(t), F.col("gold"), F.col("pred")))


@query("d15_by_dataset", f"{J}, c AS (SELECT source, {COUNTS} FROM j GROUP BY source) SELECT *, {PRF} FROM c")
def _(t: Tables):
    return E.prf1(E.outcome_counts(judged(t), F.col("gold"), F.col("pred"), ["source"]))


@query("d17_stratified", f"{J}, c AS (SELECT lang, source, {COUNTS} FROM j GROUP BY GROUPING SETS ((lang), (source), ())) SELECT *, {PRF} FROM c")
def _(t: Tables):
    j = judged(t)
    g, p = F.col("gold"), F.col("pred")
    counts = j.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    return E.prf1(counts)


@query(
    "d16_consistency",
    """
    WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS a, arg_min(text, turn) FILTER (role = 'assistant') AS b FROM conversations GROUP BY conv_id)
    SELECT count(*) AS pairs, count(*) FILTER (WHERE length(a) > length(b)) AS longer, round(count(*) FILTER (WHERE length(a) > length(b)) / count(*), 6) AS rate FROM f WHERE a IS NOT NULL AND b IS NOT NULL
    """,
)
def _(t: Tables):
    first = lambda r: F.min_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn")))
    f = t.conversations.groupBy("conv_id").agg(first("user").alias("a"), first("assistant").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    longer = F.count_if(F.length("a") > F.length("b"))
    return f.agg(F.count("*").alias("pairs"), longer.alias("longer"), F.round(longer / F.count("*"), 6).alias("rate"))


@query(
    "d18_set_gain",
    """
    WITH w AS (SELECT DISTINCT source, unnest(string_split(lower(text), ' ')) AS tok FROM documents WHERE source IN ('src1', 'src2')), a AS (SELECT tok FROM w WHERE source = 'src1'), b AS (SELECT tok FROM w WHERE source = 'src2')
    SELECT (SELECT count(*) FROM (SELECT tok FROM a INTERSECT SELECT tok FROM b)) AS shared, (SELECT count(*) FROM (SELECT tok FROM a EXCEPT SELECT tok FROM b)) AS only_first, (SELECT count(*) FROM (SELECT tok FROM b EXCEPT SELECT tok FROM a)) AS only_second
    """,
)
def _(t: Tables):
    w = t.documents.filter("source IN ('src1', 'src2')").select("source", F.explode(F.split(F.lower("text"), " ")).alias("tok"))
    by = w.groupBy("tok").agg(F.bool_or(F.col("source") == "src1").alias("a"), F.bool_or(F.col("source") == "src2").alias("b"))
    return by.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(~F.col("a") & F.col("b")).alias("only_second"))


@query(
    "d22_error_rows",
    f"{J}, e AS (SELECT doc_id, unnest(list_filter([CASE WHEN gold AND NOT pred THEN 'missing' END, CASE WHEN NOT gold AND pred THEN 'wrong_value' END, CASE WHEN pred AND NOT pred2 THEN 'over_extraction' END], lambda x: x IS NOT NULL)) AS error FROM j) SELECT error, count(*) AS n FROM e GROUP BY error",
)
def _(t: Tables):
    g, p, q = F.col("gold"), F.col("pred"), F.col("pred2")
    kinds = F.array_compact(F.array(F.when(g & ~p, "missing"), F.when(~g & p, "wrong_value"), F.when(p & ~q, "over_extraction")))
    return judged(t).select(F.explode(kinds).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("d24_grounding", f"{J} SELECT lang, count(*) FILTER (WHERE pred2 AND gold) AS valid_hit, count(*) FILTER (WHERE pred2 AND NOT gold) AS valid_wrong, count(*) FILTER (WHERE NOT pred2 AND gold) AS invalid_hit, round(count(*) FILTER (WHERE pred2) / count(*), 6) AS validity FROM j GROUP BY lang")
def _(t: Tables):
    g, v = F.col("gold"), F.col("pred2")
    return judged(t).groupBy("lang").agg(F.count_if(v & g).alias("valid_hit"), F.count_if(v & ~g).alias("valid_wrong"), F.count_if(~v & g).alias("invalid_hit"), F.round(F.count_if(v) / F.count("*"), 6).alias("validity"))


@query(
    "d25_taxonomy",
    f"""{J}, g AS (SELECT lang, source, bool_or(gold AND NOT pred) AS has_fn, bool_or(NOT gold AND pred) AS has_fp FROM j GROUP BY ALL)
    SELECT CASE WHEN has_fn AND has_fp THEN 'boundary' WHEN has_fn THEN 'absent' WHEN has_fp THEN 'unsupported' ELSE 'none' END AS kind, count(*) AS n, string_agg(lang || '/' || source, ',' ORDER BY lang, source) AS examples FROM g GROUP BY 1""",
)
def _(t: Tables):
    g = judged(t).groupBy("lang", "source").agg(F.bool_or(F.col("gold") & ~F.col("pred")).alias("fn"), F.bool_or(~F.col("gold") & F.col("pred")).alias("fp"))
    kind = F.when(F.col("fn") & F.col("fp"), "boundary").when(F.col("fn"), "absent").when(F.col("fp"), "unsupported").otherwise("none")
    names = F.transform(F.array_sort(F.collect_list(F.struct("lang", "source"))), lambda s: F.concat_ws("/", s["lang"], s["source"]))
    return g.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.array_join(names, ",").alias("examples"))


@query(
    "d29_templates",
    r"""
    WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT regexp_replace(line, '[0-9]+', '<num>', 'g') AS template FROM l WHERE length(line) > 0)
    SELECT template, count(*) AS n FROM m GROUP BY template ORDER BY n DESC, template LIMIT 20
    """,
)
def _(t: Tables):
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") > 0)
    return lines.groupBy(F.regexp_replace("line", "[0-9]+", "<num>").alias("template")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "template").limit(20)


#: Root causes of lines: the first whose words occur in the template.
CAUSES = {"licence": ["license", "rights reserved", "cc by"], "contact": ["@", "http"], "secret": ["key", "token", "password"]}


@query("d29_log_templates")
def _(t: Tables):
    """Every line of every document as a log line: its source is the place, and lines of doubtful documents are errors."""
    bad = t.labels.groupBy("doc_id").agg(F.bool_or((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    docs = t.documents.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("message")).join(bad, "doc_id", "left")
    log = docs.select(F.when(F.col("bad"), "ERROR").otherwise("WARNING").alias("level"), F.col("source").alias("location"), "message")
    found = MT.mine(log, CAUSES)
    pairs = F.array_join(F.transform("locations", lambda p: F.concat_ws("=", p["location"], p["n"].cast("string"))), ",")
    return found.select("template", "n", "level", F.array_join("samples", "\n").alias("samples"), pairs.alias("locations"), "bucket")


@query(
    "e17_graded_match",
    """
    WITH w AS (SELECT item_id, lower(text) AS b FROM benchmark), d AS (SELECT doc_id, lower(text) AS a FROM documents),
         m AS (SELECT w.item_id, CASE WHEN a = b THEN 'exact' WHEN contains(a, b) THEN 'normalized' WHEN a IS NULL THEN 'missing' ELSE 'wrong_value' END AS match_type FROM w LEFT JOIN d ON d.doc_id = w.item_id)
    SELECT match_type, count(*) AS n FROM m GROUP BY 1
    """,
)
def _(t: Tables):
    return graded_match(t, t.documents)


@query("e17_graded_match_whole")
def _(t: Tables):
    return graded_match(t, t.documents)


def graded_match(t: Tables, docs):
    d = docs.select(F.col("doc_id").alias("item_id"), F.lower("text").alias("a"))
    m = t.benchmark.select("item_id", F.lower("text").alias("b")).join(d, "item_id", "left")
    kind = F.when(F.col("a").isNull(), "missing").when(F.col("a") == F.col("b"), "exact").when(F.contains("a", F.col("b")), "normalized").otherwise("wrong_value")
    return m.groupBy(kind.alias("match_type")).agg(F.count("*").alias("n"))


@query("j1_entry_outcomes", f"{J} SELECT lang, {COUNTS.replace(', count(*) FILTER (WHERE NOT gold AND NOT pred) AS tn', '')} FROM j GROUP BY lang")
def _(t: Tables):
    return E.outcome_counts(judged(t), F.col("gold"), F.col("pred"), ["lang"]).drop("tn")


BOOT = """
    , s AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CAST(gold = pred AS INTEGER) AS v FROM j), n AS (SELECT count(*) AS n FROM s),
      r AS (SELECT a.b AS replicate, k.k AS draw, CAST(floor(CAST(('0x' || left(md5('7|' || a.b || '|' || k.k), 8)) AS BIGINT) / 4294967296.0 * n.n) AS BIGINT) AS pos FROM n, range(200) a(b), range(n.n) k(k)),
      m AS (SELECT replicate, avg(v) AS mean FROM r JOIN s USING (pos) GROUP BY replicate)
"""


@query("j2_bootstrap", f"{J} {BOOT} SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m")
def _(t: Tables):
    return bootstrap_of(t, 200)


@query("j2_bootstrap_whole")
def _(t: Tables):
    return bootstrap_of(t, 5000)


def bootstrap_of(t: Tables, replicates: int):
    s = R.numbered(judged(t).select("doc_id", (F.col("gold") == F.col("pred")).cast("int").alias("v")), ["doc_id"], "pos")
    i = E.interval(E.bootstrap_means(s, "pos", "v", replicates, 7))
    return i.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "j4_permutation",
    f"""{J}, d AS (SELECT doc_id, CAST(gold = pred AS INTEGER) - CAST(gold = pred2 AS INTEGER) AS d FROM j), o AS (SELECT avg(d) AS observed FROM d),
    p AS (SELECT r.p, avg(CASE WHEN CAST(('0x' || left(md5('11|' || r.p || '|' || d.doc_id), 8)) AS BIGINT) / 4294967296.0 < 0.5 THEN -1.0 ELSE 1.0 END * d.d) AS m FROM d, range(200) r(p) GROUP BY r.p)
    SELECT round(observed, 6) AS observed, round((count(*) FILTER (WHERE abs(m) >= abs(observed) - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM p, o GROUP BY observed""",
)
def _(t: Tables):
    return permutation_of(t, 200)


@query("j4_permutation_whole")
def _(t: Tables):
    return permutation_of(t, 10000)


def permutation_of(t: Tables, replicates: int):
    d = judged(t).select("doc_id", ((F.col("gold") == F.col("pred")).cast("int") - (F.col("gold") == F.col("pred2")).cast("int")).alias("d"))
    return E.permutation_test(d, "doc_id", "d", replicates, 11)


@query("j7_mcnemar", f"{J}, c AS (SELECT count(*) FILTER (WHERE gold = pred AND gold <> pred2) AS b, count(*) FILTER (WHERE gold <> pred AND gold = pred2) AS c FROM j) SELECT b, c, round(CASE WHEN b + c = 0 THEN 0.0 ELSE pow(greatest(abs(b - c) - 1, 0), 2) / (b + c) END, 6) AS chi2 FROM c")
def _(t: Tables):
    return E.mcnemar(judged(t), F.col("gold") == F.col("pred"), F.col("gold") == F.col("pred2")).select("b", "c", "chi2")


@query("j8_paired_t", f"{J}, d AS (SELECT CAST(gold = pred AS INTEGER) - CAST(gold = pred2 AS INTEGER) AS d FROM j), s AS (SELECT count(d) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM d) SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean / (sd / sqrt(n)), 6) AS t, round(mean - 1.96 * sd / sqrt(n), 6) AS low, round(mean + 1.96 * sd / sqrt(n), 6) AS high FROM s")
def _(t: Tables):
    return E.paired_t(judged(t), (F.col("gold") == F.col("pred")).cast("int") - (F.col("gold") == F.col("pred2")).cast("int"))


@query(
    "j9_wilcoxon",
    """
    WITH d AS (SELECT round(l_discount * 100) - round(l_tax * 100) AS d FROM lineitem), z AS (SELECT d, abs(d) AS a FROM d WHERE d <> 0),
         r AS (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM z)
    SELECT count(*) AS n, round(sum(r) FILTER (WHERE d > 0), 6) AS w_plus, round(sum(r) FILTER (WHERE d < 0), 6) AS w_minus FROM r
    """,
)
def _(t: Tables):
    return E.signed_rank(t.lineitem, F.round(F.col("l_discount") * 100) - F.round(F.col("l_tax") * 100))


@query("j11_entry_f1", f"{J}, c AS (SELECT source, {COUNTS} FROM j GROUP BY source) SELECT source, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1 FROM c")
def _(t: Tables):
    return E.prf1(E.outcome_counts(judged(t), F.col("gold"), F.col("pred"), ["source"])).select("source", "f1")


TOKENS = """
    WITH u AS (SELECT conv_id, unnest(string_split(lower(text), ' ')) AS tok FROM conversations WHERE role = 'user'), v AS (SELECT conv_id, unnest(string_split(lower(text), ' ')) AS tok FROM conversations WHERE role = 'assistant'),
         a AS (SELECT conv_id, tok, count(*) AS na FROM u GROUP BY ALL), b AS (SELECT conv_id, tok, count(*) AS nb FROM v GROUP BY ALL),
         x AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.tok = b.tok)
"""


def sides(t: Tables):
    side = lambda r: t.conversations.filter(F.col("role") == r).select("conv_id", F.explode(F.split(F.lower("text"), " ")).alias("tok"))
    return side("user"), side("assistant")


@query("j14_token_f1", f"{TOKENS} SELECT conv_id, CASE WHEN sum(na) + sum(nb) = 0 THEN 0.0 ELSE round(2 * sum(least(na, nb)) / (sum(na) + sum(nb)), 6) END AS f1 FROM x GROUP BY conv_id")
def _(t: Tables):
    return E.multiset_f1(*sides(t), ["conv_id"], "tok")


@query("j29_one_to_one", f"{TOKENS} SELECT CAST(sum(least(na, nb)) AS BIGINT) AS tp, CAST(sum(nb - least(na, nb)) AS BIGINT) AS fp, CAST(sum(na - least(na, nb)) AS BIGINT) AS fn FROM x")
def _(t: Tables):
    return E.one_to_one(*sides(t), ["conv_id", "tok"])


@query(
    "j30_split",
    "SELECT source, CASE WHEN r <= 5 THEN 'dev' WHEN r <= 10 THEN 'test' ELSE 'pool' END AS split FROM (SELECT source, row_number() OVER (ORDER BY source) AS r FROM (SELECT DISTINCT source FROM documents))",
)
def _(t: Tables):
    r = F.row_number().over(Window.orderBy("source"))
    s = t.documents.select("source").distinct().withColumn("r", r)
    return s.select("source", F.when(F.col("r") <= 5, "dev").when(F.col("r") <= 10, "test").otherwise("pool").alias("split"))


def nation_edges(t: Tables):
    """A small graph: nations to the two of double and double-plus-one key."""
    n = t.nation.select(F.col("n_nationkey").cast("long").alias("src"))
    two = n.select("src", F.explode(F.array(F.col("src") * 2 + 1, F.col("src") * 2 + 2, (F.col("src") * 7 + 3) % 25)).alias("dst"))
    return two.join(n.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")


NE = "e AS (SELECT src, dst FROM (SELECT CAST(n_nationkey AS BIGINT) AS src, unnest([CAST(n_nationkey AS BIGINT) * 2 + 1, CAST(n_nationkey AS BIGINT) * 2 + 2, (CAST(n_nationkey AS BIGINT) * 7 + 3) % 25]) AS dst FROM nation) WHERE dst IN (SELECT n_nationkey FROM nation))"


@query("k1_subgraph", f"WITH RECURSIVE {NE}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT u.dst, depth + 1 FROM w JOIN u ON u.src = w.node WHERE depth < 2) SELECT node, min(depth) AS depth FROM w GROUP BY node ORDER BY 2, 1 LIMIT 12")
def _(t: Tables):
    return G.subgraph(nation_edges(t), t.spark.sql("SELECT 0L AS node"), 2, 12)


@query("k2_bfs_per_seed", f"WITH RECURSIVE {NE}, w AS (SELECT s AS seed, s AS node, 0 AS depth FROM (SELECT unnest([CAST(1 AS BIGINT), 5]) AS s) UNION SELECT seed, e.dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < 3) SELECT seed, node, min(depth) AS depth FROM w GROUP BY seed, node")
def _(t: Tables):
    return G.bfs(nation_edges(t), t.spark.sql("SELECT explode(array(1L, 5L)) AS node"), 3)


@query("k3_bridge", "SELECT 'l_partkey->l_suppkey' AS rel_type, CAST(l_partkey AS VARCHAR) AS src, CAST(l_suppkey AS VARCHAR) AS dst, count(*) AS evidence_count FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_suppkey->l_orderkey', CAST(l_suppkey AS VARCHAR), CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_partkey->l_orderkey', CAST(l_partkey AS VARCHAR), CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem GROUP BY ALL")
def _(t: Tables):
    return G.bridge(t.lineitem, "l_partkey", "l_suppkey", "l_orderkey")


@query("k7_induced", f"WITH {NE} SELECT src, dst FROM e WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def _(t: Tables):
    keep = t.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("node"))
    return G.induced(nation_edges(t), keep)


@query("k11_closure", f"WITH RECURSIVE {NE}, c AS (SELECT src AS node, dst AS ancestor, 1 AS depth FROM e UNION SELECT c.node, e.dst, depth + 1 FROM c JOIN e ON e.src = c.ancestor WHERE depth < 4) SELECT node, ancestor, min(depth) AS depth FROM c GROUP BY node, ancestor")
def _(t: Tables):
    return G.ancestors(nation_edges(t), 4)


@query("k12_is_descendant", f"WITH RECURSIVE {NE}, c AS (SELECT src AS node, dst AS ancestor, 1 AS depth FROM e UNION SELECT c.node, e.dst, depth + 1 FROM c JOIN e ON e.src = c.ancestor WHERE depth < 4), p AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(7 AS BIGINT) AS ancestor FROM nation) SELECT p.node, p.ancestor, (p.node = 7 OR p.node IN (SELECT node FROM c WHERE ancestor = 7)) AS is_descendant FROM p")
def _(t: Tables):
    pairs = t.nation.select(F.col("n_nationkey").cast("long").alias("node"), F.lit(7).cast("long").alias("ancestor"))
    return G.is_descendant(pairs, G.ancestors(nation_edges(t), 4))
