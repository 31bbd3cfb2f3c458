"""Queries of variant notation; each SQL twin applies the operator's rules to the same texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hgvs as H
from ..functions import text as T
from ..operators import comparison as C
from .catalog import Tables, query

K = "CAST(p_partkey + 1 AS STRING)"
# Texts in the ways that articles and tables write variants; the same expression in both engines.
VARIANT = f"""CASE p_partkey % 12 WHEN 0 THEN 'NM_000059.4(BRCA2):c.' || {K} || 'A>G' WHEN 1 THEN 'p.Arg' || {K} || 'Ter' WHEN 2 THEN ' p.Gly' || {K} || 'AlafsTer20'
    WHEN 3 THEN 'R' || {K} || 'X' WHEN 4 THEN 'Arg' || {K} || 'Ter' WHEN 5 THEN '["p.Ser' || {K} || 'Arg", "p.S' || {K} || 'I"]' WHEN 6 THEN 'c.727C>T (p.R' || {K} || 'X)'
    WHEN 7 THEN 'p.R' || {K} || 'X, p.R2X' WHEN 8 THEN 'Arg5Gly/p.Arg' || {K} || 'Ter' WHEN 9 THEN 'NM_1.2:p.(Lys' || {K} || 'Profs*23)' WHEN 10 THEN p_name END"""
AA = "|".join(H.AMINO)
CHANGE = rf"({AA})([0-9]+)({AA}|Ter|[*]|stop|X|fs|del|dup|ins)"
CODES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in [*H.AMINO.items(), ("Ter", "*"), ("stop", "*"), ("X", "*"), ("*", "*"), ("fs", "fs"), ("del", "del"), ("dup", "dup"), ("ins", "ins")]) + "}"


def long_form(v: str) -> str:
    part = lambda k: f"regexp_extract({v}, 'p[.]?[(]?{CHANGE}[)]?((?i:fs)?)', {k})"
    return f"CASE WHEN {part(1)} <> '' THEN 'p.' || {CODES}[{part(1)}] || {part(2)} || CASE WHEN {part(4)} <> '' THEN 'fs' ELSE {CODES}[{part(3)}] END END"


ALIASES = rf"""
    WITH t AS (SELECT p_partkey, regexp_replace({VARIANT}, '\s+', '', 'g') AS t FROM part),
         x AS (SELECT p_partkey, unnest(CASE WHEN starts_with(t, '[') THEN regexp_extract_all(t, '["'']([^"'']+)["'']', 1) ELSE [t] END) AS x FROM t WHERE t IS NOT NULL),
         y AS (SELECT p_partkey, x AS v FROM x UNION ALL SELECT p_partkey, regexp_replace(x, '^[^:]+:', '') FROM x WHERE regexp_matches(x, '^(NM|NR|XM|XR|NG)_[0-9.]+([(][^)]+[)])?:')),
         f AS (SELECT p_partkey, v AS a FROM y UNION ALL SELECT p_partkey, {long_form("v")} FROM y
               UNION ALL SELECT p_partkey, 'p.' || regexp_extract(v, 'p[.]([A-Z][0-9]+)X', 1) || '*' FROM y WHERE regexp_matches(v, 'p[.][A-Z][0-9]+X')
               UNION ALL SELECT p_partkey, 'p.' || replace(v, 'X', '*') FROM y WHERE regexp_matches(v, '^[A-Z][0-9]+[A-Z*]$')
               UNION ALL SELECT p_partkey, {long_form("'p.' || v")} FROM y WHERE regexp_matches(v, '^{CHANGE}$'))"""


@query("h9_hgvs_aliases", f"{ALIASES} SELECT p.p_partkey, coalesce(s.aliases, '') AS aliases FROM part p LEFT JOIN (SELECT p_partkey, array_to_string(list_sort(list_distinct(list(a))), ' ') AS aliases FROM f WHERE a <> '' GROUP BY p_partkey) s USING (p_partkey)")
def _(t: Tables):
    return t.part.select("p_partkey", F.array_join(F.array_sort(H.hgvs_aliases(F.expr(VARIANT))), " ").alias("aliases"))


@query(
    "h67_canonical_alias",
    rf"{ALIASES} SELECT p.p_partkey, coalesce(s.a, '') AS alias FROM part p LEFT JOIN (SELECT p_partkey, arg_min(a, (NOT regexp_matches(a, '(?i)fs'), NOT regexp_matches(a, '^p[.][A-Z][0-9]+([A-Z*]|del|dup|ins|fs)$'), length(a), a)) AS a FROM f WHERE a <> '' GROUP BY p_partkey) s USING (p_partkey)",
)
def _(t: Tables):
    return t.part.select("p_partkey", C.canonical_alias(F.expr(VARIANT)).alias("alias"))


RS = "CASE p_size % 7 WHEN 0 THEN '-1' WHEN 1 THEN ' RS' || CAST(p_partkey AS STRING) || ' ' WHEN 2 THEN CAST(p_partkey AS STRING) WHEN 3 THEN '' WHEN 4 THEN ' - ' WHEN 5 THEN p_name END"


@query("h13_rsid", f"SELECT p_partkey, CASE WHEN r IS NULL OR r IN ('', '-', '-1') THEN NULL WHEN lower(r) LIKE 'rs%' THEN lower(r) ELSE 'rs' || r END AS rs FROM (SELECT p_partkey, trim({RS}) AS r FROM part)")
def _(t: Tables):
    return t.part.select("p_partkey", H.rsid(F.expr(RS)).alias("rs"))


REVIEW = """CASE o_orderkey % 8 WHEN 0 THEN 'Practice guideline' WHEN 1 THEN 'reviewed by expert panel' WHEN 2 THEN 'criteria provided, multiple submitters, no conflicts' WHEN 3 THEN 'criteria provided, single submitter'
    WHEN 4 THEN 'criteria provided, conflicting classifications' WHEN 5 THEN 'no assertion criteria provided' WHEN 6 THEN o_orderpriority END"""


@query("h14_review_stars", f"SELECT o_orderkey, CASE WHEN s LIKE '%practice guideline%' THEN 4 WHEN s LIKE '%reviewed by expert panel%' THEN 3 WHEN s LIKE '%multiple submitters%' THEN 2 WHEN s LIKE '%single submitter%' OR s LIKE '%conflicting%' THEN 1 ELSE 0 END AS stars FROM (SELECT o_orderkey, lower({REVIEW}) AS s FROM orders)")
def _(t: Tables):
    return t.orders.select("o_orderkey", H.review_stars(F.expr(REVIEW)).alias("stars"))


KIND = """CASE p_size % 9 WHEN 0 THEN 'Missense variant' WHEN 1 THEN 'stop gained' WHEN 2 THEN 'Frameshift deletion' WHEN 3 THEN 'splice donor' WHEN 4 THEN 'synonymous' WHEN 5 THEN 'duplication of ' || p_name
    WHEN 6 THEN 'INDEL' WHEN 7 THEN p_type ELSE 'inversion' END"""


@query(
    "h17_variant_class",
    f"SELECT p_partkey, CASE WHEN k LIKE '%missense%' THEN 'missense' WHEN k LIKE '%nonsense%' OR k LIKE '%stop%' THEN 'nonsense' WHEN k LIKE '%frameshift%' THEN 'frameshift' WHEN k LIKE '%splice%' THEN 'splice' WHEN k LIKE '%synonymous%' THEN 'synonymous' WHEN k LIKE '%deletion%' THEN 'deletion' WHEN k LIKE '%duplication%' THEN 'duplication' WHEN k LIKE '%insertion%' THEN 'insertion' WHEN k LIKE '%indel%' THEN 'indel' WHEN k LIKE '%inversion%' THEN 'inversion' ELSE 'other' END AS c FROM (SELECT p_partkey, lower({KIND}) AS k FROM part)",
)
def _(t: Tables):
    return t.part.select("p_partkey", H.variant_class(F.expr(KIND)).alias("c"))


MODE = """CASE p_size % 13 WHEN 0 THEN 'autosomal  dominant, de novo' WHEN 1 THEN 'xlr' WHEN 2 THEN p_type WHEN 3 THEN 'X-linked dominant' WHEN 4 THEN 'Autosomal recessive' WHEN 5 THEN 'unknown' WHEN 6 THEN 'unknown inheritance'
    WHEN 7 THEN 'somatic' WHEN 8 THEN 'somatic variant' WHEN 9 THEN 'gonadal mosaicism' WHEN 10 THEN 'Maternal inheritance' WHEN 11 THEN ' semi dominant ' END"""


_SHORT = " ".join(f"WHEN lower(m) = '{k}' THEN '{v}'" for k, v in H.SHORT_MODES.items())
_PHRASES = " ".join(f"WHEN regexp_matches(lower(m), '{H.phrase_pattern(p)}') THEN '{v}'" for p, v in H.MODE_PHRASES)
_CANONICAL = ", ".join(f"'{v}'" for v in sorted(set(H.SHORT_MODES.values())))


@query("h22_inheritance", f"SELECT p_partkey, CASE WHEN coalesce(m, '') = '' THEN '' WHEN m IN ({_CANONICAL}) THEN m {_SHORT} {_PHRASES} ELSE upper(m) END AS moi FROM (SELECT p_partkey, trim({MODE}) AS m FROM part)")
def _(t: Tables):
    return t.part.select("p_partkey", H.inheritance(F.expr(MODE)).alias("moi"))


LEVEL = """CASE o_orderkey % 11 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely pathogenic' WHEN 2 THEN 'LP' WHEN 3 THEN 'Benign' WHEN 4 THEN 'likely benign' WHEN 5 THEN 'LB' WHEN 6 THEN 'VUS' WHEN 7 THEN 'Pathogenic/Likely pathogenic' WHEN 8 THEN ' not specified '
    WHEN 9 THEN o_orderpriority END"""


@query(
    "h28_severity",
    f"""SELECT o_orderkey, CASE WHEN l IN ('', 'not specified', 'unknown') THEN 2 WHEN l LIKE '%pathogenic%' AND l NOT LIKE '%likely%' AND l NOT LIKE '%benign%' THEN 4 WHEN l LIKE '%likely pathogenic%' OR l = 'lp' THEN 3
        WHEN l LIKE '%benign%' AND l NOT LIKE '%likely%' AND l NOT LIKE '%pathogenic%' THEN 0 WHEN l LIKE '%likely benign%' OR l = 'lb' THEN 1 ELSE 2 END AS severity FROM (SELECT o_orderkey, lower(trim(coalesce({LEVEL}, ''))) AS l FROM orders)""",
)
def _(t: Tables):
    return t.orders.select("o_orderkey", T.severity(T.classification_level(F.expr(LEVEL))).cast("int").alias("severity"))
