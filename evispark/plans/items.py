"""Queries of the rules for evidence items, on items made of every line of every order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade as CS
from ..operators import item_rules as IR
from .catalog import Tables, query

#: Values by field; a line takes one by its keys, and ``{k}`` stands for its part.
VALUES = {
    "A.variant_hgvs_g": ["chr7_{k}", "NC_000007.14:g.{k}A>G", "g.{k}del", "NC_000001.11:g.{k}_{k}inv", " X:{k} ", ""],
    "A.reference_sequence": ["chrX_{k}", "NM_{k}.2", "7:{k}"],
    "A.gene_symbol": ["brca{k}", "TP53", " Cftr ", "GENE{k}", "patients"],
    "A.variant_hgvs_c": ["c.{k}del", "c.{k}A>G", "c.{k}_{k}insT", "c. {k} del"],
    "A.variant_type": ["nonsense", "无义突变", "错义", "移码突变", "missense", "Nonsense "],
    "C.de_novo_status": ["De-Novo", "true", "de_novo", "inherited", "not reported", "assumed  de_novo", "maybe", "0"],
    "C.parentage_confirmed": ["yes", "confirmed", "no", "not_confirmed", "unclear", "TRUE"],
    "J.clinvar_assertion": ["PVS1, PM2", "Pathogenic (PVS1)", "likely benign", "ClinVar: BA1", "pp{k}"],
    "B.consanguinity": ["Consanguineous", "false", "N/A", "first cousins {k}", " "],
    "C.obligate_carriers": ["parents", "true", "{k}", "Both parents", "some"],
    "B.age_of_onset": ["started walking at {k} months", "symptom onset at {k}", "diagnosed after delayed walking", "{k} years"],
    "F.functional_assay": ["in silico score {k}", "luciferase assay", "Computational model"],
    "E.prediction_tools_list": ["SIFT, PolyPhen{k}", "in silico tools", "SIFT; prediction tools", "computational tools, in silico tools", "CADD", ", ;"],
}
SNIPPETS = ["", "the change was maternally inherited", "STR markers were typed", "maternity and paternity were tested", "c.{k}_{k}del was found", "reported by ClinVar", "line {k} of the table"]
NOTES = ["", "PS2-eligible", "seen twice; confirmed de novo", "none"]
GENE_VALUES = ["brca{k}", "Brca1", "family", "DNA", "CFTR-related disease", "patients mutation", "a TP53 mutation", "snp associated {k}", "unknown gene {k}", " KRAS "]
RELATION_VALUES = ["causative", "a non-causal finding {k}", "not a known disease gene", "only a preliminary report", "strongly associated", "causes disease {k}", "linked to {k}", "a risk of {k}", "unclear", "conflicting reports", "no evidence", "no known role", "{k}", "not related"]
LISTED = ["['BRCA1','tp53']", "TP53", "cftr", "['KRAS', 'HRAS']", "[]", " brca1 "]


def _pick(values: list[str], place: str):
    n = F.pmod(F.expr(place), F.lit(len(values))).cast("int")
    return F.replace(F.get(F.array(*(F.lit(v) for v in values)), n), F.lit("{k}"), F.col("l_partkey").cast("string"))


def _picked(values: list[str], place: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"replace([{quoted}][({place}) % {len(values)} + 1], '{{k}}', CAST(l_partkey AS VARCHAR))"


PLACE, OTHER = "l_suppkey * 7 + l_linenumber * 3 + l_orderkey", "l_partkey * 5 + l_orderkey"


def items(t: Tables):
    """item, group_id, field_id, status, value, snippet, raw_snippet, confidence, notes, codes."""
    names = list(VALUES)
    field = F.get(F.array(*(F.lit(f) for f in names)), F.pmod(F.expr("l_partkey + l_linenumber"), F.lit(len(names))).cast("int"))
    rows = t.lineitem.withColumn("field_id", field)
    value = F.lit(None).cast("string")
    for f, values in VALUES.items():
        value = F.when(F.col("field_id") == f, _pick(values, PLACE)).otherwise(value)
    codes = F.when(F.col("l_quantity") > 40, F.array(F.lit("PS2"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("item"), F.expr("CAST(l_orderkey AS STRING)").alias("group_id"), "field_id", F.when(F.col("l_linenumber") == 7, "not_found").otherwise("found").alias("status"),
        value.alias("value"), _pick(SNIPPETS, OTHER).alias("snippet"), F.lit(None).cast("string").alias("raw_snippet"), F.lit(0.5).alias("confidence"), _pick(NOTES, OTHER + " + l_suppkey").alias("notes"), codes.alias("codes"),
    )


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _contains(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


CASES = " ".join(f"WHEN '{f}' THEN {_picked(v, PLACE)}" for f, v in VALUES.items())
ITEMS = f"""
    l AS (SELECT *, [{', '.join(f"'{f}'" for f in VALUES)}][(l_partkey + l_linenumber) % {len(VALUES)} + 1] AS field_id FROM lineitem),
    i AS (SELECT l_orderkey * 10 + l_linenumber AS item, CAST(l_orderkey AS VARCHAR) AS group_id, field_id, CASE WHEN l_linenumber = 7 THEN 'not_found' ELSE 'found' END AS status,
                 CASE field_id {CASES} END AS value, {_picked(SNIPPETS, OTHER)} AS snippet, {_picked(NOTES, OTHER + ' + l_suppkey')} AS notes, l_quantity > 40 AS claimed FROM l)
"""
_has = "regexp_matches"
_generic, _tools = _in(IR.GENERIC_TOOLS), "list_filter(list_transform(string_split_regex(value, '[,;]'), lambda x: trim(x)), lambda x: x <> '')"
_named = f"list_filter({_tools}, lambda x: lower(x) NOT IN {_generic})"
_indel = f"{_has}(replace(regexp_replace(lower({{}}), '\\s+', '', 'g'), '&gt;', '>'), '{IR.CODING_INDEL}')"
NORMAL = rf"""
    t AS (SELECT *, trim(value) AS v, lower(trim(value)) AS w, concat_ws(' ', value, snippet) AS ev, status = 'found' AND claimed AS stripped FROM i),
    r AS (SELECT *, CASE WHEN status <> 'found' THEN NULL
        WHEN field_id IN ('A.variant_hgvs_g', 'A.reference_sequence') AND {_has}(v, '{IR.COORDINATE}') THEN 'coordinate_only'
        WHEN field_id = 'A.variant_hgvs_g' AND v <> '' AND NOT {_has}(v, '{IR.GENOMIC}') THEN 'genomic_form'
        WHEN field_id = 'A.gene_symbol' AND upper(v) <> value THEN 'gene_case'
        WHEN field_id = 'A.variant_hgvs_c' AND replace(value, ' ', '') <> value THEN 'shortest_alias'
        WHEN field_id = 'C.de_novo_status' AND {_has}(ev, '{IR.INHERITED}') THEN 'inherited'
        WHEN field_id = 'C.de_novo_status' AND w IN {_in(IR.NOT_DE_NOVO)} THEN 'not_de_novo'
        WHEN field_id = 'C.de_novo_status' AND w <> 'de_novo' AND trim(regexp_replace(w, '[\s_\-]+', ' ', 'g')) IN {_in(IR.DE_NOVO)} THEN 'de_novo'
        WHEN field_id = 'C.de_novo_status' AND w IN {_in(IR.NOT_REPORTED)} THEN 'not_reported'
        WHEN field_id = 'C.parentage_confirmed' AND w IN {_in(IR.CONFIRMED)} AND {_has}(ev, '{IR.PARENTAGE}') THEN 'parentage_tested'
        WHEN field_id = 'C.parentage_confirmed' AND value <> 'not_confirmed' AND w IN {_in(IR.CONFIRMED + IR.UNCONFIRMED)} THEN 'parentage_untested'
        WHEN field_id = 'A.variant_type' AND w IN {_in(IR.NONSENSE)} AND {_indel.format('ev')} THEN 'coding_indel'
        WHEN field_id = 'A.variant_type' AND w = '错义' THEN 'variant_word_missense' WHEN field_id = 'A.variant_type' AND w = '移码突变' THEN 'variant_word_frameshift' WHEN field_id = 'A.variant_type' AND w = '无义突变' THEN 'variant_word_nonsense'
        WHEN field_id = 'J.clinvar_assertion' AND {_has}(value, '{IR.CRITERION}') AND NOT {_contains('lower(value)', IR.SIGNIFICANCE)} THEN 'criteria_no_assertion'
        WHEN field_id = 'B.consanguinity' AND w = 'consanguineous' THEN 'consanguinity_present' WHEN field_id = 'B.consanguinity' AND w = 'false' THEN 'consanguinity_absent' WHEN field_id = 'B.consanguinity' AND w = 'n/a' THEN 'consanguinity_unknown'
        WHEN field_id = 'B.consanguinity' AND v <> '' THEN 'consanguinity_described'
        WHEN field_id = 'C.obligate_carriers' AND w IN ('true', 'parents', 'both parents') THEN 'carriers_' || replace(w, ' ', '_')
        WHEN field_id = 'B.age_of_onset' AND {_has}(w, '{IR.MILESTONE}') AND NOT {_contains('w', IR.ONSET)} THEN 'milestone_no_onset'
        WHEN field_id = 'F.functional_assay' AND {_contains('w', ['in silico', 'computational'])} THEN 'prediction_no_function'
        WHEN field_id = 'E.prediction_tools_list' AND w NOT IN {_generic} AND {_has}(value, '[,;]') AND len({_named}) > 0 THEN CASE WHEN len({_named}) < len({_tools}) THEN 'generic_tool_dropped' ELSE 'tools_listed' END
        WHEN field_id = 'E.prediction_tools_list' AND (w IN {_generic} OR {_has}(value, '[,;]')) THEN 'no_named_tool' END AS rule FROM t),
    s AS (SELECT *, coalesce(rule IN ('coordinate_only', 'genomic_form', 'criteria_no_assertion', 'milestone_no_onset', 'prediction_no_function', 'no_named_tool'), FALSE) AS rejected,
        CASE rule WHEN 'gene_case' THEN upper(v) WHEN 'shortest_alias' THEN replace(value, ' ', '') WHEN 'inherited' THEN 'not_de_novo' WHEN 'not_de_novo' THEN 'not_de_novo' WHEN 'de_novo' THEN 'de_novo' WHEN 'not_reported' THEN 'unknown_not_reported'
            WHEN 'parentage_tested' THEN 'confirmed' WHEN 'parentage_untested' THEN 'not_confirmed' WHEN 'coding_indel' THEN 'frameshift' WHEN 'variant_word_missense' THEN 'missense' WHEN 'variant_word_frameshift' THEN 'frameshift'
            WHEN 'variant_word_nonsense' THEN 'nonsense' WHEN 'consanguinity_present' THEN 'present' WHEN 'consanguinity_absent' THEN 'absent' WHEN 'consanguinity_unknown' THEN 'unknown' WHEN 'consanguinity_described' THEN 'present:' || v
            WHEN 'carriers_true' THEN '2' WHEN 'carriers_parents' THEN '2' WHEN 'carriers_both_parents' THEN '2' WHEN 'generic_tool_dropped' THEN array_to_string({_named}, '; ') WHEN 'tools_listed' THEN array_to_string({_named}, '; ') ELSE value END AS new,
        concat_ws('; ', nullif(notes, ''), CASE WHEN stripped THEN 'criterion_claim:stripped_runtime_codes' END, CASE rule WHEN 'inherited' THEN 'criterion_claim:inherited_not_de_novo' WHEN 'criteria_no_assertion' THEN 'criterion_claim:author_acmg_codes_not_clinvar' END) AS note FROM r),
    u AS (SELECT *, field_id = 'C.de_novo_status' AND status = 'found' AND new = 'de_novo' AND {_has}(note, '{IR.CLAIMED_PS2}') AND NOT {_has}(ev, '{IR.PARENTAGE}') AS downgraded FROM s),
    g AS (SELECT DISTINCT group_id FROM u WHERE field_id = 'A.variant_hgvs_c' AND status = 'found' AND {_indel.format('new')}),
    n AS (SELECT u.*, g.group_id IS NOT NULL AND field_id = 'A.variant_type' AND status = 'found' AND lower(trim(new)) IN {_in(IR.NONSENSE)} AS aligned FROM u LEFT JOIN g USING (group_id)),
    f AS (SELECT item, field_id, CASE WHEN rejected THEN 'not_found' ELSE status END AS status, CASE WHEN rejected THEN NULL WHEN aligned THEN 'frameshift' ELSE new END AS value,
        CASE WHEN downgraded THEN regexp_replace(note, '{IR.CLAIMED_PS2}', 'PM6-eligible', 'g') || '; criterion_claim:unconfirmed_parentage_not_ps2' ELSE note END AS notes, claimed AND NOT stripped AS has_codes,
        concat_ws(',', CASE WHEN stripped THEN 'claimed_codes' END, rule, CASE WHEN downgraded THEN 'unconfirmed_parentage' END, CASE WHEN aligned THEN 'aligned_to_coding_change' END) AS rules FROM n)
"""


def trail():
    return F.array_join(F.transform("audit", lambda a: a["rule"]), ",").alias("rules")


@query("h66_value_rules", f"WITH {ITEMS}, {NORMAL} SELECT item, field_id, status, value, coalesce(notes, '') AS notes, has_codes, rules FROM f")
def _(t: Tables):
    found = IR.normalized(items(t))
    return found.select("item", "field_id", "status", "value", F.coalesce("notes", F.lit("")).alias("notes"), (F.size("codes") > 0).alias("has_codes"), trail())


@query("h66_issues", f"WITH {ITEMS}, {NORMAL}, e AS (SELECT field_id, unnest(string_split(rules, ',')) AS rule FROM f WHERE rules <> '') SELECT field_id, rule, count(*) AS n FROM e GROUP BY ALL")
def _(t: Tables):
    return CS.issues(IR.normalized(items(t)), ["item", "field_id"]).groupBy("field_id", "rule").agg(F.count("*").alias("n"))


_NEAR = f"regexp_extract(v, '{IR.GENE_RELATED}', 1)"
_HEDGES = " ".join(f"WHEN {_has}(w, '{p}') THEN '{v}'" for p, v in IR.RELATION_HEDGES)
_NAMED = " ".join(f"WHEN contains(w, '{v}') THEN '{v}'" for v in IR.RELATIONS)
_CUED = " ".join(f"WHEN {_has}(w, '{p}') THEN '{v}'" for v, p in IR.RELATION_CUES.items())


@query(
    "h65_constrained",
    rf"""WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS item, CASE WHEN l_linenumber % 2 = 0 THEN 'A.gene_symbol' ELSE 'A.gene_disease_relationship' END AS field_id,
        CASE WHEN l_linenumber % 2 = 0 THEN {_picked(GENE_VALUES, PLACE)} ELSE {_picked(RELATION_VALUES, PLACE)} END AS value FROM lineitem), t AS (SELECT *, trim(value) AS v, lower(trim(value)) AS w, {_has}(trim(value), '^[A-Za-z][A-Za-z0-9]{{1,9}}$') AS shaped FROM i)
    SELECT item, field_id, CASE WHEN field_id = 'A.gene_symbol' THEN CASE WHEN shaped AND w IN {_in(IR.NO_GENES)} THEN NULL WHEN shaped AND v <> w AND upper(v) NOT IN {_in(IR.NO_SYMBOLS)} THEN upper(v) WHEN NOT shaped AND lower({_NEAR}) IN {_in(IR.NO_GENES)} THEN NULL
        WHEN NOT shaped AND {_NEAR} <> '' AND upper({_NEAR}) NOT IN {_in(IR.NO_SYMBOLS)} THEN upper({_NEAR}) ELSE value END
        ELSE CASE WHEN w IN {_in(IR.RELATIONS)} THEN value {_HEDGES} {_NAMED} {_CUED} ELSE value END END AS value FROM t""",
)
def _(t: Tables):
    even = F.col("l_linenumber") % 2 == 0
    rows = t.lineitem.select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("item"), F.when(even, "A.gene_symbol").otherwise("A.gene_disease_relationship").alias("field_id"), F.lit("found").alias("status"),
        F.when(even, _pick(GENE_VALUES, PLACE)).otherwise(_pick(RELATION_VALUES, PLACE)).alias("value"),
    )
    return IR.constrained(rows).select("item", "field_id", "value")


@query(
    "h64_guarded",
    f"""WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS item, {_picked(LISTED, PLACE)} AS value, CASE l_suppkey % 3 WHEN 0 THEN 'TP53' WHEN 1 THEN 'BRCA1' END AS target FROM lineitem),
    t AS (SELECT *, list_filter(list_transform(CASE WHEN starts_with(value, '[') THEN regexp_extract_all(value, '''([^'']+)''', 1) ELSE [value] END, lambda x: upper(trim(x))), lambda x: x NOT IN ('', ',')) AS g FROM i)
    SELECT item, CASE WHEN target IS NULL OR list_contains(g, target) THEN 'found' ELSE 'context_contamination' END AS status, CASE WHEN target IS NOT NULL AND list_contains(g, target) THEN target ELSE value END AS value,
        CASE WHEN target IS NULL THEN '' WHEN len(g) > 1 AND list_contains(g, target) THEN 'gene_of_list' WHEN len(g) > 1 THEN 'gene_not_listed' WHEN list_contains(g, target) THEN 'gene_is_target' ELSE 'other_gene' END AS rules FROM t""",
)
def _(t: Tables):
    target = F.when(F.col("l_suppkey") % 3 == 0, "TP53").when(F.col("l_suppkey") % 3 == 1, "BRCA1")
    rows = t.lineitem.select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("item"), F.lit("A.gene_symbol").alias("field_id"), F.lit("found").alias("status"), _pick(LISTED, PLACE).alias("value"),
        target.alias("target_gene"), F.lit(None).cast("string").alias("target_hgvs_c"), F.lit(None).cast("string").alias("target_hgvs_p"),
    )
    return IR.guarded(rows).select("item", "status", "value", trail())


@query(
    "h87_admission",
    f"""WITH {ITEMS} SELECT item, CASE WHEN field_id <> 'J.clinvar_assertion' OR status <> 'found' OR {_has}(value, '{IR.AUTHORITY}') OR {_has}(snippet, '{IR.AUTHORITY}') THEN status ELSE 'context_contamination' END AS status FROM i""",
)
def _(t: Tables):
    rows = items(t).withColumn("status", F.concat(F.lit("Status."), F.upper("status"))).withColumn("source_database", F.lit(None).cast("string"))
    return IR.admitted(rows).select("item", "status")


@query(
    "h63_grounding_aliases",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat('Arg', p_partkey, 'Cys|p.R', p_partkey, 'C|R', p_partkey, 'C') WHEN 1 THEN concat('R', p_partkey, '*|p.Arg', p_partkey, 'Ter')
    WHEN 2 THEN concat('Gly', p_partkey, 'fsTer', p_size, '|p.G', p_partkey, 'fs*', p_size, '|G', p_partkey, 'fs*', p_size) ELSE '' END AS aliases FROM part""",
)
def _(t: Tables):
    snippet = F.expr("CASE p_size % 4 WHEN 0 THEN concat('p.Arg', p_partkey, 'Cys') WHEN 1 THEN concat('p.R', p_partkey, '*') WHEN 2 THEN concat('p.Gly', p_partkey, 'fsTer', p_size) ELSE p_name END")
    return t.part.select("p_partkey", F.array_join(IR.grounding_aliases(snippet), "|").alias("aliases"))
