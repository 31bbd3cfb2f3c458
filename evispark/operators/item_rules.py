"""Rules for extracted evidence items: values made ready for use, constrained formats, target guard, admission, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hgvs
from ..functions import text as T
from ..sources.scratch import stored
from .cascade import Rule, apply
from .comparison import canonical_alias

# Words, patterns and notes that decide how an item is read; results must equal theirs.
COORDINATE = r"(?i)^(?:chr)?[0-9XYM]+[_:][0-9]+$"
GENOMIC = r"^[A-Z]{1,3}_[0-9]+(?:\.[0-9]+)?:g\.(?:[0-9]+[ACGT]>[ACGT]|[0-9]+(?:_[0-9]+)?del(?:[ACGT]+)?|[0-9]+(?:_[0-9]+)?ins[ACGT]+|[0-9]+(?:_[0-9]+)?dup(?:[ACGT]+)?|[0-9]+_[0-9]+inv)$"
DE_NOVO = ["1", "true", "de novo", "denovo", "assumed de novo", "assumed denovo", "pm6 eligible"]
NOT_DE_NOVO = ["0", "false", "not de novo", "not_de_novo", "inherited"]
NOT_REPORTED = ["unknown", "not reported", "not_reported", "unknown_not_reported"]
INHERITED = r"(?i)maternally inherited|paternally inherited|inherited from (?:the )?(?:mother|father|maternal|paternal)|maternal inheritance|paternal inheritance|遗传自母|遗传自父|母系遗传|父系遗传|来自母亲|来自父亲"
PARENTAGE = r"(?i)parentage confirm|maternity.{0,40}paternity|paternity.{0,40}maternity|identity testing|\bSTR(?:s)?\b|亲子鉴定|亲权"
CONFIRMED = ["true", "1", "confirmed", "yes", "parentage_confirmed"]
UNCONFIRMED = ["false", "0", "absent", "not_confirmed", "unconfirmed", "no", "not confirmed"]
CLAIMED_PS2 = r"(?i)PS2-eligible|confirmed PS2|\bPS2\b|confirmed de novo"
CODING_INDEL = r"(?i)c\.\d+(?:_\d+)?(?:del|ins)"
NONSENSE = ["nonsense", "无义", "无义突变"]
VARIANT_WORDS = {"错义": "missense", "错义突变": "missense", "移码": "frameshift", "移码突变": "frameshift", "无义": "nonsense", "无义突变": "nonsense"}
CRITERION = r"(?i)\b(?:PVS1|PS[1-4]|PM[1-6]|PP[1-5]|BA1|BS[1-4]|BP[1-7])\b"
SIGNIFICANCE = ["pathogenic", "benign", "vus", "uncertain"]
CONSANGUINITY = {"present": ["present", "consanguineous", "true"], "absent": ["absent", "non-consanguineous", "false"], "unknown": ["unknown", "not reported", "not_reported", "not applicable", "n/a", "na"]}
CARRIERS = {"true": "2", "false": "0", "parents": "2", "both parents": "2"}
MILESTONE = r"\bstarted sitting\b|\bsitting with support\b|\bstarted walking\b|\bdelayed walking\b|\bstarted speaking\b|\bdevelopmental milestone\b"
ONSET = ["onset", "presented", "presentation", "diagnosed", "referred", "symptom"]
GENERIC_TOOLS = ["in silico tools", "bioinformatics tools", "prediction tools", "computational tools"]
NO_GENES = ["unknown", "none", "not found", "not_found", "n/a", "na", "gene", "genes", "patient", "patients", "proband", "family", "control", "controls", "case", "cases", "study", "studies", "sample", "samples", "variant", "variants", "mutation", "mutations", "exon", "exons", "intron", "introns", "chromosome", "deletion", "insertion", "analysis", "testing", "normal", "abnormal", "positive", "negative", "wildtype", "heterozygous", "homozygous", "carrier", "carriers"]
NO_SYMBOLS = ["ACMG", "CNV", "DNA", "HGNC", "HGVS", "OMIM", "RNA", "SNP"]
GENE_RELATED = r"(?i)\b([A-Za-z][A-Za-z0-9]{1,9})(?:[-\s]+)(?:related|mutation|associated)\b"
RELATIONS = ["causative", "associated", "susceptibility", "uncertain", "disputed", "refuted", "no_relationship"]
RELATION_HEDGES = [(r"\b(?:non[-\s]?caus(?:al|ative)?|not (?:a )?caus(?:al|ative)?)\b", "associated"), (r"\bnot (?:a )?(?:known )?disease gene\b", "uncertain"), ("preliminary association|only a preliminary", "associated")]
RELATION_CUES = {
    "causative": r"\bcauses?\b|\bcausative\b|\bcausal\b|\bpathogenic\b|\bresponsible\b|\bknown disease gene\b|\bdisease gene\b",
    "associated": r"\bassociated\b|\bassociation\b|\blink(?:ed)?\b|\brelated\b",
    "susceptibility": r"\bsusceptibility\b|\bsusceptible\b|\brisk\b|\bpredispos",
    "uncertain": r"\buncertain\b|\bunclear\b|\bpossible\b|\bpotential\b",
    "disputed": r"\bdisputed\b|\bcontroversial\b|\bconflicting\b",
    "refuted": r"\brefuted\b|\brefute\b|\bno evidence\b|\bnot supported\b",
    "no_relationship": r"\bno relationship\b|\bno known\b|\bnot related\b",
}
AUTHORITY = r"(?i)\b(?:ClinVar|ClinGen|ACMG|PVS\d?|PS\d?|PM\d?|PP\d?|BA\d?|BS\d?|BP\d?)\b"
# End of the fixed values.


def low(s: Column) -> Column:
    return F.lower(F.trim(s["value"]))


def _evidence(s: Column) -> Column:
    """The value and the snippets that it was read from."""
    return F.concat_ws(" ", s["value"], F.col("snippet"), F.col("raw_snippet"))


def _same(text: str):
    return lambda s: F.lit(text)


def _has_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _listed(s: Column) -> Column:
    return F.filter(F.transform(F.split(s["value"], "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def _named(s: Column) -> Column:
    return F.filter(_listed(s), lambda x: ~F.lower(x).isin(GENERIC_TOOLS))


def coding_indel(c: Column) -> Column:
    return F.rlike(F.replace(F.regexp_replace(F.lower(c), r"\s+", ""), F.lit("&gt;"), F.lit(">")), F.lit(CODING_INDEL))


def _split_tools(s: Column) -> Column:
    return F.rlike(s["value"], F.lit("[,;]")) & ~low(s).isin(GENERIC_TOOLS)


GENES, VARIANTS = ("A.gene_symbol", "A.gene_aliases"), ("A.variant_hgvs_c", "A.variant_hgvs_p")


def value_rules() -> list[Rule]:
    """Values of single fields: what can be read one way only is rewritten, what is no evidence is rejected.

    Forms that need Unicode folding stand in the columns _upper and _short, as lambdas hold no Python function.
    """
    error = {"kind": "semantic_conflict", "severity": "error", "reject": True}
    invalid = {"kind": "invalid_hgvs", "severity": "error", "reject": True}
    fit = F.rlike
    rules = [
        Rule("claimed_codes", lambda s: F.size(s["codes"]) > 0, note="criterion_claim:stripped_runtime_codes", clear_codes=True, exclusive=False, kind="claim_stripped"),
        Rule("coordinate_only", lambda s: fit(F.trim(s["value"]), F.lit(COORDINATE)), ("A.variant_hgvs_g", "A.reference_sequence", "A.variant_legacy_name"), **invalid),
        Rule("genomic_form", lambda s: (F.trim(s["value"]) != "") & ~fit(F.trim(s["value"]), F.lit(GENOMIC)), ("A.variant_hgvs_g",), **invalid),
        Rule("gene_case", lambda s: F.col("_upper") != s["value"], GENES, value=lambda s: F.col("_upper")),
        Rule("shortest_alias", lambda s: (F.col("_short") != "") & (F.col("_short") != s["value"]), VARIANTS, value=lambda s: F.col("_short")),
        Rule("inherited", lambda s: fit(_evidence(s), F.lit(INHERITED)), ("C.de_novo_status",), value=_same("not_de_novo"), note="criterion_claim:inherited_not_de_novo"),
        Rule("not_de_novo", lambda s: low(s).isin(NOT_DE_NOVO), ("C.de_novo_status",), value=_same("not_de_novo")),
        Rule("de_novo", lambda s: (low(s) != "de_novo") & F.trim(F.regexp_replace(low(s), r"[\s_\-]+", " ")).isin(DE_NOVO), ("C.de_novo_status",), value=_same("de_novo")),
        Rule("not_reported", lambda s: low(s).isin(NOT_REPORTED), ("C.de_novo_status",), value=_same("unknown_not_reported")),
        Rule(
            "unconfirmed_parentage", lambda s: (low(s) == "de_novo") & fit(F.coalesce(s["notes"], F.lit("")), F.lit(CLAIMED_PS2)) & ~fit(_evidence(s), F.lit(PARENTAGE)), ("C.de_novo_status",), exclusive=False, kind="claim_stripped",
            notes=lambda s: F.regexp_replace(s["notes"], CLAIMED_PS2, "PM6-eligible"), note="criterion_claim:unconfirmed_parentage_not_ps2",
        ),
        Rule("parentage_tested", lambda s: fit(_evidence(s), F.lit(PARENTAGE)) & low(s).isin(CONFIRMED), ("C.parentage_confirmed",), value=_same("confirmed")),
        Rule("parentage_untested", lambda s: (s["value"] != "not_confirmed") & low(s).isin(CONFIRMED + UNCONFIRMED), ("C.parentage_confirmed",), value=_same("not_confirmed")),
        Rule("coding_indel", lambda s: low(s).isin(NONSENSE) & coding_indel(_evidence(s)), ("A.variant_type",), value=_same("frameshift")),
        *(Rule(f"variant_word_{v}", lambda s, v=v: low(s).isin([k for k, x in VARIANT_WORDS.items() if x == v]), ("A.variant_type",), value=_same(v)) for v in ("missense", "frameshift", "nonsense")),
        Rule("criteria_no_assertion", lambda s: fit(s["value"], F.lit(CRITERION)) & ~_has_any(F.lower(s["value"]), SIGNIFICANCE), ("J.clinvar_assertion",), note="criterion_claim:author_acmg_codes_not_clinvar", kind="semantic_conflict", severity="warning", reject=True),
        *(Rule(f"consanguinity_{v}", lambda s, words=words: low(s).isin(words), ("B.consanguinity",), value=_same(v)) for v, words in CONSANGUINITY.items()),
        Rule("consanguinity_described", lambda s: F.trim(s["value"]) != "", ("B.consanguinity",), value=lambda s: F.concat(F.lit("present:"), F.trim(s["value"]))),
        *(Rule(f"carriers_{k.replace(' ', '_')}", lambda s, k=k: low(s) == k, ("C.obligate_carriers",), value=_same(v)) for k, v in CARRIERS.items()),
        Rule("milestone_no_onset", lambda s: fit(low(s), F.lit(MILESTONE)) & ~_has_any(low(s), ONSET), ("B.age_of_onset",), **error),
        Rule("prediction_no_function", lambda s: _has_any(low(s), ["in silico", "computational"]), ("F.",), **error),
        Rule("generic_tool_dropped", lambda s: _split_tools(s) & (F.size(_named(s)) > 0) & (F.size(_named(s)) < F.size(_listed(s))), ("E.prediction_tools_list",), value=lambda s: F.array_join(_named(s), "; "), kind="generic_prediction_tool", severity="warning"),
        Rule("tools_listed", lambda s: _split_tools(s) & (F.size(_named(s)) > 0), ("E.prediction_tools_list",), value=lambda s: F.array_join(_named(s), "; ")),
        Rule("no_named_tool", lambda s: low(s).isin(GENERIC_TOOLS) | _split_tools(s), ("E.prediction_tools_list",), kind="generic_prediction_tool", severity="warning", reject=True),
    ]
    return rules


VALUE_FIELDS = ["A.variant_hgvs_g", "A.reference_sequence", "A.variant_legacy_name", "A.gene_symbol", "A.gene_aliases", "A.variant_hgvs_c", "A.variant_hgvs_p", "C.de_novo_status", "C.parentage_confirmed", "A.variant_type", "J.clinvar_assertion", "B.consanguinity", "C.obligate_carriers", "B.age_of_onset", "F.", "E.prediction_tools_list"]


def normalized(items: DataFrame) -> DataFrame:
    """items (group_id, field_id, status, value, snippet, raw_snippet, confidence, notes, codes) by the value rules, then
    aligned within their groups: a nonsense label is a frameshift where a sibling's coding change is an insertion or deletion.
    """
    of = lambda fields: F.when(F.col("field_id").isin(*fields), F.col("value"))
    forms = items.withColumn("_upper", F.upper(F.trim(T.nfkc(of(GENES))))).withColumn("_short", canonical_alias(of(VARIANTS)))
    # Written, as three steps read it, and no filter should run the rules again.
    ruled = stored(apply(forms, value_rules(), VALUE_FIELDS).drop("_upper", "_short"))
    group = F.coalesce("group_id", F.lit(""))
    coding = (F.col("status") == "found") & (F.col("field_id") == "A.variant_hgvs_c") & coding_indel(F.col("value"))
    # Groups with such a change, found by a partial aggregation; only rows that may change meet them.
    may = (F.col("field_id") == "A.variant_type") & (F.col("status") == "found") & F.lower(F.trim("value")).isin(NONSENSE)
    groups = ruled.filter(coding).select(group.alias("_group")).distinct().withColumn("_coding", F.lit(True))
    marked = ruled.filter(may).withColumn("_group", group).join(groups, "_group", "left").drop("_group")
    align = [Rule("aligned_to_coding_change", lambda s: F.col("_coding"), ("A.variant_type",), value=_same("frameshift"))]
    aligned = apply(marked, align, ["A.variant_type"]).drop("_coding")
    return ruled.filter(~F.coalesce(may, F.lit(False))).unionByName(aligned)


def constrained(items: DataFrame) -> DataFrame:
    """Gene symbols and gene-disease relationships in their constrained formats."""
    symbol = lambda s: F.trim(s["value"])
    shaped = lambda s: F.rlike(symbol(s), F.lit("^[A-Za-z][A-Za-z0-9]{1,9}$"))
    near = lambda s: F.regexp_extract(symbol(s), GENE_RELATED, 1)
    gene = ("A.gene_symbol",)
    relation = ("A.gene_disease_relationship",)
    rules = [
        Rule("no_gene_word", lambda s: shaped(s) & low(s).isin(NO_GENES), gene, reject=True, kind="semantic_conflict", severity="warning"),
        Rule("symbol_case", lambda s: shaped(s) & (symbol(s) != low(s)) & ~F.upper(symbol(s)).isin(NO_SYMBOLS), gene, value=lambda s: F.upper(symbol(s))),
        Rule("no_related_gene_word", lambda s: ~shaped(s) & F.lower(near(s)).isin(NO_GENES), gene, reject=True, kind="semantic_conflict", severity="warning"),
        Rule("related_gene", lambda s: ~shaped(s) & (near(s) != "") & ~F.upper(near(s)).isin(NO_SYMBOLS), gene, value=lambda s: F.upper(near(s))),
        Rule("relation_given", lambda s: low(s).isin(RELATIONS), relation),
        *(Rule(f"relation_hedged_{i}", lambda s, p=p: F.rlike(low(s), F.lit(p)), relation, value=_same(v)) for i, (p, v) in enumerate(RELATION_HEDGES)),
        *(Rule(f"relation_named_{v}", lambda s, v=v: F.contains(low(s), F.lit(v)), relation, value=_same(v)) for v in RELATIONS),
        *(Rule(f"relation_cued_{v}", lambda s, p=p: F.rlike(low(s), F.lit(p)), relation, value=_same(v)) for v, p in RELATION_CUES.items()),
    ]
    return apply(items, rules, [*gene, *relation])


def guarded(items: DataFrame) -> DataFrame:
    """items with their target (target_gene, target_hgvs_c, target_hgvs_p): values that are not the target's are contaminated.

    Of a listed gene the target is taken if the list has it; of a variant's aliases one must be the target's.
    """
    genes = lambda s: F.filter(F.transform(hgvs._listed(F.trim(s["value"])), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    target = F.col("target_gene")
    known = target.isNotNull()
    wrong = lambda what, t: lambda s: F.concat(F.lit(f"target_guard:extracted {what}"), F.trim(s["value"]), F.lit(", expected "), t)
    out = {"status": "context_contamination", "clear_codes": True, "kind": "target_mismatch", "severity": "error"}
    rules = [
        Rule("gene_of_list", lambda s: known & (F.size(genes(s)) > 1) & F.array_contains(genes(s), target), ("A.gene_symbol",), value=lambda s: target, note="target_guard:list_to_target"),
        Rule("gene_not_listed", lambda s: known & (F.size(genes(s)) > 1), ("A.gene_symbol",), note=wrong("genes ", target), **out),
        Rule("gene_is_target", lambda s: known & (F.coalesce(F.get(genes(s), F.lit(0)), F.lit("")) == target), ("A.gene_symbol",), value=lambda s: target),
        Rule("other_gene", lambda s: known, ("A.gene_symbol",), note=wrong("", target), **out),
    ]
    for field, name in (("A.variant_hgvs_c", "target_hgvs_c"), ("A.variant_hgvs_p", "target_hgvs_p")):
        t, aliases = F.col(name), F.col(f"_{name}")
        have = F.size(aliases) > 0
        rules += [
            Rule("variant_is_target", lambda s, have=have, aliases=aliases: have & F.arrays_overlap(F.col("_aliases"), aliases), (field,), value=lambda s, t=t: t, note="target_guard:variant_to_target"),
            Rule("other_variant", lambda s, have=have: have, (field,), note=wrong("variant ", t), **out),
        ]
    # Aliases are made before, as lambdas hold no Python function.
    forms = items.withColumn("_aliases", hgvs.hgvs_aliases(F.when(F.col("field_id").isin(*VARIANTS), F.col("value"))))
    for name in ("target_hgvs_c", "target_hgvs_p"):
        forms = forms.withColumn(f"_{name}", hgvs.hgvs_aliases(F.col(name)))
    return apply(forms, rules, ["A.gene_symbol", *VARIANTS]).drop("_aliases", "_target_hgvs_c", "_target_hgvs_p")


def admitted(items: DataFrame) -> DataFrame:
    """Assertions that name no authority (value, source_database, snippets) are contamination; other statuses are as they were,
    without what stands before their last dot and in lower case."""
    plain = items.withColumn("status", F.lower(F.trim(F.substring_index("status", ".", -1))))
    named = F.lit(False)
    for c in ("value", "source_database", "snippet", "raw_snippet"):
        named = named | F.coalesce(F.rlike(F.col(c), F.lit(AUTHORITY)), F.lit(False))
    rule = Rule("no_authority", lambda s: ~named, ("J.clinvar_assertion",), status="context_contamination", kind="no_authority", severity="warning")
    return apply(plain, [rule], ["J.clinvar_assertion"])


def grounding_aliases(snippet: Column) -> Column:
    """array<string>: other spellings of a protein change that a source may use, in the order to try; without the snippet."""
    c = F.trim(snippet)
    compact = F.regexp_replace(c, r"\s*([()])\s*", "$1")
    one = F.create_map(*(F.lit(x) for pair in hgvs.AMINO.items() for x in pair))
    three = F.create_map(*(F.lit(x) for a, b in hgvs.AMINO.items() for x in (b, a)))
    codes, letters = hgvs._any(list(hgvs.AMINO)), "".join(hgvs.AMINO.values())

    def parts(x: Column, pattern: str) -> list[Column]:
        return [F.regexp_extract(x, pattern, k) for k in (1, 2, 3)]

    def shorter(x: Column) -> Column:
        shift = parts(x, rf"p[.]({codes})([0-9]+)fsTer([0-9]+)")
        sub = parts(x, rf"p[.]({codes})([0-9]+)({codes}|Ter|[*]|X|stop)")
        became = F.when(sub[2].isin("Ter", "*", "X", "stop"), "*").otherwise(F.try_element_at(one, sub[2]))
        return F.when(shift[0] != "", F.concat(F.lit("p."), F.try_element_at(one, shift[0]), shift[1], F.lit("fs*"), shift[2])).when(sub[0] != "", F.concat(F.lit("p."), F.try_element_at(one, sub[0]), sub[1], became))

    def longer(x: Column) -> Column:
        shift = parts(x, rf"p[.]([{letters}])([0-9]+)fs[*]([0-9]+)")
        sub = parts(x, rf"p[.]([{letters}])([0-9]+)([{letters}*])")
        became = F.when(sub[2] == "*", "Ter").otherwise(F.try_element_at(three, sub[2]))
        return F.when(shift[0] != "", F.concat(F.lit("p."), F.try_element_at(three, shift[0]), shift[1], F.lit("fsTer"), shift[2])).when(sub[0] != "", F.concat(F.lit("p."), F.try_element_at(three, sub[0]), sub[1], became))

    bare = lambda x: F.when(F.startswith(x, F.lit("p.")), F.substring(x, 3, 1 << 30))
    tried = [compact, bare(compact)]
    for x in (c, compact):
        tried += [shorter(x), bare(shorter(x)), longer(x)]
    found = F.filter(F.array(*(F.trim(x) for x in tried)), lambda x: x.isNotNull() & (x != "") & (x != snippet))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))
