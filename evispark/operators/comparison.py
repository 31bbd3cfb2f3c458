"""Expected against extracted evidence: graded field matches, standardization, upper bounds, and what feeds a learned arbiter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hgvs as H
from ..functions import text as T
from . import evaluation as E

#: Phrases that stand for a phenotype; blanks in them stand for any white space.
PHENOTYPES = {
    "HP:0001250": ["seizure", "seizures", "epileptic", "epileptiform"],
    "HP:0001252": ["hypotonia", "low muscular tension", "abnormal muscular tension"],
    "HP:0001263": ["developmental delay", "developmental backwardness", "developmental regression", "global developmental delay"],
    "HP:0001631": ["atrial septal defect"],
    "HP:0012759": ["severe neonatal encephalopathy", "neonatal encephalopathy"],
    "HP:0002353": ["abnormal eeg", "spike slow wave", "spike slow waves", "slow wave", "slow waves"],
}
#: Fields by how their values are compared, and sources that are (not) the article itself.
CODING_FIELD, PROTEIN_FIELD = "A.variant_hgvs_c", "A.variant_hgvs_p"
MODE_FIELDS = ["B.mode_of_inheritance_reported", "K.mode_of_inheritance"]
TYPE_FIELD, RELATIONSHIP_FIELD, DISEASE_FIELD, GENE_FIELD = "A.variant_type", "A.gene_disease_relationship", "B.disease_diagnosis", "A.gene_symbol"
PHENOTYPE_FIELDS = ["B.hpo_terms", "B.clinical_phenotypes"]
ARTICLE_SOURCES = ["", "article", "literature", "paper", "source_text"]
EXTERNAL_SOURCES = ["database", "clinvar", "clingen", "clingen_clinvar_join", "external"]


def phenotype_terms(c: Column) -> Column:
    """Identifiers HP:1234567 in a text and those its phrases stand for, distinct and sorted, joined by ``;``; else the text."""
    text = F.trim(F.coalesce(c, F.lit("")))
    low = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    named = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(HP:[0-9]{7})"), F.lit(1)), F.upper)
    implied = [F.when(F.rlike(low, F.lit(rf"\b(?:{'|'.join(phrases)})\b")), code) for code, phrases in PHENOTYPES.items()]
    found = F.array_sort(F.array_distinct(F.concat(named, F.array_compact(F.array(*implied)))))
    return F.when(F.size(found) > 0, F.array_join(found, ";")).otherwise(text)


def canonical_alias(c: Column) -> Column:
    """The preferred alias of a variant: a frame shift before others, a one-letter protein change before other forms, then
    the shortest, then the first in order; empty if there is none."""
    known = H.hgvs_aliases(c)
    keyed = F.transform(
        known,
        lambda a: F.struct(
            F.when(F.rlike(a, F.lit("(?i)fs")), 0).otherwise(1).alias("shift"),
            F.when(F.rlike(a, F.lit(r"^p\.[A-Z][0-9]+(?:[A-Z*]|del|dup|ins|fs)$")), 0).otherwise(1).alias("other"),
            F.length(a).alias("n"), a.alias("a"),
        ),
    )
    return F.coalesce(F.array_min(keyed)["a"], F.lit(""))


def field_normal(field_id: Column, value: Column) -> Column:
    """A value in the form in which its field is compared; other fields keep theirs, null and empty ones are empty."""
    return F.coalesce(
        F.when(field_id.isin(CODING_FIELD, PROTEIN_FIELD), canonical_alias(value))
        .when(field_id.isin(MODE_FIELDS), H.inheritance(value))
        .when(field_id == TYPE_FIELD, H.variant_class(value))
        .when(field_id == RELATIONSHIP_FIELD, T.relationship(value))
        .when(field_id.isin(PHENOTYPE_FIELDS), phenotype_terms(value))
        .otherwise(value),
        F.lit(""),
    )


def article_supported(evaluation_type: Column, source: Column, gold_source: Column) -> Column:
    """Whether an expected field counts for a reader of the article alone."""
    kind, own, gold = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (evaluation_type, source, gold_source))
    return (kind != "precision_only") & own.isin(ARTICLE_SOURCES) & (~gold.isin(EXTERNAL_SOURCES) | (own == "article"))


def match_kind(field_id: Column, want: Column, value: Column) -> tuple[Column, Column]:
    """exact, fuzzy, field_normalized or other, and the form in which values are told apart."""
    a, b = F.lower(T.collapse_spaces(want)), F.lower(T.collapse_spaces(value))
    na, nb = F.lower(field_normal(field_id, want)), F.lower(field_normal(field_id, value))
    return F.when(a == b, "exact").when(F.coalesce(T.fuzzy_match(want, value), F.lit(False)), "fuzzy").when((na != "") & (na == nb), "field_normalized").otherwise("other"), b


def compare_fields(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """Graded match of each expected (entry, field_id, value) with extracted (entry, field_id, pos, value, status).

    match_type is exact, fuzzy, field_normalized, wrong_value or missing; extracted_value is the first exact value, else
    the first that matches, else the first found; extra_values are distinct other values found, in order of pos.
    Expected rows that repeat are compared once each: they should be told apart by a column of their own.
    """
    found = extracted.filter("status = 'found'").select("entry", "field_id", "pos", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("_x"))
    want = F.coalesce(F.col("value").cast("string"), F.lit(""))
    j = expected.join(found, ["entry", "field_id"], "left")
    kind, b = match_kind(F.col("field_id"), want, F.col("_x"))
    j = j.withColumn("_kind", F.when(F.col("_x").isNotNull(), kind)).withColumn("_norm", b)
    hit = F.col("_kind").isin("exact", "fuzzy", "field_normalized")
    best = F.min(F.when(hit, F.struct(F.when(F.col("_kind") == "exact", 0).otherwise(1).alias("tier"), "pos", "_kind", "_x")))
    first = F.min(F.when(F.col("_x").isNotNull(), F.struct("pos", "_x")))
    extra = F.array_sort(F.collect_set(F.when(F.col("_kind") == "other", F.struct("pos", "_norm", "_x"))))
    g = j.groupBy(*expected.columns).agg(best.alias("_best"), first.alias("_first"), extra.alias("_extra"))
    norms = F.col("_extra")["_norm"]
    once = F.filter("_extra", lambda r, i: F.array_position(norms, r["_norm"]) == i + 1)
    match = F.coalesce(F.col("_best._kind"), F.when(F.col("_first").isNotNull(), "wrong_value").otherwise("missing"))
    extra_values = F.when(F.col("_best").isNotNull(), once["_x"]).otherwise(F.array().cast("array<string>"))
    return g.select(*expected.columns, match.alias("match_type"), F.coalesce("_best._x", "_first._x").alias("extracted_value"), extra_values.alias("extra_values"))


def compare_standardization(expected: DataFrame, bound: DataFrame) -> DataFrame:
    """(entry, entity_type, expected_id) against bound entities (entry, entity_type, pos, external_id, status): matched,
    actual_id and status of the expected one, else of the first; not_found if there is none."""
    j = expected.join(bound, ["entry", "entity_type"], "left")
    order = F.struct((F.col("external_id") != F.col("expected_id")).alias("other"), "pos", "external_id", "status")
    g = j.groupBy("entry", "entity_type", "expected_id").agg(F.min(F.when(F.col("pos").isNotNull(), order)).alias("b"))
    return g.select("entry", "entity_type", "expected_id", F.coalesce(F.col("b.external_id") == F.col("expected_id"), F.lit(False)).alias("matched"), F.col("b.external_id").alias("actual_id"), F.when(F.col("b").isNull(), "not_found").otherwise(F.col("b.status")).alias("status"))


#: Upper bounds: which fields an oracle may choose for; None stands for all, () for none.
ORACLES: dict[str, tuple[str, ...] | None] = {"oracle_best_dual_candidate": None, "oracle_relationship_only": (RELATIONSHIP_FIELD,), "oracle_disease_only": (DISEASE_FIELD,), "oracle_no_over_extractions": ()}


def _judged(candidates: DataFrame, **picks: Column) -> DataFrame:
    """(entry, field_id, _expected, picks) of candidates (entry, field_id, pos, value, status, want, ...), where want is the
    expected value of the field, null if none is expected.

    A pick is the least of its structs among found candidates; ``_fits`` and ``_kind`` tell how a value matches.  Only
    picks are shuffled, one row for each field of an entry if candidates are dealt by entry.
    """
    want, value = F.coalesce(F.col("want"), F.lit("")), F.coalesce(F.col("value").cast("string"), F.lit(""))
    rows = candidates.withColumn("_fits", F.coalesce(T.fuzzy_match(F.col("want"), F.col("value")), F.lit(False))).withColumn("_kind", match_kind(F.col("field_id"), want, value)[0])
    least = [F.min(F.when(F.col("status") == "found", c)).alias(n) for n, c in picks.items()]
    return rows.groupBy("entry", "field_id").agg(F.max(F.col("want").isNotNull()).alias("_expected"), *least)


def oracle_scores(candidates: DataFrame) -> DataFrame:
    """:func:`strategy_scores` of each oracle of ORACLES over candidates (entry, field_id, pos, value, status, want): the
    first found one, or for its fields the first that matches what is expected.  All but the last select for expected fields only.
    """
    row = lambda *c: F.struct(*c, "pos", "_kind")
    g = _judged(candidates, _fit=row((~F.col("_fits")).alias("miss")), _first=row())
    picks = {}
    for name, fields in ORACLES.items():
        free = F.lit(True) if fields is None else F.col("field_id").isin(*fields) if fields else F.lit(False)
        kind = F.when(free, F.col("_fit._kind")).otherwise(F.col("_first._kind"))
        picks[name] = kind if fields == () else F.when(F.col("_expected"), kind)
    return strategy_scores(g, picks)


#: Ablations: how the two tracks' candidates become one answer.
ABLATIONS = ("original_only", "translated_only", "first_found", "best_score")


def ablation_scores(candidates: DataFrame) -> DataFrame:
    """:func:`strategy_scores` of each strategy of ABLATIONS over candidates (entry, field_id, track, pos, value, status,
    score, want)."""
    original, score = F.when(F.col("track") == "original", 0).otherwise(1), F.col("score")
    row = lambda *c: F.struct(*c, "pos", "_kind")
    of = lambda t: F.when(F.col("track") == t, row())
    best = row(score.isNull().alias("none"), (-score).alias("score"), original.alias("track"))
    g = _judged(candidates, **dict(zip(ABLATIONS, (of("original"), of("translated"), row(original.alias("track")), best), strict=True)))
    return strategy_scores(g, {name: F.col(f"{name}._kind") for name in ABLATIONS})


def strategy_scores(fields: DataFrame, picks: dict[str, Column]) -> DataFrame:
    """tp, fp, fn and precision, recall, f1 of each strategy over fields (_expected, ...): a strategy's pick is how its one
    value matches, null if it has none.  Strategies without any value have no row.
    """
    counts = []
    for name, kind in picks.items():
        given, hit = F.col("_expected") & kind.isNotNull(), kind.isin("exact", "fuzzy", "field_normalized")
        counts += [F.count(kind), F.count_if(given & hit), F.count_if(given & ~hit), F.count_if(F.col("_expected") & kind.isNull())]
    sums = fields.agg(*(c.alias(f"_{i}") for i, c in enumerate(counts)))
    rows = [F.struct(F.lit(name).alias("strategy"), *(F.col(f"_{4 * i + k}").alias(n) for k, n in enumerate(("n", "tp", "fp", "fn")))) for i, name in enumerate(picks)]
    return E.prf1(sums.select(F.explode(F.array(*rows)).alias("s")).select("s.*").filter("n > 0").drop("n"))


def paired_report(df: DataFrame, reference: Column, compared: Column, reference_ok: Column, compared_ok: Column) -> DataFrame:
    """One row: McNemar's counts of successes, the paired t statistics and the signed ranks of the differences of scores."""
    delta = compared - reference
    m = E.mcnemar(df, reference_ok, compared_ok).select("b", "c", "chi2", "p_exact")
    return m.crossJoin(E.paired_t(df, delta).select("n", "mean", "sd", "t", "low", "high")).crossJoin(E.signed_rank(df, delta).select("w_plus", "w_minus"))


def attach_rerank(nearest: DataFrame, reranked: DataFrame, key: str) -> DataFrame:
    """Nearest candidates (key, index, ...) with the scores (key, index, score) of a reranker, best first by ``rank``.

    Scores of no candidate are dropped, and so are candidates without a score.  Ties keep the order of index.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "index")
    return nearest.join(reranked, [key, "index"]).withColumn("rank", F.row_number().over(order))


def variant_slug(gene: Column, variant: Column, disease: Column, unknown: str = "unknown") -> Column:
    """gene:variant, with the disease behind it if there is one."""
    given = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(":", F.coalesce(given(gene), F.lit(unknown)), F.coalesce(given(variant), F.lit(unknown)), given(disease))


def search_text(*parts: Column) -> Column:
    """Texts joined, white space collapsed, lower-cased; null and empty ones are left out."""
    return F.lower(T.collapse_spaces(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))))


def summary_fields(items: DataFrame, by: Sequence[str], groups: dict[str, Sequence[str]], pos: str = "pos") -> DataFrame:
    """For each group of fields the first value that is not empty, in order of pos."""
    value = F.nullif(F.trim(F.col("value").cast("string")), F.lit(""))
    aggs = [F.min(F.when(F.col("field_id").isin(*fields) & value.isNotNull(), F.struct(F.col(pos), value.alias("v"))))["v"].alias(name) for name, fields in groups.items()]
    return items.groupBy(*by).agg(*aggs)


def highlight(text: Column, start: Column, end: Column, value: Column) -> Column:
    """struct(start, end) of what to mark in a snippet: its offsets clamped to it, or where the value stands if they miss it.

    Offsets that are no whole numbers miss it; an end before the start means the snippet's end.  Null for an empty snippet.
    """
    n = F.length(text)
    a, b = start.try_cast("int"), end.try_cast("int")
    valid = (start.isNull() | a.isNotNull()) & (end.isNull() | b.isNotNull())
    a, b = F.coalesce(a, F.lit(0)), F.coalesce(b, n)
    b = F.when(b < a, n).otherwise(b)
    found = T.value_anchor(text, value)
    low = F.greatest(a, F.lit(0))
    inside = F.struct(low.alias("start"), F.least(F.greatest(b, low), n).alias("end"))
    anchored = F.struct(F.coalesce(found["start"], F.lit(0)).alias("start"), F.coalesce(found["end"], F.lit(0)).alias("end"))
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.when(valid & (a < n), inside).otherwise(anchored))


def candidate_features(df: DataFrame) -> DataFrame:
    """A learned arbiter's features of scored candidates (field_id, track, status, precision, start, end, source_score,
    confidence_score, agreement_score, verifier_support, target_specificity, contradiction); a null precision is no source."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    span = F.when((F.col("start") >= 0) & (F.col("end") > F.col("start")), F.least((F.col("end") - F.col("start")) / 500.0, F.lit(1.0))).otherwise(0.0)
    calm = 1.0 - F.least(F.col("contradiction"), F.lit(1.0))
    return df.select(
        "*", flag(F.col("precision").isNotNull()).alias("has_source"), flag(F.col("precision") == "exact").alias("source_is_exact"), flag(F.col("precision") == "corrected").alias("source_is_corrected"),
        F.when(F.col("precision").isNull(), 0.0).otherwise(span).alias("span_length"), flag(F.col("status") == "found").alias("status_is_found"), flag(F.col("status") == "not_found").alias("status_is_not_found"),
        calm.alias("no_contradiction"), flag(F.col("field_id") == GENE_FIELD).alias("field_is_gene"), flag(F.col("field_id") == DISEASE_FIELD).alias("field_is_disease"),
        flag(F.col("field_id") == RELATIONSHIP_FIELD).alias("field_is_relationship"), flag(F.col("track") == "original").alias("track_is_original"),
        (F.col("source_score") * F.col("agreement_score")).alias("source_x_agreement"), (F.col("verifier_support") * calm).alias("verifier_x_no_contradiction"),
        (F.col("target_specificity") * F.col("verifier_support")).alias("target_x_verifier"), (F.col("source_score") * F.col("verifier_support")).alias("source_x_verifier"),
    )


def labelled_candidates(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Features of candidates whose (entry, field_id) has a gold value, with label 1 where normalized_value equals it."""
    j = candidates.join(gold.select("entry", "field_id", F.col("normalized_value").alias("_gold")), ["entry", "field_id"])
    return candidate_features(j.withColumn("label", (F.col("normalized_value") == F.col("_gold")).cast("int")).drop("_gold"))


def error_summary(rows: DataFrame, dimensions: Sequence[str], exploded: str) -> DataFrame:
    """(dimension, value, n): counts of rows by each dimension, null as ``none``, and of the items of an array column."""
    one = [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("none")).alias("value")) for d in dimensions]
    many = F.transform(F.coalesce(exploded, F.array().cast("array<string>")), lambda x: F.struct(F.lit(exploded).alias("dimension"), x.alias("value")))
    return rows.select(F.explode(F.concat(F.array(*one), many)).alias("r")).groupBy("r.dimension", "r.value").agg(F.count("*").alias("n"))


def card_field(field_id: Column) -> Column:
    """The column of an evidence card that shows a field; null for fields that no card shows."""
    named = {GENE_FIELD: "gene", DISEASE_FIELD: "disease", "B.clinical_diagnosis": "disease", "J.authority_classification": "classification"}
    found = F.coalesce(*(F.when(field_id == k, v) for k, v in named.items()))
    return F.when(F.startswith(field_id, F.lit("A.variant_hgvs_")) | (field_id == "A.variant_legacy_name"), "variant").otherwise(found)


def scope_bindings(gene: Column, disease: Column, protein: Column, entry: Column) -> Column:
    """array<struct<role, id>> of an extraction target: gene and disease in their lookup forms, then what else is given."""
    pair = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("id"))
    always = F.array(pair("target_gene", F.upper(T.lookup_text(F.coalesce(gene, F.lit(""))))), pair("target_disease", T.lookup_text(F.coalesce(disease, F.lit("")))))
    given = F.array(*(F.when(F.coalesce(c, F.lit("")) != "", pair(role, c)) for role, c in (("target_variant_p", protein), ("target_clingen_entry", entry))))
    return F.concat(always, F.array_compact(given))


def maps_to_source(source: Column, predicted: Column, start: Column, end: Column) -> Column:
    """Whether a predicted text stands in its span of the source, anywhere in it, or as a sequence of its words.

    White space and case do not count; in the last comparison neither do articles nor what is no letter or digit.
    """
    plain = lambda c: T.collapse_spaces(F.lower(F.coalesce(c, F.lit(""))))
    words = lambda c: F.regexp_extract_all(plain(c), F.lit("([a-z0-9]+)"), F.lit(1))
    line = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    bare = lambda c: F.filter(words(c), lambda w: ~w.isin("a", "an", "the"))
    given = (plain(predicted) != "") & (plain(source) != "")
    inside = (start >= 0) & (end > start) & (end <= F.length(source)) & F.contains(plain(F.substring(source, start + 1, end - start)), plain(predicted))
    sequence = (F.size(words(predicted)) > 0) & F.contains(line(words(source)), line(words(predicted)))
    without = (F.size(bare(predicted)) > 0) & F.contains(line(bare(source)), line(bare(predicted)))
    return F.coalesce(given & (F.coalesce(inside, F.lit(False)) | F.contains(plain(source), plain(predicted)) | sequence | without), F.lit(False))


def native_gain(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What a second track adds: distinct (field_id, value) of found items on both tracks, on the original only, on the
    translated only, and documents in which the translated one adds any; in total or by group."""
    keys = items.filter("status = 'found'").select(*by, "document_id", "field_id", F.lower(F.trim("value")).alias("v"), "track").filter("v <> '' AND field_id <> ''")
    one = keys.groupBy(*by, "document_id", "field_id", "v").agg(F.bool_or(F.col("track") == "original").alias("o"), F.bool_or(F.col("track") == "translated").alias("t"))
    aggs = [F.count_if(F.col("o") & F.col("t")).alias("shared"), F.count_if(F.col("o") & ~F.col("t")).alias("original_only"), F.count_if(~F.col("o") & F.col("t")).alias("translated_only"), F.count_distinct(F.when(~F.col("o") & F.col("t"), F.col("document_id"))).alias("documents_gained")]
    return one.groupBy(*by).agg(*aggs) if by else one.agg(*aggs)


def baseline_table(baselines: DataFrame, traceability: DataFrame, f1: float, traceable_f1: float) -> DataFrame:
    """Baselines (id, f1) beside their traceability (id, traceable_f1), if there is any, and a candidate's gains over both."""
    j = baselines.join(traceability, "id", "left")
    return j.select("id", "f1", "traceable_f1", F.round(F.lit(f1) - F.col("f1"), 6).alias("f1_gain"), F.round(F.lit(traceable_f1) - F.col("traceable_f1"), 6).alias("traceable_f1_gain"))
