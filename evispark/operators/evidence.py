"""Evidence operators: gates, grouping, chains, grounding, scoring, alignment and reconciliation of two tracks.

Items are rows: document, group_id, field_id (``<Category>.<name>``), value, status, confidence, block, snippet, track and a
position ``pos`` that gives their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .relational import reasons, top_one

#: Fields that must bind a gene, a variant, a disease; identity fields pass a weaker gate.
GENE_FIELD, VARIANT_FIELDS, DISEASE_FIELD = "A.gene_symbol", ("A.variant_hgvs_c", "A.variant_hgvs_p"), "B.disease_diagnosis"
ACCEPTED_STATUSES, REJECTED_REVIEWS = ("found",), ("rejected",)


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def ready_gate(df: DataFrame) -> DataFrame:
    """Every candidate with its reject reasons; it is accepted if there is none."""
    field = F.trim("field_id")
    why = reasons(
        {
            "missing_source_document_id": blank(F.col("document_id")),
            "missing_processing_run_id": blank(F.col("run_id")),
            "missing_field_id": blank(F.col("field_id")),
            "missing_group_id": blank(F.col("group_id")),
            "unsupported_status": ~F.lower(F.trim(F.coalesce("status", F.lit("")))).isin(*ACCEPTED_STATUSES),
            "review_rejected": F.lower(F.trim(F.coalesce("review_status", F.lit("")))).isin(*REJECTED_REVIEWS),
            "missing_source_support": blank(F.col("snippet")),
            "missing_entity_binding": blank(F.col("gene_id")) & blank(F.col("variant_id")) & blank(F.col("disease_id")),
            "missing_gene_binding": (field == GENE_FIELD) & blank(F.col("gene_id")),
            "missing_variant_binding": field.isin(*VARIANT_FIELDS) & blank(F.col("variant_id")),
            "missing_disease_binding": (field == DISEASE_FIELD) & blank(F.col("disease_id")),
        }
    )
    return df.withColumn("reasons", why).withColumn("accepted", F.size("reasons") == 0)


def gate_report(gated: DataFrame) -> DataFrame:
    """(reason, n) of a gated table, with accepted and rejected as rows of their own."""
    by = gated.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    total = gated.groupBy(F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("reason")).agg(F.count("*").alias("n"))
    return by.unionByName(total)


def gated_items(items: DataFrame, identity_fields: Sequence[str]) -> DataFrame:
    """Items of complete groups, and identity fields of groups that only have a gene or a disease."""
    found = F.col("status") == "found"
    has = lambda *f: F.bool_or(found & F.col("field_id").isin(*f))
    groups = items.groupBy("document_id", "group_id").agg((has(GENE_FIELD) & has(*VARIANT_FIELDS)).alias("full"), (has(GENE_FIELD) | has(DISEASE_FIELD) | F.bool_or(T.from_group_id(F.col("group_id"), "gene").isNotNull())).alias("part"))
    j = items.join(groups, ["document_id", "group_id"])
    return j.filter(F.col("full") | (F.col("part") & F.col("field_id").isin(*identity_fields))).drop("full", "part")


def chains(items: DataFrame) -> DataFrame:
    """One chain a group: its first gene, disease and variant, their completeness, and its sorted fields."""
    first = lambda *f: F.min_by(F.when(F.col("field_id").isin(*f), F.col("value")), F.when(F.col("field_id").isin(*f) & (F.col("status") == "found"), F.col("pos")))
    g = items.groupBy("document_id", "group_id").agg(first(GENE_FIELD).alias("gene"), first(DISEASE_FIELD).alias("disease"), first(*VARIANT_FIELDS).alias("variant"), F.array_sort(F.collect_set(F.when(F.col("status") == "found", F.col("field_id")))).alias("fields"))
    n = sum((F.col(c).isNotNull().cast("int") for c in ("gene", "disease", "variant")), F.lit(0))
    return g.withColumn("level", F.when(n == 3, "full").when(n == 2, "partial").when(n == 1, "singleton").otherwise("empty"))


def contradictions(items: DataFrame) -> DataFrame:
    """Fields of a group with more than one found value."""
    found = items.filter("status = 'found'").groupBy("document_id", "group_id", "field_id").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return found.filter(F.size("values") > 1)


def first_chains(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Chains of both tracks, the original's first, distinct by normal forms of document, gene, disease and variant."""
    both = original.withColumn("_t", F.lit(0)).unionByName(translated.withColumn("_t", F.lit(1)))
    keys = [F.coalesce(F.lower(F.trim(c)), F.lit("")).alias(f"_{c}") for c in ("gene", "disease", "variant")]
    keyed = both.select("*", *keys)
    return top_one(keyed, ["document_id", "_gene", "_disease", "_variant"], [F.asc("_t"), F.asc("group_id")]).drop("_t", "_gene", "_disease", "_variant")


def ground(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Each item with its grounding in the document's text (document_id, text).

    ``exact``: the given offsets hold the snippet; ``corrected``: it occurs once elsewhere; ``ambiguous``: several times;
    ``ellipsis``: its fragments occur in order; ``missing``: none of these, or no snippet.
    """
    j = items.join(documents.select("document_id", "text"), "document_id", "left")
    at = F.position(F.col("snippet"), F.col("text"))
    n = F.floor((F.length("text") - F.length(F.replace("text", F.col("snippet"), F.lit("")))) / F.greatest(F.length("snippet"), F.lit(1)))
    given = F.substring(F.col("text"), F.col("start") + 1, F.length("snippet")) == F.col("snippet")
    label = F.when(blank(F.col("snippet")) | F.col("text").isNull(), "missing").when(F.coalesce(given, F.lit(False)), "exact").when(n == 1, "corrected").when(n > 1, "ambiguous").when(F.rlike("snippet", F.lit(r"\.{3}|…")) & T.fragments_in_order(F.col("snippet"), F.col("text")), "ellipsis").otherwise("missing")
    out = j.withColumn("grounding", label)
    start = F.when(F.col("grounding") == "exact", F.col("start")).when(F.col("grounding") == "corrected", at - 1)
    return out.withColumn("start", start.cast("int")).withColumn("end", (F.col("start") + F.length("snippet")).cast("int")).drop("text")


def transition(grounding: Column, status: Column, table: Column) -> Column:
    """Status of an item after grounding: found items without support become table_ungrounded in tables, else source_invalid."""
    return F.when((status == "found") & (grounding == "missing"), F.when(table, "table_ungrounded").otherwise("source_invalid")).otherwise(status)


#: Cue words of each kind of support, and diseases whose names show that a text is about others.
CUES = {
    "causal": ("cause", "causal", "disease-causing", "pathogenic variant", "biallelic", "loss-of-function", "deficiency"),
    "direct": ("associated", "association", "linked", "linkage"),
    "susceptibility": ("risk", "susceptibility", "susceptible", "predispos"),
    "hedged": (
        "suggest", "may contribute", "may be involved", "may play a role", "may be due", "might be due", "could be due", "could contribute", "appears", "implies", "implicated", "central to", "pathogenesis", "mediating",
        "involved in", "likely", "possibly", "possible", "predicted", "indicate", "unclear", "incidental finding", "pathogenic link", "preliminary",
    ),
    "refute": ("no evidence", "not associated", "refute", "conflicting"),
    "disputed": ("disputed", "conflict", "unresolved", "controversial", "predicted", "computational prediction", "bioinformatic prediction"),
}
OTHER_DISEASES = ("influenza", "rsv", "covid-19", "crohn", "bacterial infection", "viral infection")
#: Labels of a relationship.
LABELS = ("causative", "susceptibility", "uncertain", "disputed", "refuted", "unknown")


def cue(text: Column, kind: str) -> Column:
    """Whether a text in lower case holds a cue of a kind."""
    out = F.lit(False)
    for word in CUES[kind]:
        out = out | F.contains(text, F.lit(word))
    return out


def support(items: DataFrame) -> DataFrame:
    """Deterministic support of items (snippet, target_gene, disease_alias, and field_id and value if known): scores, label
    and whether to review.

    Score = 0.65 x specificity + the strongest cue's weight - what a list of other diseases costs, between 0 and 1.
    Specificity is 1 if both gene and disease are named and 0.55 for one of them; without its disease a diagnosis has none.
    A text that ties a variant of the gene to the disease, without hedging or doubt, counts as causal.
    """
    clean = lambda c: T.collapse_spaces(F.lower(F.coalesce(c, F.lit(""))))
    given = lambda name: F.col(name) if name in items.columns else F.lit("")
    low, target, alias = clean(F.col("snippet")), clean(F.col("target_gene")), clean(F.col("disease_alias"))
    gene, disease = (target != "") & F.contains(low, target), (alias != "") & F.contains(low, alias)
    c = {k: cue(low, k) for k in CUES}
    # Words before the gene's name tell whether it is a variant of this gene; the name itself is compared, not matched.
    of_gene = F.exists(F.split(low, r"\bvariants?\s+(?:in|of)\s+(?:the\s+)?"), lambda x: F.startswith(x, target) & ~F.rlike(F.substring(x, F.length(target) + 1, F.lit(1)), F.lit(r"(?U)\w")))
    later = F.size(F.split(low, r"\bvariants?\s+(?:in|of)\s+(?:the\s+)?")) > 1
    mendelian = c["direct"] & ~c["hedged"] & ~c["refute"] & ~c["disputed"] & gene & disease & later & of_gene
    causal = c["causal"] | mendelian
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in OTHER_DISEASES), F.lit(0))
    cost = F.when(disease | (hits == 0), 0.0).when(hits >= 3, 0.35).otherwise(0.15)
    doubt = c["disputed"] & ~c["refute"]
    weight = F.when(doubt, 0.15).when(c["refute"], 0.0).when(causal, 0.45).when(c["susceptibility"] | c["direct"], 0.25).when(c["hedged"], 0.20).otherwise(0.0)
    own = F.replace(clean(given("value")), F.lit(" "), F.lit("_"))
    label = F.when(doubt, "disputed").when(c["refute"], "refuted").when(causal, "causative").when(c["susceptibility"], "susceptibility").when(c["hedged"] | c["direct"], "uncertain").when(own.isin(*LABELS), own).otherwise("uncertain")
    spec = F.when((given("field_id") == DISEASE_FIELD) & ~disease, 0.0).when(gene & disease, 1.0).when(gene | disease, 0.55).otherwise(0.0)
    out = items.withColumn("specificity", spec).withColumn("support", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(0.65 * spec + weight - cost, 4))))
    out = out.withColumn("contradiction", F.when(c["refute"] & ~c["disputed"], 0.8).otherwise(0.0)).withColumn("label", label)
    return out.withColumn("review", (F.col("contradiction") >= 0.7) | (F.col("specificity") < 0.5) | (F.col("support") < 0.6))


def candidate_score(items: DataFrame) -> DataFrame:
    """score = 0.45 source + 0.30 confidence + 0.15 agreement with the other track + 0.10 status."""
    w = Window.partitionBy("document_id", "field_id", "value")
    agree = (F.size(F.collect_set("track").over(w)) > 1).cast("int")
    source = F.when(~blank(F.col("snippet")), 1.0).otherwise(0.0)
    return items.withColumn("score", F.round(0.45 * source + 0.30 * F.coalesce("confidence", F.lit(0.0)) + 0.15 * agree + 0.10 * (F.col("status") == "found").cast("int"), 12))


def decide_fields(scored: DataFrame, margin: float = 0.1) -> DataFrame:
    """Per field the best candidate, the first lower one with another value, and whether they are too close."""
    w = Window.partitionBy("document_id", "field_id").orderBy(F.desc("score"), "value", "track")
    r = scored.withColumn("_r", F.row_number().over(w)).withColumn("_best", F.first("value").over(w))
    other = F.min(F.when(~F.col("value").eqNullSafe(F.col("_best")), F.struct("_r", "value", "score")))
    g = r.groupBy("document_id", "field_id").agg(F.min_by(F.struct("value", "track", "score"), "_r").alias("b"), other.alias("o"))
    close = F.coalesce(F.col("b.score") - F.col("o.score") < margin, F.lit(False))
    return g.select("document_id", "field_id", F.col("b.value").alias("value"), F.col("b.track").alias("track"), F.col("b.score").alias("score"), F.col("o.value").alias("conflicting_value"), close.alias("review"))


def alignment(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Best item per (document, field) of two tracks side by side with the alignment of their values.

    In order: missing, aligned, drifted (a negation or a number changed), partial, conflict.
    """
    best = lambda df, n: top_one(df, ["document_id", "field_id"], [F.desc("confidence"), F.asc("value"), F.asc("pos")]).select("document_id", "field_id", F.col("value").alias(n))
    j = best(original, "original").join(best(translated, "translated"), ["document_id", "field_id"], "full_outer")
    a, b = F.lower(F.trim("original")), F.lower(F.trim("translated"))
    label = (
        F.when(blank(F.col("original")) | blank(F.col("translated")), "missing").when(a == b, "aligned")
        .when(T.negated(a) != T.negated(b), "drifted").when(T.numeric_drift(a, b), "drifted").when(T.partial_match(a, b), "partial").otherwise("conflict")
    )
    return j.withColumn("alignment", label)


def project_span(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans (document_id, item, start, end) onto the other track by the narrowest chunk (c_start, c_end, o_start) that holds them."""
    j = spans.join(chunks, "document_id").filter((F.col("c_start") <= F.col("start")) & (F.col("end") <= F.col("c_end")))
    best = top_one(j, ["document_id", "item"], [F.asc(F.col("c_end") - F.col("c_start")), F.asc("c_start")])
    moved = F.col("o_start") + F.col("start") - F.col("c_start")
    return best.select("document_id", "item", moved.alias("o_from"), (moved + F.col("end") - F.col("start")).alias("o_to"))


def nearest_group(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """Items (document_id, item, block) with the group whose anchor block is nearest; complete groups, then ids, break ties.

    Anchors are few in a document: one row for each (document_id, group_id, block).
    """
    complete = ~F.contains("group_id", F.lit("__missing__"))
    j = items.join(anchors.select("document_id", "group_id", F.col("block").alias("a_block")).distinct(), "document_id")
    return top_one(j, ["document_id", "item"], [F.asc(F.abs(F.col("block") - F.col("a_block"))), F.desc(complete), F.asc("group_id")]).select("document_id", "item", "group_id")


def block_scores(blocks: DataFrame, gene: str, diseases: Sequence[str]) -> DataFrame:
    """Recall score of blocks (document_id, block, text, type) for a target; blocks without any cue are dropped."""
    c, low = F.col("text"), F.lower("text")
    named = F.lit(False)
    for d in diseases:
        named = named | F.contains(low, F.lit(d.lower()))
    score = (
        6.0 * F.rlike(c, F.lit(rf"(?<![A-Za-z0-9]){gene}(?![A-Za-z0-9])")).cast("int") + 5.0 * named.cast("int")
        + 2.0 * (cue(c, "causal") | cue(c, "direct")).cast("int") + 1.5 * F.rlike(c, F.lit(r"[cp]\.[A-Za-z0-9*_>]+|(?i)variant|mutation")).cast("int")
        + 1.25 * F.col("type").isin("table", "image").cast("int") + 0.75 * F.rlike(low, F.lit(r"^(results|case|patients|methods)\b")).cast("int")
    )
    return blocks.withColumn("score", F.round(score, 4)).filter("score > 0")


def select_blocks(blocks: DataFrame, scored: DataFrame, required: float = 5.0, most: int = 12) -> DataFrame:
    """Blocks that name the target with their neighbours first, then by score; at most ``most`` of a document."""
    target = scored.filter(F.col("score") >= required)
    near = target.select("document_id", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block")).distinct().withColumn("near", F.lit(True))
    j = blocks.select("document_id", "block").join(scored.select("document_id", "block", "score"), ["document_id", "block"], "left").join(near, ["document_id", "block"], "left")
    w = Window.partitionBy("document_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0)) >= required), F.desc(F.coalesce("near", F.lit(False))), F.desc(F.coalesce("score", F.lit(0.0))), "block")
    return j.filter("score IS NOT NULL OR near").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).select("document_id", "block")


def merge_maps(maps: DataFrame, lists: Sequence[str]) -> DataFrame:
    """Chunk maps (document_id, pos, relevant, lists of names) merged: relevant if any is; names once, whatever their case, in order."""
    out = maps.groupBy("document_id").agg(F.bool_or("relevant").alias("relevant"))
    for name in lists:
        flat = maps.select("document_id", "pos", F.posexplode(name).alias("i", "v")).filter(F.trim("v") != "")
        first = flat.groupBy("document_id", F.lower(F.trim("v")).alias("k")).agg(F.min(F.struct("pos", "i", "v")).alias("f"))
        merged = first.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["v"]).alias(name))
        out = out.join(merged, "document_id", "left")
    return out.select("document_id", "relevant", *(F.coalesce(F.col(n), F.array().cast("array<string>")).alias(n) for n in lists))


def merge_channels(chunks: DataFrame, concrete: Sequence[str]) -> DataFrame:
    """(document_id, channels, confidence, pos: the winning chunk) of chunk classifications (document_id, pos, channels, confidence).

    Chunks with a concrete channel win over others, then the highest confidence (null: lowest), then the first.  Channels are
    the winner's; where several chunks are given and one is concrete, those of all concrete chunks, once each, in order.
    """
    has = F.coalesce(F.arrays_overlap("channels", F.array(*(F.lit(c) for c in concrete))), F.lit(False))
    marked = chunks.withColumn("_c", has)
    # Both parts are pre-aggregated where rows stand; a document has as many channels at last as there are kinds.
    won = F.max_by(F.struct("channels", "confidence", "pos"), F.struct("_c", "confidence", (-F.col("pos")).alias("p")))
    winner = marked.groupBy("document_id").agg(won.alias("w"), F.count("*").alias("n"))
    each = marked.filter("_c").select("document_id", "pos", F.posexplode("channels").alias("i", "channel")).groupBy("document_id", "channel").agg(F.min(F.struct("pos", "i")).alias("at"))
    union = each.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "channel"))), lambda s: s["channel"]).alias("joined"))
    channels = F.when(F.col("n") > 1, F.coalesce("joined", "w.channels")).otherwise(F.col("w.channels"))
    return winner.join(union, "document_id", "left").select("document_id", channels.alias("channels"), "w.confidence", "w.pos")


def root_cause(matched: Column, candidates: Column, valid: Column, extra: Column, field: Column) -> Column:
    """Why a field failed, by rules in order."""
    return (
        F.when(candidates == 0, "candidate_absent").when(valid == 0, "source_invalid_or_unscorable")
        .when((field == "C.relationship") & ~matched, "wrong_relationship_semantics").when((field == DISEASE_FIELD) & (~matched | (extra > 0)), "disease_boundary_error")
        .when(extra > 0, "non_target_contamination").when(~matched, "score_ranking_error").otherwise("evaluation_normalization_gap")
    )


def rank_candidates(df: DataFrame, expected_title: str, provider: str) -> DataFrame:
    """Search results (title, provider, doi, year, pos): exact title, relevance, provider, a doi, recency, then order."""
    y = F.when(F.col("year") >= 2000, F.least("year", F.lit(2026))).otherwise(0)
    return df.orderBy(
        F.desc(F.coalesce(T.title_key(F.col("title")) == T.title_key(F.lit(expected_title)), F.lit(False))),
        F.desc(F.round(T.lexical_relevance(F.lit(expected_title), F.col("title")), 4)),
        F.desc(F.coalesce(F.lower(F.trim("provider")) == provider.lower(), F.lit(False))), F.desc(~blank(F.col("doi"))), F.desc(F.coalesce(y, F.lit(0))), F.asc("pos"),
    )


def literature_graph(chains_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of chains: typed entity nodes, and gene-disease and variant-disease edges with their counts."""
    node = F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(k).alias("name")) for k in ("gene", "variant", "disease")))).alias("n")
    named = chains_.select(node).filter("n.name IS NOT NULL").select(F.concat_ws(":", "n.label", F.lower("n.name")).alias("node_id"), "n.label", "n.name")
    nodes = named.groupBy("node_id", "label").agg(F.min("name").alias("display_name"))
    at = lambda k: F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.lower(F.col(k))))
    edge = F.explode(F.array(F.struct(at("gene").alias("src"), at("disease").alias("dst"), F.lit("ASSOCIATED_WITH").alias("rel_type")), F.struct(at("variant").alias("src"), at("disease").alias("dst"), F.lit("OBSERVED_IN").alias("rel_type")))).alias("e")
    edges = chains_.select(edge).select("e.*").filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst", "rel_type").agg(F.count("*").alias("evidence_count"))
    return nodes, edges


def quality_report(items: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per document: items by status, found ones without source, missing required fields, whether it passes and can be scored."""
    s = F.col("status")
    n = items.groupBy("document_id").agg(
        *(F.count_if(s == k).alias(k) for k in ("found", "not_found", "source_invalid", "ocr_gap", "table_ungrounded")),
        F.count_if((s == "found") & blank(F.col("snippet"))).alias("missing_source"),
        F.array_sort(F.array_except(F.array(*(F.lit(r) for r in required)), F.collect_set(F.when(s == "found", F.col("field_id"))))).alias("missing_required"),
    )
    review = F.col("source_invalid") + F.col("ocr_gap") + F.col("table_ungrounded") > 0
    return n.withColumn("review", review).withColumn("passed", (F.col("missing_source") == 0) & (F.size("missing_required") == 0)).withColumn("scorable", F.col("found") > 0)


def missing_fields(expected: DataFrame, found: DataFrame, sources: DataFrame) -> DataFrame:
    """Expected facts (document_id, field_id, value) that were not found, with what the source (document_id, text) shows of them."""
    gone = expected.join(found.select("document_id", "field_id").distinct(), ["document_id", "field_id"], "left_anti")
    j = gone.join(sources, "document_id", "left")
    shown = F.coalesce(F.contains(F.lower("text"), F.lower("value")), F.lit(False))
    cue_ = F.coalesce(cue(F.col("text"), "causal") | cue(F.col("text"), "direct"), F.lit(False))
    why = F.when(F.col("text").isNull(), "no_source").when(shown, "span_selected_but_field_missing").when(cue_, "normalization_gap").otherwise("span_not_selected")
    return j.select("document_id", "field_id", "value", why.alias("cause"))
