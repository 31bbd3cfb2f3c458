"""Alias packs of targets, all their places in texts by a multi-pattern automaton, and what texts say about a target.

The automaton reads a text once, however many aliases there are.  Aliases up to ``shard_bytes`` are broadcast, a checked
size; more are dealt into shards of that size, and each shard meets each slice of the documents in a task of its own, which
builds the shard's automaton before it reads texts.  No alias table passes the driver beyond one shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import collapse_spaces
from ..sources.scratch import stored
from . import item_rules as IR

SHARD_BYTES = 16 << 20
PLACES = "doc_id long, alias_id long, start long, stop long"


def disease_aliases(label: Column) -> Column:
    """array<string>: the label and the label without parentheses, as they stand and in lower case; no empty or repeated ones."""
    bare = F.regexp_replace(label, r"\s*\([^)]*\)", "")
    forms = F.array(*(collapse_spaces(x) for x in (label, F.lower(label), bare, F.lower(bare))))
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))


def context_packs(targets: DataFrame) -> DataFrame:
    """targets (entry_id, gene_symbol, disease_label, ...) with gene (upper case), gene_aliases and disease_aliases."""
    gene = F.upper(F.trim(F.coalesce("gene_symbol", F.lit(""))))
    label = F.trim(F.coalesce("disease_label", F.lit("")))
    return targets.withColumn("gene", gene).withColumn("gene_aliases", F.filter(F.array(gene), lambda x: x != "")).withColumn("disease_aliases", disease_aliases(label))


def infer_gene(text: Column) -> Column:
    """The first word of capitals and digits; empty if there is none."""
    return F.coalesce(F.regexp_extract(text, r"\b([A-Z][A-Z0-9-]{1,})\b", 1), F.lit(""))


def lowered(text: str) -> str:
    """Lower case, character by character, so that offsets stay."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def automaton(aliases: list[tuple[int, str]]) -> ahocorasick.Automaton:
    ids: dict[str, list[int]] = {}
    for alias_id, alias in aliases:
        ids.setdefault(lowered(alias), []).append(alias_id)
    found = ahocorasick.Automaton()
    for alias, own in ids.items():
        found.add_word(alias, (len(alias), own))
    found.make_automaton()
    return found


def places(found: ahocorasick.Automaton, text: str, whole_words: bool, overlapping: bool = True) -> Iterator[tuple[int, int, int]]:
    """(alias_id, start, stop) of every place, overlapping ones too; else, of places of one alias, none that overlaps one before it."""
    if not len(found):
        return
    low = lowered(text)
    past: dict[int, int] = {}
    for last, (n, ids) in found.iter(low):
        start, stop = last - n + 1, last + 1
        if not overlapping:
            if start < past.get(ids[0], 0):
                continue
            past[ids[0]] = stop
        if whole_words and ((start and low[start - 1].isalnum()) or (stop < len(low) and low[stop].isalnum())):
            continue
        for alias_id in ids:
            yield alias_id, start, stop


def meet(texts: DataFrame, words: DataFrame, build: Callable[[list[tuple[int, str]]], object], match: Callable[[object, int, str], Iterable[tuple]], schema: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows (schema) that ``match(build(words), id, text)`` gives for texts (id, text) and words (id, text).

    Words up to ``shard_bytes`` are broadcast; more are dealt into shards, and each of them meets each slice of the texts.
    """
    known = stored(words.filter("text IS NOT NULL AND text <> ''").select(F.col("id").cast("long").alias("id"), "text"))
    texts = texts.filter("text IS NOT NULL AND text <> ''").select(F.col("id").cast("long").alias("id"), "text")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    kinds = to_arrow_schema(texts.sparkSession.createDataFrame([], schema).schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    if size <= shard_bytes:
        shared = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in known.collect()])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = build(shared.value)
            for batch in batches:
                out = []
                for own, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    out += match(found, own, text)
                if out:
                    yield batch_of(out)

        return texts.mapInArrow(whole, schema)
    shards = -(-size // shard_bytes)
    slices = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each slice of the texts meets each shard: words come first.
    dealt_words = known.select(F.pmod(F.xxhash64("text"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), F.lit(0).alias("side"), "id", "text")
    read = texts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("id", "text"), F.lit(slices)).alias("slice"), F.lit(1).alias("side"), "id", "text")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words_, found, out = None, [], None, []
        for batch in batches:
            for shard, part, side, own, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "slice", "side", "id", "text")), strict=True):
                if at != (shard, part):
                    at, words_, found = (shard, part), [], None
                if side == 0:
                    words_.append((own, text))
                    continue
                if found is None:
                    found, words_ = build(words_), []
                out += match(found, own, text)
            if out:
                yield batch_of(out)
                out = []

    both = dealt_words.unionByName(read).repartition(int(shards * slices), "shard", "slice").sortWithinPartitions("shard", "slice", "side")
    return both.mapInArrow(dealt, schema)


def scan(docs: DataFrame, aliases: DataFrame, whole_words: bool = True, shard_bytes: int = SHARD_BYTES, overlapping: bool = True) -> DataFrame:
    """(doc_id, alias_id, start, stop): every place of every alias (alias_id, alias) in documents (doc_id, text), in characters.

    Case does not count.  Null or empty texts and aliases have no places.  Without ``overlapping`` a text is searched for each
    alias from left to right, and the search goes on behind a place that it found, whole words or not.
    """

    def match(found: ahocorasick.Automaton, doc_id: int, text: str) -> Iterator[tuple]:
        return ((doc_id, *p) for p in places(found, text, whole_words, overlapping))

    return meet(docs.select(F.col("doc_id").alias("id"), "text"), aliases.select(F.col("alias_id").alias("id"), F.col("alias").alias("text")), automaton, match, PLACES, shard_bytes)


def groups_named(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, group_id): the group (doc_id, group_id, gene, variant) whose tokens both stand in its document's text.

    A missing token is no condition.  Complete groups come before others, then the smaller id.
    """
    tokens = groups.select("doc_id", "group_id", F.explode(F.filter(F.array("gene", "variant"), lambda x: x.isNotNull() & (x != "__missing__") & (x != ""))).alias("alias")).distinct()
    words = stored(tokens.select("alias").distinct().withColumn("alias_id", F.xxhash64("alias")))
    squeezed = docs.select("doc_id", F.regexp_replace("text", r"\s+", "").alias("text"))
    seen = scan(squeezed, words, whole_words=False).select("doc_id", "alias_id").distinct()
    held = tokens.withColumn("alias_id", F.xxhash64("alias")).join(seen, ["doc_id", "alias_id"]).groupBy("doc_id", "group_id").agg(F.count("*").alias("held"))
    need = tokens.groupBy("doc_id", "group_id").agg(F.count("*").alias("need"))
    all_ = groups.select("doc_id", "group_id").distinct().join(need, ["doc_id", "group_id"], "left").join(held, ["doc_id", "group_id"], "left")
    fits = all_.filter(F.coalesce("held", F.lit(0)) == F.coalesce("need", F.lit(0)))
    rank = F.struct((-F.coalesce("need", F.lit(0))).alias("n"), F.col("group_id").alias("g"))
    return fits.groupBy("doc_id").agg(F.min(rank).alias("r")).select("doc_id", F.col("r.g").alias("group_id"))


# What texts say about a target; results must equal theirs.
CAUSES = ["cause ", "causes ", "caused by", "result from", "results from", "resulting from", "biallelic pathogenic variants", "pathogenic variants in", "mutations in"]
INHERITANCE = [("AR", ["autosomal recessive", "biallelic", "compound heterozyg", "homozyg"]), ("AD", ["autosomal dominant"]), ("XL", ["x-linked", "x linked"])]
SHIFTED = ["移码", "frameshift", "提前终止", "缺失"]
TYPE_WORDS = [("missense", ["missense", "错义"]), ("nonsense", ["nonsense", "无义"]), ("frameshift", ["frameshift", "移码"]), ("deletion", ["deletion", " del"]), ("duplication", ["duplication", " dup"])]
JOINT_NEGATIVE = r"(?i)(?:患儿)?父母.{0,12}(?:均)?(?:未检测(?:到(?:突变)?)?|未携带|该位点均?无(?:异常|变异)?|无异常|无变异)|both parents.{0,80}(?:not (?:found|detected|carrying)|negative|wild[- ]type)|not found in (?:his|her|the) parents|no mutations were detected in (?:their|the) parents|observed only in the patient|환자\s*부모.{0,40}정상"
RECOVERED = ["A.gene_disease_relationship", "A.variant_type", "B.mode_of_inheritance_reported", "C.maternal_genotype", "C.paternal_genotype", "C.de_novo_status", "C.parentage_confirmed", "J.clinvar_assertion"]
# End of the fixed values.


def _holds(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def said(snippet: Column, gene: Column, disease: Column, variant: Column) -> Column:
    """map<string,string>: fields and values that a snippet states about a target."""
    low = collapse_spaces(F.lower(snippet))
    compact = F.regexp_replace(F.lower(F.coalesce(variant, F.lit(""))), r"\s+", "")
    words = F.filter(F.split(F.lower(disease), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    about = F.contains(low, F.lower(gene)) & F.exists(words, lambda w: F.contains(low, w))
    moi = F.coalesce(*(F.when(_holds(low, w), v) for v, w in INHERITANCE))
    indel = IR.coding_indel(compact) | IR.coding_indel(low)
    kinds = [F.when(_holds(low, w), v) if v not in ("deletion", "duplication") else F.when(_holds(low, w) | F.contains(compact, F.lit(v[:3])), v) for v, w in TYPE_WORDS]
    kind = F.when(indel, "frameshift").otherwise(F.coalesce(*kinds))
    assertion = F.when(F.contains(low, F.lit("likely pathogenic")) | (F.contains(low, F.lit("pathogenic")) & F.rlike(low, F.lit(r"\blp\b"))), "Likely pathogenic").when(F.contains(low, F.lit("pathogenic")), "Pathogenic")
    joint = F.rlike(snippet, F.lit(JOINT_NEGATIVE)) & ~F.rlike(snippet, F.lit(IR.INHERITED))
    tested = F.rlike(snippet, F.lit(IR.PARENTAGE))
    pairs = {
        "A.gene_disease_relationship": F.when(about & _holds(low, CAUSES), "causative"), "B.mode_of_inheritance_reported": moi, "A.variant_type": kind, "J.clinvar_assertion": assertion,
        "C.maternal_genotype": F.when(joint, "target_absent"), "C.paternal_genotype": F.when(joint, "target_absent"), "C.de_novo_status": F.when(joint, "de_novo"), "C.parentage_confirmed": F.when(joint & ~tested, "not_confirmed"),
    }
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def recovered(items: DataFrame, targets: DataFrame) -> DataFrame:
    """(document_id, field_id, value, pos): for each field of ``RECOVERED`` that a document has no found value of, what its
    first snippet by pos says that says anything.

    items (document_id, pos, field_id, status, value, snippet), targets (document_id, gene, disease, variant).
    """
    found = items.filter((F.col("status") == "found") & F.col("snippet").isNotNull() & (F.trim("snippet") != ""))
    facts = found.join(targets, "document_id").select("document_id", "pos", F.explode(said(F.trim("snippet"), F.col("gene"), F.col("disease"), F.col("variant"))).alias("field_id", "value"))
    first = facts.groupBy("document_id", "field_id").agg(F.min(F.struct("pos", "value")).alias("f"))
    have = items.filter((F.col("status") == "found") & (F.trim(F.coalesce("value", F.lit(""))) != "")).select("document_id", "field_id").distinct()
    return first.join(have, ["document_id", "field_id"], "left_anti").select("document_id", "field_id", F.col("f.value").alias("value"), F.col("f.pos").alias("pos"))
