"""Entity matching: alias lookup with priorities, overlap resolution, interval and nearest joins, nearest vectors."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import stored
from .aliases import SHARD_BYTES, meet
from .relational import best_tier, top_one

#: Order of alias types in a lookup; others come last.
ALIAS_TIER = {"primary": 0, "alias": 1, "previous_symbol": 2, "name": 3, "rsid": 4}


def alias_candidates(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions (mention_id, entity_type, text) joined with aliases (entity_type, alias, entry_id, alias_type) on text."""
    return mentions.join(aliases, (mentions["text"] == aliases["alias"]) & (mentions["entity_type"] == aliases["entity_type"])).select("mention_id", mentions["entity_type"], "entry_id", "alias_type")


def prioritized(candidates: DataFrame, source_rank: Column | None = None) -> DataFrame:
    """Candidates of the best source, then of the best alias type, distinct by entry."""
    tier = F.lit(99)
    for k, v in ALIAS_TIER.items():
        tier = F.when(F.col("alias_type") == k, v).otherwise(tier)
    ranked = best_tier(candidates, ["mention_id"], source_rank) if source_rank is not None else candidates
    return best_tier(ranked, ["mention_id"], tier).dropDuplicates(["mention_id", "entry_id"])


def finalize(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """standardized (one candidate), ambiguous (several) or unmapped (none)."""
    n = candidates.groupBy("mention_id").agg(F.countDistinct("entry_id").alias("n"), F.min("entry_id").alias("entry_id"))
    out = mentions.join(n, "mention_id", "left")
    status = F.when(F.col("n") == 1, "standardized").when(F.col("n") > 1, "ambiguous").otherwise("unmapped")
    return out.select("mention_id", status.alias("status"), F.when(F.col("n") == 1, F.col("entry_id")).alias("entry_id"))


#: Words that tell no diseases apart.
COMMON_WORDS = ["disease", "syndrome", "type", "the", "of", "and", "with", "due", "to", "a", "in", "for", "disorder", "deficiency", "mutation"]


def significant_tokens(c: Column) -> Column:
    """Distinct runs of a-z and 0-9 longer than two characters, without common words, in order."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))), lambda w: (F.length(w) > 2) & ~w.isin(COMMON_WORDS))


def grams(c: Column, n: int = 3) -> Column:
    """Distinct substrings of n characters; a shorter text is one by itself."""
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.array_distinct(pieces)


def rarest_gram_pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay) of needles (needle, grams) and hays (hay, grams) such that the hay has the needle's rarest gram.

    Whatever contains all of a needle's grams is among them.  Each needle is looked up by one gram, the one that the
    fewest hays have, so frequent ones pair nothing; a needle with a gram that no hay has is left out.
    """
    asked = needles.select("needle", F.explode("grams").alias("g"))
    have = hays.select("hay", F.explode("grams").alias("g")).join(asked.select("g").distinct(), "g", "left_semi")
    sizes = have.groupBy("g").agg(F.count("*").alias("n"))
    known = asked.join(sizes, "g", "left").groupBy("needle").agg(F.min(F.struct("n", "g")).alias("rare"), F.bool_and(F.col("n").isNotNull()).alias("whole"))
    return known.filter("whole").select("needle", F.col("rare.g").alias("g")).join(have, "g").select("needle", "hay")


def token_index(queries: list[tuple[int, str]]) -> tuple[ahocorasick.Automaton, list[list[tuple[int, list[str]]]]]:
    """An automaton of each query's longest token, and the queries (id, tokens) of each such token."""
    found, of = ahocorasick.Automaton(), {}
    for query_id, text in queries:
        tokens = text.split(" ")
        of.setdefault(max(tokens, key=lambda w: (len(w), w)), []).append((query_id, tokens))
    for i, token in enumerate(of):
        found.add_word(token, i)
    found.make_automaton()
    return found, list(of.values())


def token_overlaps(index: tuple, alias_id: int, low: str) -> Iterator[tuple[int, int, float]]:
    """(query_id, alias_id, score) of the queries all of whose tokens stand in the lower-case text."""
    found, of = index
    own, held = None, {}
    for i in {i for _, i in found.iter(low)} if of else ():
        for query_id, tokens in of[i]:
            for w in tokens:
                if w not in held:
                    held[w] = w in low
                if not held[w]:
                    break
            else:
                if own is None:
                    own = {w for w in re.findall("[a-z0-9]+", low) if len(w) > 2} - set(COMMON_WORDS)
                same = len(own.intersection(tokens))
                yield query_id, alias_id, same / (len(tokens) + len(own) - same)


def resolve_by_tokens(queries: DataFrame, aliases: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, alias_id, score): for each query (query_id, text) the alias (alias_id, text) that contains all of its
    significant tokens and has the largest Jaccard overlap of token sets; ties to the smaller id.

    Ids are long.  Queries without such tokens, and those that no alias contains, have no row.  Each alias is read once, for
    all queries' longest tokens together; only queries whose longest token it has are looked at.
    """
    q = queries.select(F.col("query_id").alias("id"), F.array_join(significant_tokens(F.col("text")), " ").alias("text"))
    rows = meet(aliases.select(F.col("alias_id").alias("id"), F.lower("text").alias("text")), q, token_index, token_overlaps, "query_id long, alias_id long, score double", shard_bytes)
    best = rows.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "alias_id")).alias("_b"))
    return best.select("query_id", F.col("_b.alias_id").alias("alias_id"), (-F.col("_b.s")).alias("score"))


def containing(points: DataFrame, spans: DataFrame, key: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Points with the spans of their key that contain them (start <= at < end)."""
    return points.join(spans, list(key)).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))


def interval_join(left: DataFrame, right: DataFrame, width: int, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of overlapping half-open intervals, by bins of ``width``: an equi-join instead of a nested loop.

    A pair is reported in the one bin in which the later of both starts lies.
    """
    ls, le = left_span
    rs, re = right_span
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    a, b = left.withColumn("_bin", bins(ls, le)), right.withColumn("_bin", bins(rs, re))
    j = a.join(b, "_bin").filter((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)))
    return j.filter(F.floor(F.greatest(ls, rs) / width) == F.col("_bin")).drop("_bin")


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], at: str, value: str) -> DataFrame:
    """Each left row with the last value of right (key, at, value) at or before it: a union, one sort, a running last."""
    b = right.select(*key, F.col(at), F.lit(0).alias("_side"), F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("_r"))
    a = left.withColumn("_side", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.col(at), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    return out.drop("_side", "_r").withColumn(f"last_{value}", F.col("_last.v")).withColumn(f"last_{at}", F.col("_last.at")).drop("_last")


def nearest(left: DataFrame, right: DataFrame, key: Sequence[str], at: str, right_at: str, tie: str) -> DataFrame:
    """Each left row (it needs a row_id) with the right row of its key at least distance; ties to the smaller ``tie``.

    Neighbours on either side come from running windows over one sorted union, so a key's rows are never paired up.
    """
    r = right.select(*key, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(right_at).alias("at"), (-F.col(tie)).alias("t")).alias("_down"), F.struct(F.col(right_at).alias("at"), F.col(tie).alias("t")).alias("_up"))
    a = left.withColumn("_at", F.col(at)).withColumn("_side", F.lit(1))
    both = a.unionByName(r, allowMissingColumns=True)
    before = Window.partitionBy(*key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*key).orderBy(F.desc("_at"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_lo", F.max("_down").over(before)).withColumn("_hi", F.min("_up").over(after)).filter("_side = 1")
    dist_lo, dist_hi = F.col(at) - F.col("_lo.at"), F.col("_hi.at") - F.col(at)
    lo, hi = F.when(F.col("_lo").isNotNull(), F.struct(dist_lo.alias("d"), (-F.col("_lo.t")).alias("t"))), F.when(F.col("_hi").isNotNull(), F.struct(dist_hi.alias("d"), F.col("_hi.t").alias("t")))
    best = F.least(lo, hi)
    return out.withColumn("_best", best).withColumn("distance", F.col("_best.d")).withColumn("nearest", F.col("_best.t")).drop("_at", "_side", "_down", "_up", "_lo", "_hi", "_best")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, which rows have one) of a list column whose vectors are equally long; null and zero vectors have none."""
    rows = col.to_pylist()
    length = max((len(r) for r in rows if r), default=0)
    good = np.array([bool(r) and len(r) == length and None not in r for r in rows])
    out = np.zeros((len(rows), length))
    if good.any():
        out[good] = np.array([r for r, g in zip(rows, good, strict=True) if g], float)
    norm = np.linalg.norm(out, axis=1)
    good &= np.isfinite(norm) & (norm > 0)
    out[good] /= norm[good, None]
    return out, good


class _Best:
    """The k nearest vectors so far of each query of a block."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int) -> None:
        self.ids, self.unit, self.k = ids, unit, k
        self.score, self.vec = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)

    def meet(self, ids: np.ndarray, unit: np.ndarray) -> None:
        if not len(ids) or unit.shape[1] != self.unit.shape[1]:
            return
        # Rounded, so that equal vectors tie wherever they stand in a block.
        score = np.round(self.unit @ unit.T, 12)
        score[self.ids[:, None] == ids[None, :]] = -np.inf
        score, vec = np.concatenate([self.score, score], 1), np.concatenate([self.vec, np.broadcast_to(ids, score.shape)], 1)
        order = np.lexsort((vec, -score), axis=1)[:, : self.k]
        self.score, self.vec = np.take_along_axis(score, order, 1), np.take_along_axis(vec, order, 1)

    def rows(self) -> pa.RecordBatch | None:
        q, j = np.nonzero(self.score > -np.inf)
        if not len(q):
            return None
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.vec[q, j]), pa.array(self.score[q, j])], ["query_id", "vec_id", "score"])


def k_nearest(queries: DataFrame, vectors: DataFrame, k: int, max_queries: int = 1000) -> DataFrame:
    """Exact k nearest vectors of each query (query_id, q): (query_id, vec_id, score, rank), ties to the smaller id.

    Up to ``max_queries`` queries are broadcast, and vectors stay where they are.  More are dealt into blocks of about half
    as many: a block is a key, not a branch of the plan, and meets each slice of the vectors in a task of its own.  Tasks
    multiply matrices and keep k vectors of each query.  Null and zero vectors take no part.
    """
    known = stored(queries.select(F.col("query_id").cast("long").alias("id"), F.col("q").cast("array<double>").alias("v")))
    rest = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    n = known.count()

    def block_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        unit, good = _unit(batch.column("v"))
        return batch.column("id").to_numpy(zero_copy_only=False)[good], unit[good]

    if n <= max_queries:
        shared = queries.sparkSession.sparkContext.broadcast([(r["id"], r["v"]) for r in known.orderBy("id").collect()])

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = pa.RecordBatch.from_arrays([pa.array([i for i, _ in shared.value], pa.int64()), pa.array([v for _, v in shared.value], pa.list_(pa.float64()))], ["id", "v"])
            best = _Best(*block_of(own), k)
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    best.meet(*block_of(batch.slice(at, 1024)))
            if (out := best.rows()) is not None:
                yield out

        found = rest.mapInArrow(near, "query_id long, vec_id long, score double")
    else:
        blocks, slices = -(-2 * n // max_queries), int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        asked = known.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), each(slices).alias("slice"), F.lit(0).alias("side"), "id", "v")
        held = rest.select(each(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(slices)).alias("slice"), F.lit(1).alias("side"), "id", "v")

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, own, best = None, [], None
            for batch in batches:
                where = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "slice", "side")], 1)
                cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1), len(where)]
                for first, last in itertools.pairwise(cuts):
                    here, side = tuple(where[first, :2]), where[first, 2]
                    if here != at:
                        if best is not None and (out := best.rows()) is not None:
                            yield out
                        at, own, best = here, [], None
                    piece = batch.slice(first, last - first).select(["id", "v"])
                    if side == 0:
                        own.append(piece)
                        continue
                    if best is None:
                        best = _Best(*block_of(pa.Table.from_batches(own).combine_chunks().to_batches()[0]) if own else (np.zeros(0, np.int64), np.zeros((0, 0))), k)
                    for i in range(0, piece.num_rows, 1024):
                        best.meet(*block_of(piece.slice(i, 1024)))
            if best is not None and (out := best.rows()) is not None:
                yield out

        both = asked.unionByName(held).repartition(int(blocks * slices), "block", "slice").sortWithinPartitions("block", "slice", "side")
        found = both.mapInArrow(dealt, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def margin_decision(ranked: DataFrame, threshold: float, margin: float) -> DataFrame:
    """unmapped below the threshold, ambiguous if the runner-up is within the margin, else standardized."""
    best = ranked.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("rank") == 1, F.col("vec_id"))).alias("vec_id"))
    status = F.when(F.col("first") < threshold, "unmapped").when(F.col("first") - F.col("second") < margin, "ambiguous").otherwise("standardized")
    return best.select("query_id", status.alias("status"), "vec_id")


def by_gene_context(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """One variant entry a mention: the smallest id of the best alias tier among entries of the mention's gene; without
    any of that gene a single candidate stands, and several are dropped.

    mentions (mention_id, gene), candidates (mention_id, entry_id, gene_symbol, alias_type).
    """
    j = candidates.join(mentions.select("mention_id", F.upper(F.trim("gene")).alias("_gene")), "mention_id", "left")
    same = F.coalesce((F.upper(F.trim("gene_symbol")) == F.col("_gene")) & (F.col("_gene") != ""), F.lit(False))
    tier = F.lit(99)
    for k, v in ALIAS_TIER.items():
        tier = F.when(F.col("alias_type") == k, v).otherwise(tier)
    g = j.groupBy("mention_id").agg(F.min(F.when(same, F.struct(tier.alias("t"), "entry_id"))).alias("s"), F.countDistinct("entry_id").alias("n"), F.min("entry_id").alias("only"))
    entry = F.when(F.col("s").isNotNull(), F.col("s.entry_id")).when(F.col("n") == 1, F.col("only"))
    return g.select("mention_id", entry.alias("entry_id")).filter("entry_id IS NOT NULL")


def label_lookup(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(query, node): the label equal to the query, else the first by position that contains it or lies in it.

    labels (label, node, pos) are an ontology's.  What no label equals meets labels that share its rarest gram, or whose
    rarest gram it has; texts of up to two characters are grams by themselves.
    """
    exact = queries.join(labels.groupBy("label").agg(F.max_by("node", "pos").alias("node")), queries["query"] == F.col("label")).select("query", "node")
    rest = queries.filter("query <> ''").distinct().join(exact.select("query"), "query", "left_anti")
    known = labels.filter("label <> ''")
    sized = lambda c: F.array_distinct(F.concat(grams(c, 1), grams(c, 2), grams(c, 3)))
    words, names = rest.select(F.col("query").alias("needle"), grams(F.col("query")).alias("grams")), known.select(F.col("label").alias("needle"), grams(F.col("label")).alias("grams")).distinct()
    inside = rarest_gram_pairs(words, known.select(F.col("label").alias("hay"), sized(F.col("label")).alias("grams")).distinct()).select(F.col("needle").alias("query"), F.col("hay").alias("label"))
    around = rarest_gram_pairs(names, rest.select(F.col("query").alias("hay"), sized(F.col("query")).alias("grams"))).select(F.col("hay").alias("query"), F.col("needle").alias("label"))
    near = inside.unionByName(around).distinct().filter(F.contains("label", F.col("query")) | F.contains("query", F.col("label"))).join(known, "label")
    return exact.unionByName(near.groupBy("query").agg(F.min_by("node", "pos").alias("node")))


def alias_references(relations: DataFrame, aliases: DataFrame, side: str) -> DataFrame:
    """relations with <side>_id filled: given ids stay, else the smallest entry of the typed alias; unresolved rows go."""
    first = aliases.groupBy(F.col("entity_type").alias(f"{side}_type"), F.col("alias").alias(f"{side}_alias")).agg(F.min("entry_id").alias("_id"))
    j = relations.join(first, [f"{side}_type", f"{side}_alias"], "left")
    return j.withColumn(f"{side}_id", F.coalesce(f"{side}_id", "_id")).drop("_id").filter(F.col(f"{side}_id").isNotNull()).select(*relations.columns)
