"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has a bit for each of 64 majority votes over the hashes of its word shingles.  Fingerprints
link at ``radius`` or fewer differing bits.  For radius r, each bit i is given a non-zero vector m(i) of r+1 bits, and
each non-zero vector v makes a mask of the bits with <m(i), v> = 1.  Any r differing bits span at most r dimensions, so
some v is orthogonal to all of them and its mask avoids them: every pair within the radius meets in some table.

Only distinct fingerprints go into the tables, so copies cost nothing there.  A bucket of at most ``block`` fingerprints
is compared whole and reports a spanning forest of its links, never its pairs.  A larger bucket is split exactly: its
free bits (those the key does not fix) fall into r+1 groups, two fingerprints within the radius agree on one of them,
and each group's bits refine the key.  Few free bits bound a bucket's size, so splitting ends.

:func:`leaders` holds such links against the texts: fingerprints and bands of minimum hashes only propose, and documents
belong together if the exact Jaccard similarity of their shingle sets links them.

Results: null, empty and blank texts have fingerprint zero, which links like any other.  Texts with fewer words than a
shingle are one shingle.  Repeated rows get equal results.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import common
from .common import buffer_of, join_facts, materialize, mix, numbered, release, slices, word_spans, words_of

BITS = 64
#: Bytes of text in a block.
BLOCK_BYTES = 2 << 20
#: Shingles whose votes are added up at once: each takes some 300 bytes meanwhile.
VOTES = 1 << 14
#: Bits, as a power of two, of the bitmap of documents that are compared (4 MB).
MARKS = 25
#: Shingles of texts that are compared together in one task.
TOGETHER = 2_000_000
#: Bands of minimum hashes and hashes in each: pairs of similarity 0.8 miss all bands with probability 6e-5, and pairs of
#: 0.1 meet in one with 3e-5.
BANDS, ROWS = 32, 6
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """Fingerprint of a text whose words are its runs between ASCII white space, A-Z lower-cased."""
    parts = text.lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.append(0, ends[:-1])[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], "<u8")
    votes = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        votes += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id long, fp long: the fingerprint's 64 bits as a signed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", block_bytes):
            raw, offsets = buffer_of(b.column("text"))
            data, cuts = raw.tobytes(), offsets.tolist()
            fps = np.array([fingerprint(data[x:y], words, seed) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    named = df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")
    return named.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """2**(radius+1) - 1 masks of 64 bits such that any ``radius`` bits lie outside one of them."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if ((i % vectors + 1) & v).bit_count() & 1) for v in range(1, vectors + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def halves(mask: int, radius: int) -> list[int]:
    """The masks that split a bucket of ``mask``: it fixes more bits, one group of the free ones at a time."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[g :: radius + 1]) for g in range(radius + 1)]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints (distinct) within the radius, found breadth first."""
    fps = np.sort(fps.view(np.uint64))
    left = np.ones(len(fps), bool)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(len(fps)):
        if not left[i]:
            continue
        left[i] = False
        front, root = fps[i : i + 1], fps[i]
        while len(front):
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = np.zeros(len(rest), bool)
            for a in range(0, len(front), 256):
                todo = np.flatnonzero(~near)
                near[todo] = (np.bitwise_count(front[a : a + 256, None] ^ fps[rest[todo]][None, :]) <= radius).any(0)
            hit = rest[near]
            left[hit] = False
            front = fps[hit]
            out.append((np.full(len(hit), root), front))
    if not out:
        return []
    a, b = (np.concatenate(x).view(np.int64).tolist() for x in zip(*out, strict=True))
    return list(zip(a, b, strict=True))


def _bucket_links(radius: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (mask, key); buckets have at most ``block`` fingerprints, or else are not complete here."""
        held_key, held = None, []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if held and sum(map(len, held)) > 1:
                out.extend(forest(np.concatenate(held), radius))

        for b in batches:
            mask, key, fp = (b.column(c).to_numpy() for c in ("mask", "key", "fp"))
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                if a == z:
                    continue
                here = (int(mask[a]), int(key[a]))
                if here != held_key:
                    close()
                    held_key, held = here, []
                held.append(fp[a:z])
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def _keyed(df: DataFrame, masks: Column) -> DataFrame:
    # Fingerprints are few bytes, so their table lies in few partitions; what they are multiplied to needs many.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select("fp").repartition(parts, "fp").select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def fingerprint_links(distinct: DataFrame, radius: int = 2, block: int = 8192) -> DataFrame:
    """(a, b): fingerprints whose connected components are those of all pairs within the radius.

    ``distinct`` has distinct values in fp.  Buckets beyond ``block`` are split until none is.
    """
    masks = covering_masks(radius)
    rows, found = _keyed(distinct, F.array([F.lit(signed(m)) for m in masks])), None

    @F.pandas_udf(ArrayType(LongType()))
    def finer(mask: pd.Series) -> pd.Series:
        return mask.map({m: [signed(s) for s in halves(m & (1 << BITS) - 1, radius)] for m in mask.unique().tolist()})

    while True:
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n"))
        # Few buckets are that large; what comes back to the driver is whether there is one.
        hot = sizes.filter(F.col("n") > block).select("mask", "key")
        some = bool(hot.take(1))
        calm = rows.join(hot, ["mask", "key"], "left_anti") if some else rows
        ordered = calm.repartition("mask", "key").sortWithinPartitions("mask", "key")
        links = ordered.select("mask", "key", "fp").mapInArrow(_bucket_links(radius, block), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if not some:
            return found
        hotter = rows.join(hot, ["mask", "key"]).select("fp", F.explode(finer("mask")).alias("mask"))
        rows = materialize(hotter.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))))


def components(links: DataFrame) -> DataFrame:
    """(node, root): connected components of links (a, b), root the smallest node; alternating large and small stars.

    Each round lets every node's larger neighbours point at its smallest (large star), then its smaller ones (small
    star), until nothing changes.  A round is a handful of shuffles; its table replaces the one before.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges)
    total = edges.count()
    while True:
        # What is read twice is written only where it is large.
        held = materialize if total > common.FEW_ROWS else lambda df: df
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = held(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
        large = held(join_facts(both.filter("v > u"), low, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = held(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_facts(large, least, "u", total).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.u", "e.v").filter("u <> v").distinct())
        # Done when every node points at one that points nowhere: the table is a forest of stars.
        total, nodes = after.select(F.count("*"), F.countDistinct("u")).first()
        linked = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").take(1)
        release(edges, low, large, least)
        edges = after
        if total == nodes and not linked:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, words: int = 3, radius: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, fp long, component_id: the smallest doc_id that links reach, itself included), a row for each row of df."""
    marked = materialize(fingerprints(df, words, seed, id_col, text_col, block_bytes))
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    roots = components(fingerprint_links(classes.select("fp"), radius))
    member = materialize(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", "copies", F.coalesce("root", "fp").alias("root")))
    lowest = materialize(member.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")))
    rows, distinct = member.agg(F.sum("copies"), F.count("*")).first()
    component = materialize(join_facts(member, lowest, "root", distinct).select("fp", "component_id", F.col("copies").alias("n")))
    return join_facts(marked, component, "fp", rows or 0).select("doc_id", "fp", "component_id")


class BlockWords:
    """Hashes of the words of a block of texts, A-Z lower-cased; each distinct word is hashed once."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        low = raw + ((raw >= 0x41) & (raw <= 0x5A)).astype(np.uint8) * np.uint8(32)
        start, end, self.doc = word_spans(low, offsets)
        number, distinct = numbered(words_of(low, start, end))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
        self.words, self.texts = hashes[number] if len(number) else np.zeros(0, np.uint64), len(offsets) - 1
        self.first = np.searchsorted(self.doc, np.arange(self.texts + 1))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, offsets) of the shingles of k words of each text, repeats included; fewer words are one shingle."""
        counts = np.diff(self.first)
        n = len(self.words) - k + 1
        out = np.zeros(max(n, 0), np.uint64)
        for j in range(k if n > 0 else 0):
            out = mix(out * np.uint64(3) + self.words[j : j + n])
        inside = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)
        full, sizes = out[inside], np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
        offsets = np.append(0, np.cumsum(sizes))
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            hashes = np.zeros(int(offsets[-1]), np.uint64)
            plain = np.ones(len(hashes), bool)
            plain[offsets[short]] = False
            hashes[plain] = full
            for d in short.tolist():
                h = np.full(1, len(self.words[self.first[d] : self.first[d + 1]]) << 32, np.uint64)
                for w in self.words[self.first[d] : self.first[d + 1]]:
                    h = mix(h * np.uint64(3) + w)
                hashes[offsets[d]] = h[0]
            full = hashes
        return full, offsets

    def sets(self, k: int) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's shingles."""
        hashes, offsets = self.shingles(k)
        return [np.unique(x) for x in np.split(hashes, offsets[1:-1])] if self.texts else []

    def fingerprints(self, k: int) -> np.ndarray:
        """Majority votes of each text's shingles, as in :func:`fingerprint` but for the hash of a shingle."""
        hashes, offsets = self.shingles(k)
        out = np.zeros(self.texts, np.uint64)
        votes = np.zeros((self.texts, BITS), np.int32)
        for a in range(0, len(hashes), VOTES):
            part = hashes[a : a + VOTES]
            # A text may have votes in several stretches.
            first, last = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, a + len(part))
            begin, stop = np.maximum(offsets[first:last], a), np.minimum(offsets[first + 1 : last + 1], a + len(part))
            some = np.flatnonzero(stop > begin)
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[first + some] += np.add.reduceat(bits, begin[some] - a, axis=0, dtype=np.int32)
        some = np.flatnonzero(np.diff(offsets))
        out[some] = np.packbits(2 * votes[some].astype(np.int64) > np.diff(offsets)[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
        return out


def normal_digest(text: bytes) -> bytes:
    return xxhash.xxh128_digest(b" ".join(text.lower().split()))


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """A hash for each band of minimum hashes; sets agree in a band as often as in all its minima."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[i : i + 1024, None] * FACTORS[None, :]).min(0), out=low)
    folded = (mix(low).reshape(BANDS, ROWS) * FACTORS[None, :ROWS]).sum(1, dtype=np.uint64)
    return mix(folded + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def clusters(sets: list[np.ndarray], least: float) -> list[int]:
    """For each shingle set the first set of its component, where sets of Jaccard similarity ``least`` or more link.

    Exact: sets that similar share one of the first n - ceil(least * n) + 1 of their n sorted hashes.  Members of a
    component that a set is already in are not compared with it, so groups of copies cost no pairs.
    """
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    cuts = [s[: len(s) - math.ceil(least * len(s) - 1e-9) + 1] for s in sets]
    _, number, times = np.unique(np.concatenate(cuts or [np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    # Only hashes in several prefixes are indexed: others lead to no set.
    shared_hashes = np.split(times[number] > 1, np.cumsum([len(x) for x in cuts])[:-1])
    del number, times
    index: dict[int, dict[int, list[int]]] = {}
    for i, s in enumerate(sets):
        n, seen = len(s), set()
        prefix = cuts[i][shared_hashes[i]].tolist() if n else [-1]
        for h in prefix:
            held = index.setdefault(h, {})
            for c in [c for c in held if find(c) != c]:
                moved, into = held.pop(c), held.setdefault(find(c), [])
                into.extend(moved)
            for c, members in held.items():
                for j in members if find(c) != find(i) else ():
                    if j in seen:
                        continue
                    seen.add(j)
                    m = len(sets[j])
                    if min(m, n) < least * max(m, n) - 1e-9:
                        continue
                    shared = len(np.intersect1d(s, sets[j], assume_unique=True))
                    if n + m == 0 or shared / (n + m - shared) >= least:
                        x, y = sorted((find(i), find(j)))
                        root[y] = x
                        break
        for h in prefix:
            index[h].setdefault(find(i), []).append(i)
    return [find(i) for i in range(len(sets))]


def likely(rows: DataFrame, keys: DataFrame, column: str, bits: int = MARKS) -> DataFrame:
    """The rows whose ``column`` may be among those of ``keys``, before they are shuffled to a join.

    A bitmap of hashes, of a size fixed by ``bits``, goes to all tasks.  No row of a key is lost; others pass by chance.
    """
    spark, place = rows.sparkSession, F.pmod(F.xxhash64(column), F.lit(1 << bits))
    marks = keys.select((place + 1).alias("place")).select(F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("bit"))
    bitmap = np.zeros((max(1, (1 << bits) >> 15), 4096), np.uint8)
    for r in marks.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bitmap[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bitmap.ravel())

    @F.pandas_udf("boolean")
    def marked(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return rows.filter(marked(place))


def _proposed(df: DataFrame, words: int, radius: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, same: digest of the text in lower case with single spaces) of all rows, and (rep: smallest doc_id, same,
    root, size: shingles, total: those of all texts of the root) of distinct texts that fingerprints or bands put together
    with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK_BYTES):
            raw, offsets = buffer_of(b.column("text"))
            data, cuts = raw.tobytes(), offsets.tolist()
            block = BlockWords(raw, offsets)
            fps = block.fingerprints(words).view(np.int64)
            same = [normal_digest(data[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            sets = block.sets(shingle)
            bands, size = [band_hashes(x) for x in sets], [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(size, pa.int64())], ["doc_id", "fp", "same", "bands", "size"])

    marked = materialize(df.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, fp long, same binary, bands array<long>, size long"))
    texts = materialize(marked.groupBy("same").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.first("size").alias("size")))
    bands = texts.select(F.explode("bands").alias("band"), F.col("fp").alias("a"))
    # Texts of a band that a template fills stay where they are.
    # A band whose texts all have one fingerprint links nothing.
    spread = bands.groupBy("band").agg(F.min("a").alias("b"), F.max("a").alias("most"), F.count("*").alias("n"))
    least_of = materialize(spread.filter("b <> most").drop("most"))
    banded = join_facts(bands, least_of, "band", texts.count() * BANDS).filter("a <> b")
    links = fingerprint_links(texts.select("fp").distinct(), radius).unionByName(banded.select("a", "b"))
    roots = components(links).withColumnRenamed("node", "fp")
    grouped = materialize(texts.join(roots, "fp", "left").select("rep", "same", "size", F.coalesce("root", "fp").alias("root")))
    several = materialize(grouped.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total")).filter("n > 1"))
    return marked.select("doc_id", "same"), materialize(join_facts(grouped, several, "root", grouped.count()))


def leaders(df: DataFrame, words: int, radius: int, shingle: int, least: float, together: int = TOGETHER) -> DataFrame:
    """(doc_id, same): of each group of df (doc_id, text) the smallest doc_id and the digest of its text there.

    Groups are the components of links of exact Jaccard similarity ``least`` or more of shingle sets, among texts that
    links of fingerprints (``words``, ``radius``) or bands of minimum hashes put together.  Blank texts are one group.

    Texts put together are compared in one task while they have at most ``together`` shingles.  Larger ones are dealt to
    parts of that size, each pair of parts is compared in a task of its own, and the links found are joined to components.
    """
    marked, proposed = _proposed(df, words, radius, shingle)
    parts = F.ceil(F.col("total") / F.lit(float(together))).cast("int")
    dealt = proposed.withColumn("parts", F.greatest(parts, F.lit(1))).withColumn("part", F.pmod(F.xxhash64("same"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pairs = dealt.select("rep", "same", "root", "part", other.alias("k")).select("rep", "same", "root", F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"))
    # Most texts are in no group: they are not shuffled.
    rows = likely(df.selectExpr("CAST(doc_id AS BIGINT) AS rep", "text"), proposed, "rep").join(pairs, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (root, i, j, rep, same); texts of one (root, i, j) are compared together.  Out: texts and the
        first text of their group, if that is another."""
        at, held = None, {}

        def close() -> pa.RecordBatch:
            first = clusters([s for _, s in held.values()], least)
            names, reps = list(held), [rep for rep, _ in held.values()]
            later = [n for n, c in enumerate(first) if n != c]
            lead = [first[n] for n in later]
            columns = [pa.array([x[n] for n in y], t) for x, y, t in ((names, later, pa.binary()), (reps, later, pa.int64()), (names, lead, pa.binary()), (reps, lead, pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["same", "rep", "lead", "lead_rep"])

        for batch in batches:
            for b in slices([batch], "text", BLOCK_BYTES):
                raw, offsets = buffer_of(b.column("text"))
                data, cuts, sets = raw.tobytes(), offsets.tolist(), BlockWords(raw, offsets).sets(shingle)
                for k, (root, i, j, rep, same) in enumerate(zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "rep", "same")), strict=True)):
                    if (root, i, j) != at:
                        if held:
                            yield close()
                        at, held = (root, i, j), {}
                    # Rows that repeat a doc_id may have other texts.
                    if same not in held and normal_digest(data[cuts[k] : cuts[k + 1]]) == same:
                        held[same] = (rep, sets[k])
        if held:
            yield close()

    ordered = rows.select("root", "i", "j", "rep", "same", "text").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "rep", "same")
    found = materialize(ordered.mapInArrow(run, "same binary, rep long, lead binary, lead_rep long"))
    later = found.select("same")
    if dealt.filter("parts > 1").take(1):
        # A text may follow one text in one pair of parts and another in the next: groups are what links connect.
        # Texts are named by their digests, which do not collide.
        roots = components(found.select(F.col("same").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("node", "same")
        texts = found.select("same", "rep").unionByName(found.select(F.col("lead").alias("same"), F.col("lead_rep").alias("rep"))).distinct()
        member = materialize(texts.join(roots, "same", "left").select("same", "rep", F.coalesce("root", "same").alias("root")))
        first = materialize(member.groupBy("root").agg(F.min(F.struct("rep", "same")).alias("first"), F.count("*").alias("n")))
        later = join_facts(member, first, "root", member.count()).filter(F.struct("rep", "same") != F.col("first")).select("same")
    lowest = marked.groupBy("same").agg(F.min("doc_id").alias("doc_id"))
    return lowest.join(later, "same", "left_anti").select("doc_id", "same")


def digested(df: DataFrame, column: str) -> DataFrame:
    """df with the digest of its normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BLOCK_BYTES):
            raw, offsets = buffer_of(b.column("text"))
            data, cuts = raw.tobytes(), offsets.tolist()
            yield b.append_column(column, pa.array([normal_digest(data[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(column, BinaryType())]))


def one_of_each(df: DataFrame, words: int = 2, radius: int = 3, shingle: int = 5, least: float = 0.8, together: int = TOGETHER) -> DataFrame:
    """The rows of df (doc_id, text, ...) without near-duplicates: of each group of :func:`leaders` one row.

    It is a row of the smallest doc_id; rows that share it but not their text are told apart by their texts.  Of rows that
    share both (but for case and white space) the smallest by all columns stays.  Rows without doc_id stand in no group and
    stay.  An empty table gives no rows.
    """
    first = materialize(leaders(df.filter("doc_id IS NOT NULL"), words, radius, shingle, least, together))
    digest, number = f"digest_{uuid.uuid4().hex}", f"number_{uuid.uuid4().hex}"
    keyed = digested(df.filter("doc_id IS NOT NULL"), digest).withColumn(number, F.col("doc_id").cast("long"))
    often = df.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    first = materialize(first.join(often.withColumn("often", F.lit(True)), "doc_id", "left"))
    lead = first.select(F.col("doc_id").alias(number), F.col("same").alias(digest), "often")
    once = keyed.join(lead.filter("often IS NULL"), [number, digest], "left_semi").select(*df.columns)
    several = keyed.join(lead.filter("often"), [number, digest], "left_semi").groupBy(number, digest).agg(F.min(F.struct(*df.columns)).alias("r")).select("r.*")
    return once.unionByName(several).unionByName(df.filter("doc_id IS NULL"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
