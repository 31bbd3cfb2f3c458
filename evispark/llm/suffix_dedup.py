"""Suffix deduplication: remove bytes covered by a ``length``-byte string that also starts earlier in the corpus.

The suffixes of a large corpus are sorted blockwise, one bucket at a time:

1. Buckets.  All suffixes can't be shuffled, so a content-defined cover deals them out: each window of ``length`` bytes
   belongs to the leftmost smallest hash among its ``GRAM``-byte strings, its anchor.  Equal windows have equal anchors,
   so they meet in the anchor's bucket.  A bucket holds stretches: the bytes of all windows of one anchor.
2. Stretches equal to an earlier one repeat whole.  A task settles its own before anything is shuffled, and a sorted
   stream, which remembers one row, settles the rest.  Long copies end here.
3. Buckets with several different stretches fetch them and sort their suffixes.  Suffixes are ordered by their first 32
   bytes; longer ties by a difference cover of the positions modulo ``PERIOD``: the suffixes at cover positions are ranked
   beforehand (names of ``PERIOD`` bytes, doubled along the period until they reach a stretch's end), and for any two
   positions a shift below the period brings both into the cover, where one comparison of ranks decides.  Neighbours in
   the order that share ``length`` bytes are equal windows, of which all but the earliest are repeats.
   Memory is bounded by a block, or by one bucket of ``HOT`` stretches; larger ones are cut down to single windows, by
   two 62-bit hashes, with a distributed minimum of the place.
4. The intervals found are merged in their documents and cut out.

Stretches are told apart by a 64-bit hash of the gram and one of 62 bits of the whole; windows in a bucket by their bytes.
Anchors that a sample of documents shows to be frequent are dealt out by stretch, too, so no task gets all of a hot one;
the sample steers only where rows go.

Results: a null text is empty.  Matches never cross documents.  Rows that repeat both doc_id and text are one document
and get equal results; rows that share doc_id but not text are documents in order of a hash of the text.  A null doc_id
sorts before all others.  Texts of any length that a Spark string can have (below 2**31 bytes) are read whole, in
overlapping segments.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHashes, buffer_of, join_facts, materialize, mix, slices

GRAM = 32
#: A perfect difference set: every residue modulo PERIOD is a difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes of text in a block, anchors that a task settles together, bytes of a sorting block, stretches of a hot bucket.
BLOCK_BYTES, TOGETHER, SORT_BYTES, HOT = 1 << 19, 200_000, 300_000, 3_000
#: Hot buckets that are broadcast at most.
LARGE = 100_000
#: One document in so many is looked at for frequent anchors; at most so many of these are dealt out by stretch.
SAMPLE, FREQUENT = 16, 4096
#: Bits of a position in a text, and layout of ``place``: the anchor's position, 7 bits each of its least and largest offset.
POS_BITS = 31
NULL_ID = -(1 << 63)


def reclaim(df: DataFrame) -> None:
    """Let Spark delete shuffle files of steps whose results are written; it does so when the driver collects garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    rows = padded.reshape(-1, w)
    fore = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM (a multiple of 8) bytes that start at each position."""
    n = len(raw) - 7
    words = np.empty(n, np.uint64)
    for j in range(8):
        part = raw[j : j + (len(raw) - j) // 8 * 8].view("<u8")
        words[j::8] = part[: len(words[j::8])]
    m = len(raw) - GRAM + 1
    out = np.zeros(m, np.uint64)
    for i in range(0, GRAM, 8):
        out += words[i : i + m] * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED2701 * i)
    return mix(out)


def segments(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(batch, bytes, offsets, start): blocks of whole texts, or one text's segments that begin at start and overlap."""
    for b in slices(batches, "text", limit, "spans"):
        raw, offsets = buffer_of(b.column("text"))
        if b.num_rows > 1 or len(raw) <= limit + overlap:
            yield b, raw, offsets, 0
            continue
        for at in range(0, len(raw) - overlap, limit):
            part = raw[at : at + limit + overlap]
            yield b, part, np.array([0, len(part)]), at


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, anchor, first window, last window, bucket, fingerprint) of the anchors of a block; absolute positions."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(raw) < length:
        return none
    w = length - GRAM + 1
    h = gram_hashes(raw)
    # The top 36 bits of the hash, then the position (a block is below 2**28 bytes): ties go to the left.
    at = (sliding_min((h >> np.uint64(28) << np.uint64(28)) | np.arange(len(h), dtype=np.uint64), w) & np.uint64((1 << 28) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = doc[: len(at)] == doc[length - 1 :]
    begin = valid.copy()
    begin[1:] &= (at[1:] != at[:-1]) | ~valid[:-1] | (doc[1 : len(at)] != doc[: len(at) - 1])
    first = np.flatnonzero(begin)
    if not len(first):
        return none
    end = valid.copy()
    end[:-1] &= (at[1:] != at[:-1]) | ~valid[1:] | (doc[1 : len(at)] != doc[: len(at) - 1])
    last = np.flatnonzero(end)
    anchor = at[first]
    print_ = mix(SpanHashes(raw)(first, last + length) ^ (anchor - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return doc[first], anchor, first, last, h[anchor], print_


def scan(docs: DataFrame, length: int, block_bytes: int = BLOCK_BYTES, together: int = TOGETHER) -> DataFrame:
    """(g, e, doc, th, place): anchors that no earlier one of their task equals; those that one does come as intervals.

    An interval has place -1, and its start and end in e; its g only deals it out.
    """
    names = ["g", "e", "doc", "th", "place"]

    def settle(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, text, pos, first, last, g, e = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((first, text, doc))
        doc, text, pos, first, last, g, e = (c[order] for c in (doc, text, pos, first, last, g, e))
        once = np.ones(len(doc), bool)
        once[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (first[1:] != first[:-1])
        doc, text, pos, first, last, g, e = (c[once] for c in (doc, text, pos, first, last, g, e))
        by = np.lexsort((e, g))
        lead = np.ones(len(by), bool)
        lead[1:] = (g[by][1:] != g[by][:-1]) | (e[by][1:] != e[by][:-1])
        fresh = np.zeros(len(by), bool)
        fresh[by[lead]] = True
        place = pos << 14 | (pos - last) << 7 | (pos - first)
        yield pa.RecordBatch.from_arrays([pa.array(g[fresh].view(np.int64)), pa.array(e[fresh].view(np.int64)), pa.array(doc[fresh]), pa.array(text[fresh]), pa.array(place[fresh])], names)
        old = ~fresh
        if old.any():
            d, t, s, z = merged(doc[old], text[old], first[old], last[old] + length)
            deal = mix(mix(d.view(np.uint64)) + s.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(s << POS_BITS | z), pa.array(d), pa.array(t), pa.array(np.full(len(d), -1))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b, raw, offsets, at in segments(batches, block_bytes, length - 1):
            d, a, first, last, g, e = anchors(raw, offsets, length)
            base = offsets[d] - at
            parts.append((b.column("doc").to_numpy()[d], b.column("th").to_numpy()[d], a - base, first - base, last - base, g, e))
            size += len(d)
            if size > together:
                yield from settle(parts)
                parts, size = [], 0
        if size:
            yield from settle(parts)

    return docs.select("doc", "th", "text").mapInArrow(run, "g long, e long, doc long, th long, place long")


def merged(doc: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of intervals of each (doc, text)."""
    order = np.lexsort((start, text, doc))
    doc, text, start, end = doc[order], text[order], start[order], end[order]
    # Documents are told apart by lifting each one's positions above those before it.
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    lift = np.cumsum(new) << (POS_BITS + 1)
    reach = np.maximum.accumulate(end + lift)
    begin = new.copy()
    begin[1:] |= (start + lift)[1:] > reach[:-1]
    at = np.flatnonzero(begin)
    stop = np.append(at[1:], len(doc)) - 1
    return doc[at], text[at], start[at], (reach - lift)[stop]


def frequent(docs: DataFrame, length: int, sample: int = SAMPLE) -> list[int]:
    """Buckets that hold a noticeable part of a task's rows in a sample of documents, at most FREQUENT of them."""
    some = docs.filter(F.pmod(F.xxhash64("doc", "th", F.lit("sample")), F.lit(sample)) == 0)
    sizes = scan(some, length).filter("place >= 0").groupBy("g").agg(F.count("*").alias("n")).filter("n > 8")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = sizes.orderBy(F.desc("n"), "g").limit(FREQUENT).collect()
    return [r["g"] for r in top if r["n"] * 4 * parts > sum(x["n"] for x in top)]


FOUND = "doc long, th long, g long, first long, last long"
INTERVAL = "doc long, th long, first long, last long"


def _settled(length: int, hot: list[int]):
    hot_g = np.array(hot, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (g, e, doc, th, place).  Out: intervals (g null, first to last), and stretches to fetch.

        What is remembered is the row before, the first stretch of the bucket while it is the only one, and the bucket
        that is known to have several.
        """
        before, waiting, several = np.full((5, 1), -2), np.zeros((5, 0), np.int64), None

        def out(doc, text, g, first, last) -> pa.RecordBatch:
            bucket = pa.nulls(len(doc), pa.int64()) if g is None else pa.array(g)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(text), bucket, pa.array(first), pa.array(last)], ["doc", "th", "g", "first", "last"])

        for b in batches:
            rows = np.stack([b.column(c).to_numpy() for c in ("g", "e", "doc", "th", "place")])
            plain = rows[4] < 0
            if plain.any():
                _, e, doc, text, _ = rows[:, plain]
                yield out(doc, text, None, e >> POS_BITS, e & ((1 << POS_BITS) - 1))
            rows = rows[:, ~plain]
            with_before = np.concatenate([before, rows], 1)
            rows = rows[:, (with_before[:, 1:] != with_before[:, :-1]).any(0)]
            if not rows.shape[1]:
                continue
            with_before = np.concatenate([before, rows], 1)
            before = rows[:, -1:]
            lead = (with_before[:2, 1:] != with_before[:2, :-1]).any(0)
            if not lead.all():
                _, _, doc, text, place = rows[:, ~lead]
                pos = place >> 14
                d, t, s, z = merged(doc, text, pos - (place & 127), pos - (place >> 7 & 127) + length)
                yield out(d, t, None, s, z)
            leads = np.concatenate([waiting, rows[:, lead]], 1)
            if not leads.shape[1]:
                continue
            g, last_g = leads[0], rows[0, -1]
            start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            count = np.diff(np.append(start, len(g)))
            need = np.repeat(count > 1, count) | np.isin(g, hot_g)
            if several is not None:
                need |= g == several
            wait = ~need & (g == last_g)
            waiting, several = leads[:, wait], (last_g if not wait.any() else None)
            if need.any():
                g, _, doc, text, place = leads[:, need]
                pos = place >> 14
                yield out(doc, text, g, pos - (place & 127), pos - (place >> 7 & 127))

    return run


def _fetch(length: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of stretches listed for each text."""
        for b in slices(batches, "text", block_bytes, "spans"):
            out: list[list] = [[], [], [], [], []]
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for doc, th, text, need in zip(b.column("doc").to_pylist(), b.column("th").to_pylist(), texts, b.column("need").to_pylist(), strict=True):
                for r in need:
                    for c, v in zip(out, (r["g"], doc, th, r["first"], text[r["first"] : r["last"] + length]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["g", "doc", "th", "first", "data"])

    return run


def shifts() -> np.ndarray:
    """(residue, residue): the least shift that brings two positions of these residues into the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    return np.array([[next(d for d in range(PERIOD) if inside[a + d] and inside[b + d]) for b in range(PERIOD)] for a in range(PERIOD)])


SHIFTS = shifts()


class BlockSort:
    """Suffix order of a block of stretches; suffixes end with their stretch, and a shorter one comes first."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        sizes = np.diff(offsets)
        # Stretches lie apart by more zeros than are read beyond an end.
        gap = PERIOD + 9
        self.begin = offsets[:-1] + gap * np.arange(len(sizes))
        self.stop = self.begin + sizes
        total = int(self.stop[-1]) + 2 * gap
        text = np.zeros(total, np.uint8)
        text[np.arange(len(raw)) + np.repeat(gap * np.arange(len(sizes)), sizes)] = raw
        self.words = np.zeros(total - 7, np.uint64)  # the eight bytes at each position as a number, highest first
        for k in range(8):
            self.words |= text[k : total - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
        self.rank = self._cover_ranks(total)

    def _cover_ranks(self, total: int) -> np.ndarray:
        """Ranks, from 1, of the suffixes at cover positions; 0 where there is none."""
        row = np.repeat(np.arange(len(self.begin)), self.stop - self.begin)
        at = np.arange(len(row)) - np.repeat(np.cumsum(self.stop - self.begin) - (self.stop - self.begin), self.stop - self.begin) + self.begin[row]
        chosen = np.isin(at % PERIOD, COVER)
        at, left = at[chosen], (self.stop[row] - at)[chosen]
        rank = np.zeros(total, np.int64)
        if not len(at):
            return rank
        # Names of PERIOD bytes; among equal ones padded by zeros, the one whose stretch ends first.
        keys = [np.minimum(left, PERIOD), *(self.words[at + 8 * k] >> np.uint64(8 if k == 3 else 0) for k in (3, 2, 1, 0))]
        order = np.lexsort(keys)
        new = np.zeros(len(at), bool)
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        rank[at[order]] = 1 + np.cumsum(new)
        reach = PERIOD
        while reach < left.max():
            # Positions of the cover stay in it after whole periods, so names double there; past an end there is 0.
            after = np.where(reach < left, rank[np.minimum(at + reach, total - 1)], 0)
            _, name = np.unique(rank[at] * (len(at) + 1) + after, return_inverse=True)
            rank[at] = name + 1
            reach *= 2
        return rank

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Is the suffix at a before the one at b, given that both agree in their first PERIOD - 1 bytes."""
        d = SHIFTS[a % PERIOD, b % PERIOD]
        return self.rank[a + d] < self.rank[b + d]

    def order(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Numbers of the positions ``at`` by group, then in suffix order; a group's agree in PERIOD - 1 bytes.

        Positions of one residue are ordered by the ranks at one shift; these runs are then merged two by two, each
        position finding its place in the other run by bisection, all positions together.
        """
        residue = at % PERIOD
        order = np.lexsort((self.rank[at + SHIFTS[residue, residue]], residue, group))
        new = np.ones(len(at), bool)
        new[1:] = (group[order][1:] != group[order][:-1]) | (residue[order][1:] != residue[order][:-1])
        start = np.flatnonzero(new)
        while True:
            size = np.diff(np.append(start, len(at)))
            of = group[order[start]]
            head = np.append(True, of[1:] != of[:-1])
            nth = np.arange(len(start)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            right = nth % 2 == 1
            left = np.append(right[1:], False)
            if not right.any():
                return order
            run = np.repeat(np.arange(len(start)), size)
            mine = np.flatnonzero((left | right)[run])
            other = run[mine] + np.where(right[run[mine]], -1, 1)
            low, high = start[other].copy(), start[other] + size[other]
            me, goes_right = at[order[mine]], right[run[mine]]
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) // 2
                there = at[order[middle]]
                # Of equal ones, those of the left run come first.
                up = np.where(goes_right[open_], ~self.less(me[open_], there), self.less(there, me[open_]))
                low[open_] = np.where(up, middle + 1, low[open_])
                high[open_] = np.where(up, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            place = np.arange(len(at))
            place[mine] = mine - start[run[mine]] + low - start[other] + np.minimum(start[run[mine]], start[other])
            merged_order = np.empty_like(order)
            merged_order[place] = order
            order, start = merged_order, start[~right]

    def equal(self, a: np.ndarray, b: np.ndarray, begin: int, length: int) -> np.ndarray:
        """Do the bytes from ``begin`` to ``length`` after a and b agree."""
        out = np.ones(len(a), bool)
        for k in [*range(begin, length - 8, 8), length - 8]:
            out &= self.words[a + k] == self.words[b + k]
        return out


def repeated(raw: np.ndarray, offsets: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, offset in it) of windows that an earlier window of their bucket equals.

    Stretches come in the order in which their windows count as earlier.
    """
    block = BlockSort(raw, offsets)
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = block.begin[row] + nth
    keys = [*(block.words[at + 8 * k] for k in (3, 2, 1, 0)), bucket[row]]
    by = np.lexsort(keys)
    new = np.zeros(len(by), bool)
    for k in keys:
        new[1:] |= k[by][1:] != k[by][:-1]
    group = np.cumsum(new)
    tied = np.zeros(len(by), bool)
    tied[1:] = ~new[1:]
    tied[:-1] |= ~new[1:]
    by, group = by[tied], group[tied]
    if not len(by):
        return by, by
    order = block.order(at[by], group)
    by, group = by[order], group[order]
    same = np.append(False, (group[1:] == group[:-1]) & block.equal(at[by[1:]], at[by[:-1]], 4 * 8, length))
    kind = np.cumsum(~same) - 1
    earliest = np.full(kind[-1] + 1, len(at))
    np.minimum.at(earliest, kind, by)
    later = np.sort(by[by != earliest[kind]])
    return row[later], nth[later]


def _sort_blocks(length: int, sort_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (g, doc, th, first); out: intervals covered by windows that occur earlier."""
        held: list[pa.RecordBatch] = []
        size = 0

        def judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            block = rows.combine_chunks().to_batches()
            for b in block:
                raw, offsets = buffer_of(b.column("data"))
                doc, th, first = (b.column(c).to_numpy() for c in ("doc", "th", "first"))
                r, k = repeated(raw, offsets, b.column("g").to_numpy(), length)
                if len(r):
                    d, t, a, z = merged(doc[r], th[r], first[r] + k, first[r] + k + length)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (d, t, a, z)], ["doc", "th", "first", "last"])

        for batch in batches:
            for b in slices(iter([batch]), "data", sort_bytes, "spans"):
                held.append(b)
                size += b.column("data").nbytes
                if size < sort_bytes:
                    continue
                # A bucket goes on as long as its rows arrive: only what precedes the last bucket is complete.
                rows = pa.Table.from_batches(held)
                g = rows.column("g").to_numpy()
                cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
                if cut:
                    yield from judge(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = sum(x.column("data").nbytes for x in held) if cut else size
        if held:
            yield from judge(pa.Table.from_batches(held))

    return run


def _windows(length: int, sort_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each window of hot buckets: two names of 62 bits, and where it starts."""
        for batch in batches:
            for b in slices(iter([batch]), "data", sort_bytes, "spans"):
                raw, offsets = buffer_of(b.column("data"))
                count = np.diff(offsets) - length + 1
                row = np.repeat(np.arange(b.num_rows), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = offsets[:-1][row] + nth
                hashed = SpanHashes(raw)
                one, two = hashed(start, start + length), hashed(start, start + length // 2)
                doc, th, first = (b.column(c).to_numpy() for c in ("doc", "th", "first"))
                columns = (one.view(np.int64), two.view(np.int64), doc[row], th[row], first[row] + nth)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["n1", "n2", "doc", "th", "first"])

    return run


def repeats(docs: DataFrame, length: int, hot: int = HOT, block_bytes: int = BLOCK_BYTES, together: int = TOGETHER, sort_bytes: int = SORT_BYTES, sample: int = SAMPLE) -> DataFrame:
    """(doc, th, first, last): intervals of docs (doc, th, text) to remove; they may overlap."""
    if length < 40:
        raise ValueError("length must be at least 40 bytes")
    often = frequent(docs, length, sample)
    # A frequent bucket is dealt out by stretch; whether it has several is then not asked, its stretches are all fetched.
    by_stretch = F.when(F.col("g").isin(often), F.col("e")) if often else F.lit(None).cast("long")
    seen = scan(docs, length, block_bytes, together).repartition("g", by_stretch).sortWithinPartitions("g", "e", "doc", "th", "place")
    found = materialize(seen.mapInArrow(_settled(length, often), FOUND), "zstd")
    reclaim(docs)
    whole = found.filter("g IS NULL").select("doc", "th", "first", "last")
    need = found.filter("g IS NOT NULL").groupBy("doc", "th").agg(F.collect_list(F.struct("g", "first", "last")).alias("need"))
    texts = docs.filter(F.length("text") > 0).join(need, ["doc", "th"]).dropDuplicates(["doc", "th"])
    kind = "g long, doc long, th long, first long, data binary"
    stretches = materialize(texts.select("doc", "th", "text", "need").mapInArrow(_fetch(length, block_bytes), kind), "zstd")
    reclaim(docs)
    large = stretches.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("g")
    many = large.count()
    some = many > 0
    # At most one for each ``hot`` stretches; they are broadcast while they are few, so that no task gets one's rows.
    large = F.broadcast(large) if many <= LARGE else large
    calm = stretches.join(large, "g", "left_anti") if some else stretches
    ordered = calm.repartition("g").sortWithinPartitions("g", "doc", "th", "first")
    parts = whole.unionByName(ordered.mapInArrow(_sort_blocks(length, sort_bytes), INTERVAL))
    if some:
        windows = materialize(stretches.join(large, "g", "left_semi").mapInArrow(_windows(length, sort_bytes), "n1 long, n2 long, doc long, th long, first long"))
        at = F.struct("doc", "th", "first")
        keyed = windows.withColumn("w", F.struct("n1", "n2")).drop("n1", "n2")
        earliest = materialize(keyed.groupBy("w").agg(F.min(at).alias("least"), F.count("*").alias("n")).filter("n > 1"))
        # Places of a window that many documents share stay where they are.
        later = join_facts(keyed, earliest, "w", windows.count()).filter(at > F.col("least"))
        parts = parts.unionByName(later.select("doc", "th", "first", (F.col("first") + length).alias("last")))
    return parts


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20, "spans"):
            out: list[list] = [[], [], [], [], []]
            for data, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = data or b""
                kept, at, removed, runs, end = [], 0, 0, 0, -1
                for r in sorted((r["first"], r["last"]) for r in spans or ()):
                    if r[0] > end:
                        kept.append(data[at : r[0]])
                        runs += 1
                        removed -= r[0]
                        removed += r[1]
                    elif r[1] > end:
                        removed += r[1] - end
                    end = at = max(end, r[1])
                kept.append(data[at:])
                rest = b"".join(kept)
                for c, v in zip(out, (len(data), removed, runs, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    c.append(v)
            columns = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(out[4], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _keyed(df: DataFrame, doc: str, th: str) -> DataFrame:
    """df with two columns more that tell documents apart."""
    text_hash = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text"))
    return df.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn(th, text_hash)


def _spans(docs: DataFrame, length: int, **sizes) -> DataFrame:
    """(doc, th, spans: intervals to remove, which may overlap)."""
    found = repeats(docs, length, **sizes)
    spans = materialize(found.groupBy("doc", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "zstd")
    reclaim(docs)
    return spans


def deduplicate(df: DataFrame, length: int = 100, with_text: bool = False, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept (binary), a row for each row of df.

    ``sizes`` are those of :func:`repeats`; they bound memory and change no result.
    """
    docs = _keyed(df.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), "doc", "th")
    spans = _spans(docs.select("doc", "th", "text"), length, **sizes)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return docs.join(spans, ["doc", "th"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(with_text), kind)


def cut_texts(df: DataFrame, length: int = 100, **sizes) -> DataFrame:
    """The rows of df with repeats cut out of text; characters of which a part was cut go whole; n_chars follows."""
    doc, th, spans = (f"{n}_{uuid.uuid4().hex}" for n in ("doc", "th", "spans"))
    keyed = _keyed(df, doc, th)
    found = _spans(keyed.select(F.col(doc).alias("doc"), F.col(th).alias("th"), "text"), length, **sizes)
    found = found.withColumnsRenamed({"doc": doc, "th": th, "spans": spans})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20, "spans"):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            kept = []
            for data, cuts in zip(texts, b.column(spans).to_pylist(), strict=True):
                if not cuts:
                    kept.append(data)
                    continue
                parts, at = [], 0
                for first, last in sorted((r["first"], r["last"]) for r in cuts):
                    parts.append(data[at : max(at, first)])
                    at = max(at, last)
                kept.append(b"".join(p.decode("utf-8", "ignore").encode() for p in (*parts, data[at:])))
            text = pa.array(kept, pa.binary()).cast(b.schema.field("text").type)
            b = b.drop_columns([spans])
            b = b.set_column(b.schema.get_field_index("text"), "text", text)
            at = b.schema.get_field_index("n_chars")
            if at >= 0:
                b = b.set_column(at, "n_chars", pc.utf8_length(text).cast(b.schema.field(at).type))
            yield b

    return keyed.join(found, [doc, th], "left").select(*df.columns, spans).mapInArrow(run, df.schema)
