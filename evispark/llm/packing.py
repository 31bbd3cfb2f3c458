"""Packing along a space-filling curve.

Each document's token ids are hashed to a count vector and projected to few dimensions; the Hilbert index of that point
is its key.  Documents are range-sorted by (key, id), laid end to end along the curve and cut every ``length`` ids, so
neighbours on the curve share sequences.  Only the last, short stretch is left over; it is cut into powers of two, so
nothing is padded.  Sorting and offsets run over a narrow table (ids stay behind); one join brings offsets to ids.

Results: a null or empty text is the end id alone.  Documents with equal keys follow in order of id; repeated rows are
packed as often as they occur.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, materialize, numbered, slices, word_spans, words_of, worker_cache

#: Hashed features, dimensions of the curve and bits in each.
FEATURES, DIMENSIONS, BITS = 256, 4, 12
#: Bytes of text in a block, and pieces and chunks remembered by a worker.
BLOCK_BYTES, REMEMBERED, REMEMBERED_CHUNKS = 2 << 20, 400_000, 600_000
#: How the vocabulary's own rules split lower-cased text without white space.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: Chunks of these characters need no normalisation but lower case, and each lower-cases by itself.
LATIN = re.compile(r"[\x21-\x7e\u00a1-\u00ff\u0100-\u012f\u0131-\u017f]*")
#: ASCII letters, and signs that part from letters whatever stands around them: no apostrophe, nothing of special tokens.
LETTER, SIGN = np.zeros(256, bool), np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
SIGN[list(b'.,;:!?()"-')] = True
#: Bytes from which the library merges a piece.
LONG = 48
NONE = np.int64(1 << 40)


class WordTokenizer:
    """Ids of texts by a tokenizer file (BPE with word ends) whose splitting never looks across white space.

    Texts are put together from remembered chunks (runs between ASCII white space, cut where a letter meets one of the
    signs that always part from it); a chunk from remembered pieces.
    New pieces are merged together: in each round every piece applies its lowest-ranked pair.  Chunks beyond the Latin
    range, those that may hold a special token, and long pieces are given to the library whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, remembered_chunks: int = REMEMBERED_CHUNKS) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.remembered, self.remembered_chunks = remembered, remembered_chunks
        self.pieces: dict[str, bytes] = {}
        self.forget_chunks()
        model = json.loads(self.library.to_str())["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        pairs = sorted((vocab[x] << 20 | vocab[y], r, vocab[x + y]) for r, (x, y) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]))
        keys, ranks, merged = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self.keys, self.ranks = keys, ranks
        self.merged = np.zeros(len(ranks), np.int64)
        self.merged[ranks] = merged

    def forget_chunks(self) -> None:
        """Remembered chunks: a number for each, where in the pool the ids of a number lie, and the pool."""
        self.known: dict[bytes, int] = {}
        self.at, self.pool = np.zeros((0, 2), np.int64), np.zeros(0, np.uint32)

    def _library(self, words: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of pieces (not empty), all merged round by round."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        token = self.inner[raw]
        token[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(token), NONE)
        pair = np.flatnonzero(word[1:] == word[:-1])
        rank[pair] = self._rank(token[pair], token[pair + 1])
        done_tokens, done_words = [], []
        while len(token):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(token)))
            still = np.repeat(low != NONE, length)
            if not still.all():
                done_tokens.append(token[~still])
                done_words.append(word[~still])
                token, word, rank = token[still], word[still], rank[still]
                length, low = length[low != NONE], low[low != NONE]
                if not len(token):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, length))
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
            token[hit] = self.merged[low]
            keep = np.ones(len(token), bool)
            keep[hit + 1] = False
            shift = np.arange(len(hit))
            token, word, rank = token[keep], word[keep], rank[keep]
            hit = hit - shift
            for at in (hit, hit[hit > 0] - 1):
                rank[at] = NONE
                at = at[at + 1 < len(token)]
                at = at[word[at] == word[at + 1]]
                rank[at] = self._rank(token[at], token[at + 1])
        token, word = np.concatenate(done_tokens), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        packed = token[order].astype("<u4").tobytes()
        stops = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def encode_chunks(self, words: list[bytes]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of distinct chunks."""
        pieces = self.pieces
        if len(pieces) > self.remembered:
            pieces.clear()
        single, split, whole, need = {}, {}, [], set()
        for w in words:
            if w.isalpha():  # ASCII letters are one piece
                single[w] = w.decode("ascii").lower()
                continue
            t = w.decode()
            if "<|" in t or not LATIN.fullmatch(t):
                whole.append(t)
            elif t.isalpha():
                single[w] = t.lower()
            else:
                split[w] = parts = (ASCII_PIECES if w.isascii() else PIECES).findall(t.lower())
                need.update(parts)
        need.update(single.values())
        missing = [p for p in need if p not in pieces]
        raw = [p.encode() for p in missing]
        short = [i for i, r in enumerate(raw) if len(r) <= LONG]
        if short:
            pieces.update(zip([missing[i] for i in short], self._merge([raw[i] for i in short]), strict=True))
        long = [missing[i] for i, r in enumerate(raw) if len(r) > LONG]
        pieces.update(zip(long, self._library(long), strict=True))
        found = dict(zip(single, map(pieces.__getitem__, single.values()), strict=True))
        found.update((w, b"".join([pieces[p] for p in x])) for w, x in split.items())
        found.update(zip([t.encode() for t in whole], self._library(whole), strict=True))
        return [found[w] for w in words]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block, ids of each text); texts lie in ``raw`` between ``offsets``."""
        start, end, doc = word_spans(raw, offsets)
        cut = 1 + np.flatnonzero((LETTER[raw[:-1]] & SIGN[raw[1:]]) | (SIGN[raw[:-1]] & LETTER[raw[1:]]))
        # Where a text begins a chunk does already.
        cut = cut[~np.isin(cut, offsets)]
        start, end = (np.sort(np.concatenate([x, cut])) for x in (start, end))
        doc = np.searchsorted(offsets, start, side="right") - 1
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        which, distinct = numbered(words_of(raw, start, end))
        chunks = distinct.to_numpy(zero_copy_only=False)  # bytes objects
        if len(self.known) > self.remembered_chunks:
            self.forget_chunks()
        number = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            new = chunks[unknown].tolist()
            ids = self.encode_chunks(new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            begin = len(self.pool) + np.cumsum(sizes) - sizes
            number[unknown] = np.arange(len(self.at), len(self.at) + len(new))
            self.known.update(zip(new, number[unknown].tolist(), strict=True))
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
            self.at = np.concatenate([self.at, np.stack([begin, sizes], 1)])
        begin, sizes = self.at[number[which]].T
        stop = np.cumsum(sizes)
        ids = self.pool[np.repeat(begin - (stop - sizes), sizes) + np.arange(stop[-1])]
        return ids, np.bincount(doc, weights=sizes, minlength=len(offsets) - 1).astype(np.int64)


_LOADED: dict[str, WordTokenizer] = worker_cache("packing")


def _loaded(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of points of unsigned integers (n, d) with ``bits`` bits in each coordinate.

    Coordinates are Gray-decoded along the curve from the highest bit down; the transposed bits are then interleaved.
    """
    x = points.astype(np.int64).copy()
    d = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(11).normal(size=(FEATURES, DIMENSIONS))


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given as id arrays."""
    counts = np.zeros((len(ids), FEATURES))
    for i, x in enumerate(ids):
        hashed = (x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
        counts[i] = np.bincount(hashed, minlength=FEATURES)
    weight = np.sqrt(counts)
    weight /= np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-12)
    unit = 0.5 + 0.5 * np.tanh(weight @ _projection())
    return hilbert_key(np.minimum(unit * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)


def tokenize(df: DataFrame, path: str, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, hkey long, n long, ids binary of little-endian unsigned 32-bit ids with end_id last), a row for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _loaded(path)
        # Two bytes an id hold any vocabulary of this size; larger ones keep four.
        kind = np.dtype("<u2" if tokenizer.size <= 1 << 16 else "<u4")
        for b in slices(batches, "text", block_bytes, "packing"):
            ids, counts = tokenizer.encode(*buffer_of(b.column("text")))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            stops = np.cumsum(counts + 1)
            keys = curve_keys(np.split(ids, stops[:-1]))
            data = pa.py_buffer(ids.astype(kind).tobytes())
            where = pa.py_buffer((np.append(0, stops) * kind.itemsize).astype(np.int32).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, where, data])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys), pa.array(counts + 1), packed], ["doc_id", "hkey", "n", "ids"])

    named = df.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return named.mapInArrow(run, "doc_id long, hkey long, n long, ids binary")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column("n").to_numpy()
        end = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(np.full(len(n), part, np.int32)), pa.array(end - n), b.column("n")], ["uid", "part", "local", "n"])
        at = int(end[-1]) if len(end) else at


def sequence_bounds(total: int, length: int) -> tuple[int, np.ndarray]:
    """(full sequences, starts of the powers of two that hold the rest, with the end)."""
    full, rest = divmod(total, length)
    sizes = [1 << b for b in range(length.bit_length(), -1, -1) if rest >> b & 1]
    return full, full * length + np.cumsum([0, *sizes])


def cut(start: int, n: int, length: int, full: int, tail: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Pieces (from, ids, sequence, offset) of a document that lies at ``start`` in the stream."""
    out, at, end = [], start, start + n
    while at < end:
        if at < full * length:
            seq, lo, hi = at // length, at // length * length, (at // length + 1) * length
        else:
            k = int(np.searchsorted(tail, at, side="right")) - 1
            seq, lo, hi = full + k, int(tail[k]), int(tail[k + 1])
        stop = min(end, hi)
        out.append((at - start, stop - at, seq, at - lo))
        at = stop
    return out


def pack(df: DataFrame, path: str, length: int = 4096, end_id: int = 2, with_ids: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids (binary)."""
    spark = df.sparkSession
    tokens = materialize(tokenize(df, path, end_id, block_bytes).withColumn("uid", F.monotonically_increasing_id()), "zstd")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = tokens.select("uid", "hkey", "doc_id", "n").repartitionByRange(parts, "hkey", "doc_id", "uid")
    narrow = narrow.sortWithinPartitions("hkey", "doc_id", "uid").select("uid", "n")
    placed = materialize(narrow.mapInArrow(_running, "uid long, part int, local long, n long"))
    # One row for each partition comes to the driver.
    totals = sorted(placed.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, at = [], 0
    for r in totals:
        base.append((r["part"], at))
        at += r["n"]
    full, tail = sequence_bounds(at, length)
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    where = placed.join(bases, "part").select("uid", (F.col("base") + F.col("local")).alias("at"))
    width = "<u2" if _loaded(path).size <= 1 << 16 else "<u4"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ids", block_bytes):
            rows, parts = [], []
            for doc, at, raw in zip(b.column("doc_id").to_pylist(), b.column("at").to_pylist(), b.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, width).astype("<u4")
                for a, n, seq, off in cut(at, len(ids), length, full, tail):
                    piece = ids[a : a + n].tobytes()
                    rows.append((doc, a, n, zlib.crc32(piece), len(ids), seq, off))
                    if with_ids:
                        parts.append(piece)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(parts, pa.binary())] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    schema = ", ".join(f"{x} long" for x in names) + (", ids binary" if with_ids else "")
    return tokens.select("uid", "doc_id", "ids").join(where, "uid").select("doc_id", "at", "ids").mapInArrow(run, schema)
