"""Byte-level BPE by corpus-level merge replay.

The distinct pieces (matches of the split pattern) of a block of texts are laid out in one array of token ids with
links to the next and previous token.  An inverted index maps a rank to the positions whose pair merges to it; the
lowest rank is taken from a heap, applied at all its positions at once, and only the touched neighbours are looked up
again.  Pieces never influence each other, so replaying one block gives the ids that replaying the whole corpus would:
blocks bound memory, need no shuffle, and a lost executor costs its own blocks only.

Results: a null text counts as empty; an empty text has no ids.  A text longer than a block is a block by itself, encoded
whole.  Repeated rows get equal results; an empty table gives no rows.  Ties (a pair that occurs repeatedly in a piece, or
pairs of different split with the same merged bytes) go to the leftmost place, as in the usual implementation.
Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, worker_cache

#: Bytes of text in a block, pieces remembered by a worker, and bytes from which a piece is merged by itself.
BLOCK_BYTES, REMEMBERED, LONG = 8 << 20, 800_000, 512
NONE = np.int64(1 << 40)


class MergeReplay:
    """Ranks of a byte-level vocabulary, with the table of all pairs that merge."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.vocabulary[v] = k
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merged pairs; NONE where a pair does not merge or b is no token (-1)."""
        key = np.where(b < 0, -1, a << 20 | b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each piece, as packed little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = np.array(self.encode_long(w), "<u4").tobytes()
            elif w:
                short.append(i)
        if short:
            for i, ids in zip(short, self._replay([words[i] for i in short]), strict=True):
                out[i] = ids
        return out

    def _replay(self, words: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(raw), np.cumsum(lengths)
        # One slot more at the end, holding no token (-1), stands for "no neighbour".
        token = np.append(self.first[raw], -1)
        word = np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n
        before[np.append(0, ends[:-1])] = n
        after, before = np.append(after, n), np.append(before, n)
        rank = np.append(self.lookup(token[:n], token[after[:n]]), NONE)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(positions: np.ndarray, ranks: np.ndarray) -> None:
            some = ranks != NONE
            positions, ranks = positions[some], ranks[some]
            if not len(positions):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        put(np.arange(n), rank[:n])
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # In each word only the leftmost place merges now: it may give rise to a lower rank further on.
            of = word[at]
            lead = np.append(True, of[1:] != of[:-1])
            if not lead.all():
                index[r] = [at[~lead]]
                heapq.heappush(heap, r)
                at = at[lead]
            gone = after[at]
            token[at] = r
            rank[gone] = NONE
            nxt = after[gone]
            after[at] = nxt
            before[nxt] = at
            prev = before[at]
            rank[at] = self.lookup(token[at], token[nxt])
            has = prev[prev != n]
            rank[has] = self.lookup(token[has], token[after[has]])
            touched = np.concatenate([at, has])
            put(touched, rank[touched])
        alive = np.ones(n, bool)
        # What was merged away is reached by no link.
        alive[:] = False
        starts = np.append(0, ends[:-1])
        live = starts
        while len(live):
            alive[live] = True
            live = after[live]
            live = live[live != n]
        ids = token[:n][alive].astype("<u4").tobytes()
        counts = np.add.reduceat(alive.astype(np.int64), starts)
        stops = np.cumsum(counts) * 4
        return [ids[a:b] for a, b in zip((stops - counts * 4).tolist(), stops.tolist(), strict=True)]

    def encode_long(self, word: bytes) -> list[int]:
        """The same replay over one long piece, its index a heap of (rank, position): n log n steps."""
        token = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(token)
        after, before, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(token[i] << 20 | token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if token[i] < 0 or j >= n or pairs.get(token[i] << 20 | token[j]) != r:
                continue
            token[i], token[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := pairs.get(r << 20 | token[k])) is not None:
                    heapq.heappush(heap, (s, i))
            h = before[i]
            if h >= 0 and (s := pairs.get(token[h] << 20 | r)) is not None:
                heapq.heappush(heap, (s, h))
        return [t for t in token if t >= 0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], tuple[MergeReplay, regex.Pattern, dict[str, bytes]]] = worker_cache("byte_bpe")


def _loaded(path: str, pattern: str) -> tuple[MergeReplay, regex.Pattern, dict[str, bytes]]:
    """A worker keeps its tables and the pieces that it met; the latter are bounded by REMEMBERED."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = (MergeReplay(path), regex.compile(pattern), {})
    return _LOADED[path, pattern]


def _encoded(texts: list[str | None], path: str, pattern: str) -> list[bytes]:
    engine, split, known = _loaded(path, pattern)
    if len(known) > REMEMBERED:
        known.clear()
    pieces = [split.findall(t) if t else [] for t in texts]
    fresh = set()
    for p in pieces:
        fresh.update(p)
    new = [w for w in fresh if w not in known]
    known.update(zip(new, engine.encode_words([w.encode() for w in new]), strict=True))
    return [b"".join(map(known.__getitem__, p)) for p in pieces]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, ids binary: packed little-endian unsigned 32-bit integers) of every whole text; one row for each row of df."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", block_bytes, "byte_bpe"):
            ids = _encoded(b.column("text").to_pylist(), path, pattern)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    named = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return named.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, data binary) from what :func:`encode` returns."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _loaded(path, ".")[0]
        for b in slices(batches, "ids", BLOCK_BYTES, "byte_bpe"):
            data = [engine.decode(x or b"") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(data, pa.binary())], ["id", "data"])

    return df.selectExpr(f"`{id_col}` AS id", "ids").mapInArrow(run, f"id {kind}, data binary").withColumnRenamed("id", id_col)


def round_trip_digest(df: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Query op5: (doc_id, n_tokens, ids_sha256, decoded_sha256), encoding and decoding block by block in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", block_bytes, "byte_bpe"):
            ids = _encoded(b.column("text").to_pylist(), path, pattern)
            engine = _loaded(path, pattern)[0]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(engine.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, out)
