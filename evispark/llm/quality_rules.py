"""Quality rules: gradient-boosted trees over document statistics.

Statistics are counted over whole texts, all documents of a block at once.  The trees are grown on a bounded sample of
labelled documents (``max_labelled``), by histograms, with logistic loss; features may be declared monotone, which
holds by refusing splits in the wrong direction and by bounding what stands below an accepted one.  A grown ensemble is
flattened into node arrays, so scoring is a fixed number of array steps for all documents together.

Results: a null, empty or blank text has no words and fails the base rule; its verdict is false.  Repeated rows get
equal results.  With no labelled rows, or labels of one kind only, every document that passes the base rule is kept.
A text longer than a block is a block by itself, counted whole.  An empty table gives no rows.  Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, buffer_of, numbered, pieces_of, slices, word_spans, words_of

#: Bytes of text in a block, unless a caller says otherwise.
BLOCK_BYTES = 2 << 20
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?;:,")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the trees, with the direction in which the score may move: -1 never up, 1 never down, 0 either.
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "digit_share": 0, "upper_share": 0, "stop_share": 0}


def _within(counted: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many true entries lie between consecutive offsets."""
    total = np.append(0, np.cumsum(counted, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: does its value (a number) occur twice or more in its document, and did it earlier there."""
    key = doc * (int(value.max(initial=0)) + 1) + value
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    more, earlier = np.zeros(len(key), bool), np.zeros(len(key), bool)
    more[order[1:][same]] = True
    more[order[:-1][same]] = True
    earlier[order[1:][same]] = True
    return more, earlier


def statistics(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each document of a block of UTF-8 bytes."""
    n = len(offsets) - 1
    start, end, doc = word_spans(raw, offsets)
    out = {"n_words": np.bincount(doc, minlength=n).astype(np.int64)}
    out["word_chars"] = _within(~SPACE[raw] & ((raw & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _within(SYMBOL[raw], offsets)
    repeat = np.zeros(n, np.int64)
    if len(start) >= 3:
        # Words, pairs and triples are numbered by what they are, so different ones never count as equal.
        word, _ = numbered(words_of(raw, start, end))
        pair, _ = numbered(pa.array(word[:-1] * len(word) + word[1:]))
        gram, _ = numbered(pa.array(pair[:-1] * len(word) + word[2:]))
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        more, _ = _repeated(doc[inside], gram[inside])
        covered = np.zeros(len(start), bool)
        at = inside[more]
        for k in range(3):
            covered[at + k] = True
        repeat = np.bincount(doc[covered], minlength=n).astype(np.int64)
    out["n_repeat_words"] = repeat
    # Lines end at \n or with their document; those with a word count.
    newline = np.flatnonzero(raw == 0x0A)
    line_end = np.sort(np.concatenate([newline, offsets[1:]]))
    line_start = np.sort(np.concatenate([newline + 1, offsets[:-1]]))
    words_until = np.append(0, np.cumsum(~SPACE[raw], dtype=np.int64))
    full = words_until[line_end] > words_until[line_start]
    line, _ = numbered(pieces_of(raw[raw != 0x0A], line_end - line_start))
    line_doc = np.searchsorted(offsets, line_start[full], side="right") - 1
    _, earlier = _repeated(line_doc, line[full])
    out["n_lines"] = np.bincount(line_doc, minlength=n).astype(np.int64)
    out["n_dup_lines"] = np.bincount(line_doc[earlier], minlength=n).astype(np.int64)
    for name, kind in (("digits", DIGIT), ("uppers", UPPER), ("stops", STOP)):
        out[name] = _within(kind[raw], offsets)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    columns = [np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / words]
    return np.stack([*columns, *(s[k] / chars for k in ("digits", "uppers", "stops"))], 1)


@dataclass
class Trees:
    """Complete trees of one depth in node arrays: node i of a tree has the children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for labels y in {0, 1}; ``least`` is the smallest Hessian sum of a leaf."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    cell = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    rate0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(rate0 / (1 - rate0)))
    margin = np.full(len(y), base)
    inner = (1 << depth) - 1
    all_f, all_t, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            low[2 * k + 1], low[2 * k + 2] = low[k], low[k]
            high[2 * k + 1], high[2 * k + 2] = high[k], high[k]
            mine = np.flatnonzero(node == k)
            best = (1e-6, None)
            for j, e in enumerate(edges):
                if not len(e) or not len(mine):
                    continue
                gs = np.cumsum(np.bincount(cell[mine, j], g[mine], len(e) + 1))
                hs = np.cumsum(np.bincount(cell[mine, j], h[mine], len(e) + 1))
                gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                left = np.clip(-gl / (hl + ridge), low[k], high[k])
                right = np.clip(-gr / (hr + ridge), low[k], high[k])
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
                gain[(hl < least) | (hr < least) | (monotone[j] * (right - left) < 0)] = 0
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), (j, i, float(left[i] + right[i]) / 2))
            if best[1] is not None:
                j, i, middle = best[1]
                f[k], t[k] = j, edges[j][i]
                if monotone[j]:
                    up, down = (2 * k + 2, 2 * k + 1) if monotone[j] > 0 else (2 * k + 1, 2 * k + 2)
                    low[up], high[down] = max(low[up], middle), min(high[down], middle)
            node[mine] = 2 * k + 1 + (x[mine, f[k]] > t[k])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        v = rate * np.clip(-gs / (hs + ridge), low[inner:], high[inner:])
        margin += v[leaf]
        all_f.append(f)
        all_t.append(t)
        all_v.append(v)
    return Trees(np.array(all_f), np.array(all_t), np.array(all_v), base, depth)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>"


def measured(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, the five counts and the features x of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", block_bytes):
            s = statistics(*buffer_of(b.column("text")))
            x = features(s)
            flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(s[c]) for c in COUNTS), flat], ["doc_id", *COUNTS, "x"])

    return df.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, SCHEMA)


def fit(df: DataFrame, labels: DataFrame, max_labelled: int = 5000) -> Trees | None:
    """Trees from at most ``max_labelled`` labelled documents, those of the smallest hashed ids; None if they can't be grown.

    Of rows that repeat a doc_id the one of the smallest features counts.
    """
    chosen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    quality = {r["doc_id"]: r["quality"] for r in chosen.collect()}
    if not quality:
        return None
    marked = df.sparkSession.createDataFrame(list(quality.items()), "doc_id long, quality int")
    rows = measured(df.join(F.broadcast(marked), "doc_id", "left_semi").select("doc_id", "text")).groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    y = np.array([float(quality[r["doc_id"]] > 0) for r in rows])
    if len(set(y)) < 2:
        return None
    return grow(np.array([r["x"] for r in rows]), y, list(FEATURES.values()))


def judge(df: DataFrame, labels: DataFrame, max_labelled: int = 5000, threshold: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, the five counts, base_failed, score double and kept, a row for each row of df."""
    trees = fit(df, labels, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", block_bytes):
            s = statistics(*buffer_of(b.column("text")))
            failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            score = trees.score(features(s)) if trees else np.ones(len(failed))
            kept = ~failed & (score >= threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(s[c]) for c in COUNTS), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    schema = ", ".join(f"{c} long" for c in ["doc_id", *COUNTS]) + ", base_failed boolean, kept boolean, score double"
    return df.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, schema)
