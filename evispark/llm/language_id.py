"""Language identification by cross-parsing entropy.

A suffix automaton is built from a bounded sample of labelled text per language.  A text is parsed against each
automaton into longest matches: a phrase ends where the next symbol would make it occur nowhere in the sample.  The
language needing the fewest phrases, normalised by the text's symbols, wins.  An automaton is flattened into one array
(state, symbol) -> next state, in which a missing move already holds the restart from the root and a mark that a phrase
ended.  Whole texts are cut into windows that a block parses side by side, one array step for each position; windows are
then parsed again from where the one before really ended, until they meet the states seen first, so the parse of a text
is the one from its first symbol to its last.

Symbols are the bytes of the lower-cased text; digits, punctuation and white space of any kind are one symbol each, and
repeated ones collapse.

Results: ``und`` with score 0 if the text is null or has no letter; also if nothing could be learned.  Equal numbers of
phrases go to the language that comes first in order.  Repeated rows get equal results; an empty table gives no rows.
Languages null in training are not learned; all others are, however many or rare.  A text longer than a block is a block
by itself.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buffer_of, slices

#: Labelled documents and symbols of each language that are learned from at most.
MAX_DOCS, MAX_SYMBOLS = 60, 20_000
#: Symbols of a window, rounds in which windows are put right side by side, and bytes of text in a block.
WINDOW, ROUNDS, BLOCK_BYTES = 256, 4, 4 << 20
#: Symbols below which a text is too short to be held against a language's limit.
SHORT = 100
UNKNOWN = "und"


def _classes() -> np.ndarray:
    """Byte -> symbol: 0 for what is not a letter, 1 for digits, then a-z, then each byte of a multi-byte character."""
    out = np.zeros(256, np.uint8)
    out[0x30:0x3A] = 1
    out[0x61:0x7B] = np.arange(2, 28)
    out[0x41:0x5B] = np.arange(2, 28)
    out[0x80:] = np.arange(28, 28 + 128)
    return out


CLASS = _classes()
SYMBOLS = 28 + 128


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a block of lower-cased texts, with runs of non-letters or of digits collapsed, and their offsets."""
    s = CLASS[raw]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 1) | (s[1:] != s[:-1])
    starts = offsets[:-1][offsets[:-1] < len(s)]
    keep[starts] = True
    return s[keep], np.append(0, np.cumsum(keep))[offsets]


def automaton(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix automaton of a symbol sequence as (moves of each state, -1 if none), symbols used being numbered."""
    used = np.unique(text)
    code = {int(s): i for i, s in enumerate(used)}
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in text.tolist():
        c = code[s]
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(moves), len(used)), -1, np.int32)
    for state, m in enumerate(moves):
        for c, t in m.items():
            table[state, c] = t
    return used, table


class CrossParser:
    """Automata of several languages, flattened for parsing windows side by side.

    ``limits`` are phrases for each symbol from which a text is none of the language (see :func:`learn`).
    """

    def __init__(self, samples: dict[str, np.ndarray], window: int = WINDOW) -> None:
        self.languages, self.window = sorted(samples), window
        self.limits = np.full(len(samples), np.inf)
        self.code, self.width, self.table = [], [], []
        for name in self.languages:
            used, moves = automaton(samples[name])
            width = len(used) + 1  # the last column: a symbol that the sample lacks is a phrase by itself
            code = np.full(SYMBOLS, len(used), np.uint8)
            code[used] = np.arange(len(used))
            # One state more: after a symbol that the sample lacks, whatever follows begins a phrase.
            alone = len(moves)
            root = np.append(moves[0], alone)
            full = np.concatenate([np.concatenate([moves, np.full((alone, 1), -1, np.int32)], 1), np.full((1, width), -1, np.int32)])
            ended = full < 0
            ended[0] = False
            full = np.where(full < 0, root[None, :], full)
            self.code.append(code)
            self.width.append(width)
            # An entry is the next state's row start, doubled, plus 1 if a phrase ended before this symbol.
            self.table.append((full.astype(np.int64) * width * 2 + ended).astype(np.int32).ravel())

    def phrases(self, s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases (texts, languages) that parse each text."""
        sizes = np.diff(offsets)
        counts = -(-sizes // self.window)
        doc = np.repeat(np.arange(len(sizes)), counts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = offsets[:-1][doc] + nth * self.window
        size = np.minimum(sizes[doc] - nth * self.window, self.window)
        order = np.argsort(-size, kind="stable")
        at = np.empty_like(order)
        at[order] = np.arange(len(order))
        # The window before each one, in the order of sizes; only full ones have a next.
        before = np.where(nth > 0, at[np.maximum(np.arange(len(doc)) - 1, 0)], -1)[order]
        begin, size, doc = begin[order], size[order], doc[order]
        active = np.searchsorted(-size, -np.arange(self.window), side="left")  # windows longer than each position
        out = np.zeros((len(sizes), len(self.languages)))
        for j, (code, table) in enumerate(zip(self.code, self.table, strict=True)):
            out[:, j] = self._parse(code[s], table, begin, size, doc, before, active, offsets)
        return out

    def _parse(self, coded, table, begin, size, doc, before, active, offsets) -> np.ndarray:
        state, ends = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int64)
        seen = []
        for k in range(self.window):
            n = int(active[k])
            if not n:
                break
            step = table[state[:n] + coded[begin[:n] + k]]
            ends[:n] += step & 1
            state[:n] = step >> 1
            seen.append(step)
        follow, began = np.flatnonzero(before >= 0), np.zeros(len(begin), np.int32)
        for _ in range(ROUNDS):
            moved = follow[state[before[follow]] != began[follow]]
            if not len(moved):
                break
            began[moved] = state[before[moved]]
            final = self._again(coded, table, begin, size, moved, began[moved], ends, seen)
            state[moved] = final
        moved = follow[state[before[follow]] != began[follow]]
        texts = np.bincount(doc, ends, len(offsets) - 1) + (np.diff(offsets) > 0)
        # Text that never falls back into step, such as one letter over and over, is parsed symbol by symbol.
        for d in np.unique(doc[moved]).tolist():
            texts[d] = self._one(coded[offsets[d] : offsets[d + 1]].tobytes(), table)
        return texts

    @staticmethod
    def _again(coded, table, begin, size, rows, state, ends, seen) -> np.ndarray:
        """Parse windows from other states until they meet those seen; marks and states seen are replaced.

        Returns the states in which the windows end.
        """
        final, mine, k = np.empty(len(rows), np.int32), np.arange(len(rows)), 0
        last = size[rows] - 1
        while len(mine):
            row = rows[mine]
            step, old = table[state + coded[begin[row] + k]], seen[k][row]
            ends[row] += (step & 1) - (old & 1)
            seen[k][row] = step
            state = step >> 1
            met, over = state == old >> 1, last[mine] == k
            for m in np.flatnonzero(met & ~over).tolist():
                final[mine[m]] = seen[last[mine[m]]][row[m]] >> 1
            final[mine[over]] = state[over]
            go = ~met & ~over
            mine, state, k = mine[go], state[go], k + 1
        return final

    @staticmethod
    def _one(coded: bytes, table: np.ndarray) -> int:
        moves, state, n = memoryview(table), 0, 1
        for c in coded:
            step = moves[state + c]
            n += step & 1
            state = step >> 1
        return n

    def needs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases for each symbol of texts in languages, symbols of texts, whether texts have a letter)."""
        raw, offsets = buffer_of(pa.array([t.lower() if t else "" for t in texts], pa.large_string()))
        s, at = symbols(raw, offsets)
        n = np.diff(at)
        plain = np.append(0, np.cumsum((s > 1) & (s < 28)))
        letters = np.array([bool(a) or bool(t and any(map(str.isalpha, t))) for a, t in zip(plain[at[1:]] > plain[at[:-1]], texts, strict=True)], bool)
        return self.phrases(s, at) / np.maximum(n, 1)[:, None], n, letters

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, whether it is text of that language) of each text.

        The score is how far the winner's phrases stay below the runner-up's.
        """
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        need, n, letters = self.needs(texts)
        best = need.argmin(1) if len(texts) else np.zeros(0, np.int64)
        ranked = np.sort(need, 1)
        score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12) if need.shape[1] > 1 else np.ones(len(texts))
        names = [self.languages[b] if a else UNKNOWN for a, b in zip(letters.tolist(), best.tolist(), strict=True)]
        inside = letters & ((n < SHORT) | (need[np.arange(len(best)), best] <= self.limits[best]))
        return names, np.clip(np.where(letters, score, 0.0), 0, 1), inside


def held_out(doc_id: Column) -> Column:
    """The share of documents that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(df: DataFrame, max_docs: int = MAX_DOCS, max_symbols: int = MAX_SYMBOLS) -> CrossParser:
    """Samples of each language: documents in order of a hash of their id, until ``max_symbols`` are reached.

    At most ``max_docs`` documents a language, and no more of a document than fills a sample, come to the driver.  What
    the sample leaves of them sets the language's limit: three quarters of the way from the phrases for each symbol that
    they need to those that the sample's symbols need in random order.
    """
    open_ = df.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # Spark keeps only the first max_docs rows of each language before it shuffles.
    ranked = open_.select("lang", "doc_id").withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= max_docs)
    chosen = F.broadcast(ranked.groupBy("lang", "doc_id").agg(F.min("rank").alias("rank")))  # max_docs a language
    # Digits and blanks collapse, so a sample may need more characters than symbols; of rows that repeat an id one counts.
    cut = F.substring("text", 1, 4 * max_symbols)
    rows = open_.select("lang", "doc_id", cut.alias("text")).join(chosen, ["lang", "doc_id"]).groupBy("lang", "doc_id", "rank").agg(F.min("text").alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        texts.setdefault(r["lang"], []).append(r["text"].lower())
    samples, spare = {}, {}
    for name, own in texts.items():
        s, at = symbols(*buffer_of(pa.array(own, pa.large_string())))
        k = min(int(np.searchsorted(at, max_symbols)), len(at) - 1)
        samples[name], spare[name] = s[: min(int(at[k]), 2 * max_symbols)], own[k:]
    parser = CrossParser(samples)
    for j, name in enumerate(parser.languages):
        mixed = np.random.default_rng(7).permutation(samples[name])
        chance = parser.phrases(mixed, np.array([0, len(mixed)]))[0, j] / max(len(mixed), 1)
        need, n, _ = parser.needs(spare[name])
        if (n >= SHORT).any():
            usual = np.median(need[n >= SHORT, j])
            parser.limits[j] = usual + 0.75 * (chance - usual)
    return parser


def predict(df: DataFrame, parser: CrossParser, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang_pred, score, a row for each row of df."""
    shared = df.sparkSession.sparkContext.broadcast(parser)  # bounded: languages times symbols learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", block_bytes):
            names, score, _ = shared.value.judge(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return df.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(df: DataFrame, parser: CrossParser, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of df whose text is in a learned language, with all their columns; lang becomes the language found.

    Texts without a letter go, and those which need more phrases than the limit of the language that needs the fewest:
    letters in no language's order.  Null doc_ids and repeated rows are judged like others.
    """
    shared = df.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", block_bytes):
            names, _, inside = shared.value.judge(b.column("text").to_pylist())
            at = b.schema.get_field_index("lang")
            yield b.set_column(at, b.schema.field(at), pa.array(names, b.schema.field(at).type)).filter(pa.array(inside))

    return df.mapInArrow(run, df.schema)
