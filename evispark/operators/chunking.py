"""Table functions that cut texts and block lists into prompt chunks, for lateral joins: a row for each chunk, no arrays.

A chunk keeps within a budget of tokens (an ASCII character counts a quarter, others one).  Paragraphs are packed in order,
one beyond the budget is cut at sentence ends, and a sentence beyond it hard, by as many characters as the text's mix of
letters allows for, so that a stretch of wide letters may have more tokens; blocks are packed whole where they fit.  Each
chunk may carry the end of the one before and the beginning of the next.

Results: null and empty texts give no chunk; empty blocks are passed over, as are indices that the list has not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens kept free in each chunk, and what stands before a neighbour's text.
MARGIN = 20
PREVIOUS, NEXT = "\n\n--- PREVIOUS CONTEXT ---\n", "\n\n--- NEXT CONTEXT ---\n"

SENTENCE_END = re.compile(r"(?<=[。！？.!?])\s+")
PARAGRAPH_END = re.compile(r"\n\s*\n")


def tokens(text: str) -> int:
    plain = sum(c.isascii() for c in text)
    return int(plain / 4 + len(text) - plain)


class Budget:
    """What a chunk may hold: tokens, and characters by the share of letters that count whole."""

    def __init__(self, text: str, most: int) -> None:
        self.most = max(1, most)
        wide = sum(not c.isascii() for c in text) / (len(text) or 1)
        self.chars = int(self.most * (4.0 - wide * 2.8))

    def fits(self, text: str) -> bool:
        return len(text) <= self.chars and tokens(text) <= self.most

    def pieces(self, paragraph: str) -> Iterator[str]:
        """A paragraph, or runs of its sentences, or stretches of a sentence."""
        if self.fits(paragraph):
            yield paragraph
            return
        held = ""
        for sentence in filter(None, SENTENCE_END.split(paragraph.strip())):
            joined = f"{held} {sentence}" if held else sentence
            if self.fits(joined):
                held = joined
                continue
            if held:
                yield held
            held = sentence if self.fits(sentence) else ""
            if not held:
                size = max(1, self.chars)
                for at in range(0, len(sentence), size):
                    yield sentence[at : at + size].strip()
        if held:
            yield held


def segments(text: str, most: int) -> list[str]:
    """Chunks of a text within ``most`` tokens, the margin included."""
    budget = Budget(text, most - MARGIN)
    out: list[str] = []
    held = ""
    for paragraph in filter(None, (p.strip() for p in PARAGRAPH_END.split(text))):
        for piece in budget.pieces(paragraph):
            joined = f"{held}\n\n{piece}" if held else piece
            if held and not budget.fits(joined):
                out.append(held)
                joined = piece
            held = joined
    return [*out, held] if held else out


def packed(blocks: list[tuple[int, str]], most: int) -> list[tuple[str, list[int]]]:
    """(text, block indices) of chunks of whole blocks; a block beyond the budget is cut and goes on by pieces."""
    limit = max(1, most - MARGIN)
    out: list[tuple[str, list[int]]] = []
    held: list[tuple[int, str]] = []
    for index, body in blocks:
        for piece in [body] if tokens(body) <= limit else segments(body, limit):
            joined = "\n\n".join([t for _, t in held] + [piece])
            if held and tokens(joined) > limit:
                out.append(("\n\n".join(t for _, t in held), [i for i, _ in held]))
                held = []
            held.append((index, piece))
    if held:
        out.append(("\n\n".join(t for _, t in held), [i for i, _ in held]))
    return out


def with_seams(chunks: list[str], chars: int) -> list[str]:
    """Chunks with what their neighbours end and begin with."""
    out = []
    for i, chunk in enumerate(chunks):
        before = PREVIOUS + chunks[i - 1][-chars:] if i and chars else ""
        after = NEXT + chunks[i + 1][:chars] if i + 1 < len(chunks) and chars else ""
        out.append(chunk + before + after)
    return out


@F.udtf(returnType="chunk int, n_chunks int, body string")
class TextChunks:
    """Rows for a text, a token budget, and characters of neighbouring context."""

    def eval(self, text: str, most: int, seam: int) -> Iterator[tuple[int, int, str]]:
        found = with_seams(segments(text or "", most), seam)
        for i, body in enumerate(found, 1):
            yield i, len(found), body


@F.udtf(returnType="chunk int, n_chunks int, body string, block_indices array<int>")
class BlockChunks:
    """Rows for an array of block texts, a token budget, and characters of neighbouring context."""

    def eval(self, blocks: list[str], most: int, seam: int) -> Iterator[tuple[int, int, str, list[int]]]:
        found = packed([(i, b) for i, b in enumerate(blocks or []) if b and b.strip()], most)
        bodies = with_seams([t for t, _ in found], seam)
        for i, (body, (_, indices)) in enumerate(zip(bodies, found, strict=True), 1):
            yield i, len(found), body, indices


def text_chunks(df: DataFrame, text: Column, most: int = 8192, seam: int = 0) -> DataFrame:
    """df with chunk, n_chunks and body, a row for each chunk of a text."""
    return df.lateralJoin(TextChunks(text.outer(), F.lit(most), F.lit(seam)))


def block_chunks(df: DataFrame, blocks: Column, most: int = 16_000, seam: int = 150) -> DataFrame:
    """df with chunk, n_chunks, body and block_indices, a row for each chunk of an array of block texts."""
    return df.lateralJoin(BlockChunks(blocks.outer(), F.lit(most), F.lit(seam)))
