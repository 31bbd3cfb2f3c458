"""Text repair and offsets: repeated sections, quotes, normalised occurrences, token-level span pairs, sameness of tracks."""

from __future__ import annotations

import difflib
import re
import unicodedata
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from . import text as T

HEADING = re.compile(r"#{1,6}\s+\S")
SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
PAIR = StructType([StructField(n, IntegerType()) for n in ("a_start", "a_end", "b_start", "b_end")])


def without_repeats(text: str | None) -> str | None:
    """The text without sections whose heading (in any case) stood before; unchanged if too little would be left."""
    if not text:
        return text
    parts = [p.strip() for p in re.split(r"\n\s*\n", text)]
    seen: set[str] = set()
    kept, keep, dropped = [], True, False
    for p in parts:
        if HEADING.match(p):
            keep = p.lower() not in seen
            seen.add(p.lower())
        dropped |= not keep
        if keep and p:
            kept.append(p)
    out = "\n\n".join(kept)
    return text if not dropped or (len(out) < 30 and len(out) < 0.1 * len(text)) else out


@F.pandas_udf(StringType())
def trim_repeats(s: pd.Series) -> pd.Series:
    return s.map(without_repeats)


def quote_span(quote: Column, text: Column) -> Column:
    """(start, end, precision) of a quote: exact, unmapped (-1) or missing."""
    q = F.trim(F.coalesce(quote, F.lit("")))
    at = F.position(q, text) - 1
    found = (q != "") & (at >= 0)
    return F.struct(
        F.when(found, at).otherwise(-1).alias("start"), F.when(found, at + F.length(q)).otherwise(-1).alias("end"),
        F.when(q == "", "missing").when(found, "exact").otherwise("unmapped").alias("precision"),
    )


def _folded(text: str) -> tuple[str, list[int]]:
    """NFKC, lower-cased text, and for each character the one it came from.

    A run of white space is one blank between ASCII characters and nothing beside others: line breaks in CJK text part no
    words.
    """
    chars, origin, gap = [], [], -1
    for i, c in enumerate(text):
        if c.isspace():
            gap = i if gap < 0 else gap
            continue
        if gap >= 0 and chars and chars[-1].isascii() and c.isascii():
            chars.append(" ")
            origin.append(gap)
        gap = -1
        for x in unicodedata.normalize("NFKC", c).lower():
            chars.append(x)
            origin.append(i)
    return "".join(chars), origin


def occurrences(text: str | None, snippet: str | None) -> list[tuple[int, int]]:
    """Where a snippet occurs, both folded; offsets are the text's own; occurrences may overlap."""
    hay, origin = _folded(text or "")
    needle = _folded((snippet or "").strip())[0]
    out, at = [], hay.find(needle) if needle else -1
    while at >= 0:
        out.append((origin[at], origin[at + len(needle) - 1] + 1))
        at = hay.find(needle, at + 1)
    return out


@F.pandas_udf(ArrayType(SPAN))
def find_folded(text: pd.Series, snippet: pd.Series) -> pd.Series:
    return pd.Series([occurrences(t, s) for t, s in zip(text, snippet, strict=True)])


def checked_pairs(a: str, b: str, raw: list[tuple[str, str]]) -> list[tuple[int, int, int, int]]:
    """Offsets of copied pairs of texts: each is sought after the last accepted one, then anywhere; overlaps are dropped."""
    out: list[tuple[int, int, int, int]] = []
    at = [0, 0]
    for pair in raw:
        left, right = pair[0].strip(), pair[1].strip()
        if not left or not right:
            continue
        i, j = a.find(left, at[0]), b.find(right, at[1])
        i, j = (i if i >= 0 else a.find(left)), (j if j >= 0 else b.find(right))
        one = (i, i + len(left), j, j + len(right))
        if i < 0 or j < 0 or any((one[0] < o[1] and o[0] < one[1]) or (one[2] < o[3] and o[2] < one[3]) for o in out):
            continue
        out.append(one)
        at = [one[1], one[3]]
    return out


def token_pairs(a: str | None, b: str | None) -> list[tuple[int, int, int, int]]:
    """Monotonic token pairs: the next equal token (in any case), else the one at the proportional place, until none is left."""
    left, right = (list(re.finditer(r"\w+", x or "")) for x in (a, b))
    places: dict[str, list[int]] = {}
    for j, m in enumerate(right):
        places.setdefault(m[0].lower(), []).append(j)
    out, at = [], 0
    for i, m in enumerate(left):
        if at >= len(right):
            break
        own = places.get(m[0].lower(), [])
        k = bisect_left(own, at)
        same = own[k] if k < len(own) else None
        # The first tokens and the last ones of both texts correspond.
        share = i / (len(left) - 1) if len(left) > 1 else 0.0
        j = same if same is not None else max(at, round(share * (len(right) - 1)))
        out.append((m.start(), m.end(), right[j].start(), right[j].end()))
        at = j + 1
    return out


@F.pandas_udf(ArrayType(PAIR))
def span_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_pairs(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts by their matching blocks."""
    return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)])


def untranslated(original: Column, translated: Column, most_script: float = 0.2, least_ratio: float = 0.9) -> Column:
    """Is the translated track still source text: mostly its script, or nearly equal to it."""
    empty = F.trim(F.coalesce(translated, F.lit(""))) == ""
    foreign = (T.script_ratio(original) >= 0.05) & (T.script_ratio(translated) > most_script)
    return F.coalesce(~empty & (foreign | (sequence_ratio(original, translated) >= least_ratio)), F.lit(False))


#: Names that a reviewer may use for the fields of a card.
CORRECTION_FIELDS = {"gene": "gene", "variant": "variant", "disease": "disease", "classification": "classification", "inheritance": "inheritance", "phenotype": "phenotype"}


def correction(message: Column) -> Column:
    """(field, value) of messages like "change gene to BRCA1" or "gene should be BRCA1"; nulls if there is none."""
    names = "|".join(CORRECTION_FIELDS)
    first, second = rf"(?i)^\s*(?:change|set|correct|update)\s+(?:the\s+)?({names})\s+(?:to|as)\s+(.+)$", rf"(?i)\b({names})\s+should\s+be\s+(.+)$"
    pick = lambda i: F.coalesce(F.nullif(F.regexp_extract(message, first, i), F.lit("")), F.nullif(F.regexp_extract(message, second, i), F.lit("")))
    return F.struct(F.lower(pick(1)).alias("field"), F.rtrim(F.regexp_replace(pick(2), r"[.,;。；]+\s*$", "")).alias("value"))
