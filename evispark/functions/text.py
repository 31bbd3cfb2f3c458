"""Scalar text functions as column expressions; those that need Unicode normalisation are Arrow UDFs."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Order of classification levels, least severe first.
LEVELS = ["benign", "likely_benign", "uncertain", "likely_pathogenic", "pathogenic"]
#: Placeholders that stand for a missing value.
MISSING = ["", "-", "na", "n/a", "none", "null", "nan", "not provided", "not reported", "unknown"]


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def lookup_text(s: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, case folded."""
    return s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no white space; what does not parse is null."""

    def one(x: str) -> str | None:
        try:
            return json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return s.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def payload_hash(c: Column) -> Column:
    return F.sha2(canonical_json(c).cast("binary"), 256)


def scope_hash(bindings: Column) -> Column:
    """Hash of (role, id) structs, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.transform(bindings, lambda b: F.concat_ws(":", b["role"], b["id"]))), "|").cast("binary"), 256)


def text_hash(text: Column, scope: Column | None = None) -> Column:
    return F.sha2((text if scope is None else F.concat(text, F.lit("\u0000"), scope)).cast("binary"), 256)


def internal_variant_id(gene: Column, hgvs: Column) -> Column:
    return F.concat(F.lit("internal:variant:"), F.substring(F.sha2(F.concat_ws("|", F.upper(gene), hgvs).cast("binary"), 256), 1, 12))


def title_key(c: Column) -> Column:
    """Lower-cased title without anything but word characters; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(c), r"(?U)[\W_]+", ""), F.lit(""))


def identifier(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def missing_to_null(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(MISSING), F.trim(c))


def relevance_tokens(c: Column) -> Column:
    """Lower-cased word tokens; runs of CJK characters longer than two become overlapping pairs."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    split = lambda w: F.when(F.rlike(w, F.lit(r"[぀-ヿ㐀-鿿]")) & (F.length(w) > 2), pairs(w)).otherwise(F.array(w))
    return F.flatten(F.transform(words, split))


def lexical_relevance(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has; 0 for a query without tokens."""
    q = F.array_distinct(relevance_tokens(query))
    # One pass over the text; words stand between blanks, and pairs of CJK characters anywhere.
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+", " "), F.lit(" "))
    pair = lambda w: F.rlike(w, F.lit(r"[぀-ヿ㐀-鿿]")) & (F.length(w) == 2)
    held = F.filter(q, lambda w: F.when(pair(w), F.contains(words, w)).otherwise(F.contains(words, F.concat(F.lit(" "), w, F.lit(" ")))))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(held) / F.size(q))


def word_set(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(c), r"(?U)\W+")), lambda w: w != "")


def comparison_text(c: Column) -> Column:
    """Dashes and quotes folded, separators as blanks."""
    folded = F.translate(c, "‐‑‒–—−‘’“”", "------''\"\"")
    return collapse_spaces(F.regexp_replace(folded, r"[_/,;]+", " "))


def fuzzy_match(expected: Column, extracted: Column, least: float = 0.6) -> Column:
    """Equal, one inside the other, or at least 60 % of the expected words shared."""
    a, b = F.lower(comparison_text(expected)), F.lower(comparison_text(extracted))
    wa, wb = word_set(a), word_set(b)
    overlap = (F.size(wa) > 0) & (F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(wa), F.lit(1)) >= least)
    given = (F.coalesce(expected, F.lit("")) != "") & (F.coalesce(extracted, F.lit("")) != "")
    return given & ((a == b) | F.contains(b, a) | F.contains(a, b) | overlap)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def partial_match(a: Column, b: Column, least: float = 0.75) -> Column:
    """Containment, or overlap of at least 75 % of the smaller word set."""
    wa, wb = word_set(a), word_set(b)
    small = F.least(F.size(wa), F.size(wb))
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a)) | ((small > 0) & (F.size(F.array_intersect(wa, wb)) >= least * small))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))


def numeric_drift(a: Column, b: Column) -> Column:
    """Do two texts name different numbers."""
    return F.size(F.array_except(numbers(a), numbers(b))) + F.size(F.array_except(numbers(b), numbers(a))) > 0


def negated(c: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(c), r"(?U)\W+"), F.array(*(F.lit(w) for w in ("no", "not", "without", "never", "absence", "absent"))))


def classification_level(c: Column) -> Column:
    """Free text to one of five severity levels; rules in order."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    has = lambda w: F.contains(t, F.lit(w))
    return (
        F.when(t.isin("", "not specified", "unknown"), "uncertain")
        .when(has("pathogenic") & ~has("likely") & ~has("benign"), "pathogenic")
        .when(has("likely pathogenic") | (t == "lp"), "likely_pathogenic")
        .when(has("benign") & ~has("likely") & ~has("pathogenic"), "benign")
        .when(has("likely benign") | (t == "lb"), "likely_benign")
        .otherwise("uncertain")
    )


def severity(level: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in LEVELS)), level) - 1


def estimate_tokens(c: Column) -> Column:
    """A quarter of the ASCII characters plus all others, cut to an integer."""
    wide = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    return F.floor((F.length(c) - wide) / 4.0 + wide).cast("long")


def script_ratio(c: Column, ranges: str = r"㐀-鿿") -> Column:
    """Share of characters of a script."""
    return F.when(F.length(c) == 0, 0.0).otherwise(F.regexp_count(c, F.lit(f"[{ranges}]")) / F.length(c))


def skip_translation(c: Column) -> Column:
    """Already English: hardly any CJK, and ASCII with three or more frequent English words."""
    frequent = F.size(F.array_intersect(word_set(c), F.array(*(F.lit(w) for w in ("the", "of", "and", "in", "to", "is", "for", "with")))))
    return (script_ratio(c) <= 0.05) & ~F.rlike(c, F.lit(r"[^\x00-\x7F]")) & (frequent >= 3)


def group_id(gene: Column, variant: Column) -> Column:
    """``gene=<g>|variant=<v>`` without white space; what is missing is named so."""
    part = lambda c: F.coalesce(F.nullif(F.regexp_replace(c, r"\s+", ""), F.lit("")), F.lit("__missing__"))
    return F.concat(F.lit("gene="), part(gene), F.lit("|variant="), part(variant))


def from_group_id(c: Column, key: str) -> Column:
    value = F.regexp_extract(c, rf"{key}=([^|]+)", 1)
    return F.when(~value.isin("", "__missing__"), value)


def field_category(field_id: Column) -> Column:
    return F.when(F.contains(field_id, F.lit(".")), F.split_part(field_id, F.lit("."), F.lit(1)))


def year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def doi(c: Column) -> Column:
    folded = F.translate(c, "‐‑‒–—", "-----")
    return F.nullif(F.lower(F.regexp_extract(folded, r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+)", 1)), F.lit(""))


def pmid(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)pmid:?\s*(\d{4,9})", 1), F.lit(""))


def safe_filename(c: Column) -> Column:
    return F.left(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), F.lit(120))


def strip_fences(c: Column) -> Column:
    """The inside of a fenced code block, or the text itself."""
    return F.trim(F.regexp_replace(c, r"(?s)^\s*```[A-Za-z]*\s*\n?|\n?```\s*$", ""))


def without_parentheses(c: Column) -> Column:
    return collapse_spaces(F.regexp_replace(F.lower(c), r"\([^)]*\)", " "))


def ordered_distinct_lines(*columns: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.array(*columns), lambda x: x.isNotNull() & (F.trim(x) != ""))), "\n")


def fragments_in_order(snippet: Column, text: Column) -> Column:
    """Do the parts of a snippet between ellipses occur in the text one after the other."""
    parts = F.filter(F.split(F.lower(snippet), r"\s*(?:\.{3}|…)\s*"), lambda p: p != "")
    step = lambda at, p: F.when((at > 0) & (F.position(p, F.lower(text), at) > 0), F.position(p, F.lower(text), at) + F.length(p)).otherwise(0)
    end = F.aggregate(parts, F.lit(1), step)
    return (F.size(parts) > 0) & (end > 0)


#: Characters that may not stand beside an anchored value.
BOUNDARY = r"A-Za-z0-9_"


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
def value_anchor(text: pd.Series, value: pd.Series) -> pd.DataFrame:
    """Where a value stands as a token: single letters never, two letters only upper-case, longer ones in any case."""
    rows = []
    for t, v in zip(text, value, strict=True):
        v = (v or "").strip() if isinstance(v, str) else ""
        found = None
        if isinstance(t, str) and (len(v) > 2 or (len(v) == 2 and v.isupper())):
            found = re.search(rf"(?<![{BOUNDARY}]){re.escape(v)}(?![{BOUNDARY}])", t, 0 if len(v) == 2 else re.IGNORECASE)
        rows.append((found.start(), found.end()) if found else (None, None))
    return pd.DataFrame(rows, columns=["start", "end"]).astype("Int32")


def segment(df, text_col: str, max_tokens: int, max_chars: int):
    """Greedy segments of paragraphs within a token and a character budget: (all columns, segment_index, segment).

    A paragraph beyond the budget is cut at sentence ends, and a sentence beyond it hard.
    """
    tokens = lambda s: int(sum(c < "\x80" for c in s) / 4 + sum(c >= "\x80" for c in s))
    fits = lambda s: tokens(s) <= max_tokens and len(s) <= max_chars

    def pieces(paragraph: str):
        if fits(paragraph):
            yield paragraph
            return
        held = ""
        for sentence in re.split(r"(?<=[.!?。])\s*", paragraph):
            joined = f"{held} {sentence}".strip()
            if fits(joined):
                held = joined
                continue
            if held:
                yield held
            while not fits(sentence):
                size = max(1, min(max_chars, max_tokens))
                yield sentence[:size]
                sentence = sentence[size:]
            held = sentence
        if held:
            yield held

    def cut(text: str | None) -> list[str]:
        out, held = [], ""
        for p in re.split(r"\n\s*\n", text or ""):
            for piece in pieces(p.strip()):
                joined = f"{held}\n\n{piece}" if held else piece
                if fits(joined):
                    held = joined
                else:
                    out.append(held)
                    held = piece
        return [*out, held] if held else out

    @F.pandas_udf(ArrayType(StringType()))
    def segments(s: pd.Series) -> pd.Series:
        return s.map(cut)

    return df.select("*", F.posexplode(segments(F.col(text_col))).alias("segment_index", "segment"))


#: Words that do not tell diseases apart.
DISEASE_STOPWORDS = ["disease", "syndrome", "disorder", "type", "the", "a", "an", "of", "due", "to", "with", "and", "or"]


def disease_match(expected: Column, extracted: Column, least: float = 0.6) -> Column:
    """As fuzzy_match, on words between blanks and hyphens without those that do not tell diseases apart."""
    a, b = collapse_spaces(F.lower(expected)), collapse_spaces(F.lower(extracted))
    words = lambda c: F.array_except(F.array_distinct(F.split(c, r"[\s\-]+")), F.array(*(F.lit(w) for w in DISEASE_STOPWORDS)))
    overlap = (F.size(words(a)) > 0) & (F.size(words(b)) > 0) & (F.size(F.array_intersect(words(a), words(b))) >= least * F.size(words(a)))
    return F.coalesce((a != "") & (b != "") & ((a == b) | F.contains(b, a) | F.contains(a, b) | overlap), F.lit(False))


def disease_tokens(c: Column) -> Column:
    """Words of more than two characters that tell diseases apart, in order."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), F.lit(1)), lambda w: (F.length(w) > 2) & ~w.isin(DISEASE_STOPWORDS))


def mapped(c: Column, table: dict[str, str]) -> Column:
    """A text by a small literal map of its lower-cased form; others stay."""
    out = c
    for k, v in table.items():
        out = F.when(F.lower(F.trim(c)) == k, v).otherwise(out)
    return out


def first_bucket(c: Column, buckets: dict[str, list[str]], other: str = "other") -> Column:
    """The first bucket one of whose words occurs."""
    low, out = F.lower(c), F.lit(other)
    for name, words in reversed(list(buckets.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def relationship(c: Column) -> Column:
    """A gene-disease statement as one of causative, uncertain, disputed, refuted; rules in order, else lower-cased."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    has = lambda p: F.rlike(t, F.lit(p))
    return (
        F.when(t.isin("", "causative", "uncertain", "disputed", "refuted"), t).when(t.isin("associated", "association", "susceptibility"), "causative")
        .when(has(r"disput|conflict"), "disputed").when(has(r"\bno (evidence|association)|refut|not associated"), "refuted")
        .when(has(r"uncertain|limited|insufficient"), "uncertain").when(has(r"\bcaus|pathogenic|responsible"), "causative").otherwise(t)
    )


def difficulty(field_id: Column) -> Column:
    """Tier of a field by its category."""
    return F.when(F.startswith(field_id, F.lit("A.")), "simple_explicit").when(F.startswith(field_id, F.lit("B.")), "medium_contextual").when(F.startswith(field_id, F.lit("C.")), "complex_evidence").otherwise("other")


def whole_number(c: Column) -> Column:
    """Ids that a spreadsheet turned into numbers: ``.0`` at the end goes."""
    return F.regexp_replace(missing_to_null(c), r"^(\d+)\.0$", "$1")


def identifier_body(c: Column) -> Column:
    """An identifier without its scheme."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^(pmid|doi|pmcid)\s*:\s*", "")


def plain_title(c: Column) -> Column:
    """Lower-cased title of ASCII letters, digits, CJK characters and single blanks."""
    spaced = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s\-–—]+", " ")
    return collapse_spaces(F.regexp_replace(spaced, r"[^a-z0-9一-鿿\s]", ""))
