"""Variant nomenclature as column expressions: forms of coding and protein changes, variant classes, inheritance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Amino acid codes, three letters to one.
AMINO = {"Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I", "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V", "Sec": "U", "Pyl": "O"}
#: Ways to write a stop, and effects that stand for themselves.
STOPS, EFFECTS = ["Ter", "*", "stop", "X"], ["fs", "del", "dup", "ins"]
#: Kinds of reference sequences that an accession names.
SEQUENCES = ["NM", "NR", "XM", "XR", "NG"]


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace("*", "[*]") for w in words) + ")"


#: A residue, its place, what becomes of it, and whether the reading frame shifts there.
CHANGE = f"({_any(list(AMINO))})([0-9]+)({_any([*AMINO, *STOPS, *EFFECTS])})"


def _without_spaces(c: Column) -> Column:
    """Entities resolved, compatibility forms folded, all white space dropped."""
    return F.regexp_replace(T.nfkc(T.unescape(c)), r"(?U)\s+", "")


def _listed(c: Column) -> Column:
    """Items of a list literal such as ['a','b']: what stands between its quotes; anything else is one item."""
    inside = F.split(F.substring_index(F.substring(c, 2, F.length(c)), "]", 1), "['\"]")
    quoted = F.filter(inside, lambda x, i: (i % 2 == 1) & (x != ""))
    return F.when(F.startswith(c, F.lit("[")) & F.contains(c, F.lit("]")), quoted).otherwise(F.array(c))


def _without_accession(c: Column) -> Column:
    """What follows the accession of a reference sequence and its colon; null if there is none."""
    first = F.substring_index(c, ":", 1)
    named = F.rlike(first, F.lit(f"^{_any(SEQUENCES)}_[0-9.]+([(][^)]+[)])?$")) & F.contains(c, F.lit(":"))
    return F.when(named, F.substring(c, F.length(first) + 2, F.length(c)))


def _one_letter(c: Column) -> Column:
    """The first protein change after a ``p``, by one-letter codes; null if there is none."""
    part = [F.regexp_extract(c, f"p[.]?[(]?{CHANGE}[)]?((?i:fs)?)", k) for k in (1, 2, 3, 4)]
    codes = F.create_map(*(F.lit(x) for pair in AMINO.items() for x in pair))
    # Looked up where there is a change only: a map gives null for an unknown key.
    became = F.when(part[3] != "", "fs").when(part[2].isin(STOPS), "*").when(part[2].isin(EFFECTS), part[2]).otherwise(F.try_element_at(codes, part[2]))
    return F.when(part[0] != "", F.concat(F.lit("p."), F.try_element_at(codes, part[0]), part[1], became))


def _derived(c: Column) -> Column:
    """Other forms of one change: one-letter codes, ``*`` for a stop, and a prefix for a bare protein change."""
    stop = [F.regexp_extract(c, r"p[.]([A-Z])([0-9]+)X", k) for k in (1, 2)]
    short = [F.regexp_extract(c, r"^([A-Z])([0-9]+)([A-Z*])$", k) for k in (1, 2, 3)]
    return F.array(
        _one_letter(c),
        F.when(stop[0] != "", F.concat(F.lit("p."), *stop, F.lit("*"))),
        F.when(short[0] != "", F.concat(F.lit("p."), short[0], short[1], F.translate(short[2], "X", "*"))),
        F.when(F.rlike(c, F.lit(f"^{CHANGE}$")), _one_letter(F.concat(F.lit("p."), c))),
    )


def hgvs_aliases(c: Column) -> Column:
    """array<string>: the text itself, what follows its accession, and their derived forms; a list literal's items each.

    Empty for a null or empty text.
    """
    forms = lambda x: F.concat(F.array(x, _without_accession(x)), _derived(_without_accession(x)), _derived(x))
    known = F.filter(F.flatten(F.transform(_listed(_without_spaces(c)), forms)), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(known), F.array().cast("array<string>"))


def coding_part(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(c\.[^\s()]+)", 1), F.lit(""))


def protein_part(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\((p\.[^)]+)\)", 1), F.lit(""))


def rsid(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.isNull() | t.isin("", "-", "-1"), None).when(F.startswith(F.lower(t), F.lit("rs")), F.lower(t)).otherwise(F.concat(F.lit("rs"), t))


def review_stars(status: Column) -> Column:
    """Stars of a review status by the first phrase that it contains."""
    t = F.lower(status)
    out = F.lit(0)
    for phrase, stars in reversed([("practice guideline", 4), ("reviewed by expert panel", 3), ("multiple submitters", 2), ("single submitter", 1), ("conflicting", 1)]):
        out = F.when(F.contains(t, F.lit(phrase)), stars).otherwise(out)
    return out


def variant_class(c: Column) -> Column:
    """Class of a variant by the first key that its description contains."""
    t = F.lower(c)
    out = F.lit("other")
    for key, name in reversed([("missense", "missense"), ("nonsense", "nonsense"), ("stop", "nonsense"), ("frameshift", "frameshift"), ("splice", "splice"), ("synonymous", "synonymous"), ("deletion", "deletion"), ("duplication", "duplication"), ("insertion", "insertion"), ("indel", "indel"), ("inversion", "inversion")]):
        out = F.when(F.contains(t, F.lit(key)), name).otherwise(out)
    return out


#: Short forms of modes of inheritance.
SHORT_MODES = {"ad": "AD", "ar": "AR", "sd": "SD", "xl": "XL", "xld": "XL", "xlr": "XL", "x-linked": "XL", "mitochondrial": "Mitochondrial", "somatic": "Somatic Mosaicism", "undetermined": "Undetermined"}
#: Phrases and the mode that each stands for; the first that a description holds counts.  A blank stands for
#: any white space or none, a hyphen for any white space and hyphens or none.
MODE_PHRASES = [
    ("autosomal dominant", "AD"), ("autosomal recessive", "AR"), ("x-linked", "XL"), ("semi-dominant", "SD"), ("mitochondrial", "Mitochondrial"), ("maternal inheritance", "Mitochondrial"),
    ("somatic mosaic", "Somatic Mosaicism"), ("mosaicism", "Somatic Mosaicism"), ("undetermined", "Undetermined"), ("unknown inheritance", "Undetermined"), ("常染色体显性", "AD"), ("常染色体隐性", "AR"), ("x连锁", "XL"),
]


def phrase_pattern(phrase: str) -> str:
    """A regular expression for a phrase of the table, for lower-cased texts."""
    return phrase.replace("-", r"[\s-]*").replace(" ", r"\s*")


def inheritance(c: Column) -> Column:
    """Canonical mode of inheritance: by short form, else by the first phrase held; others upper-cased, empty for none."""
    t = F.trim(c)
    low = F.lower(t)
    found = [F.when(F.rlike(low, F.lit("(?U)" + phrase_pattern(phrase))), mode) for phrase, mode in MODE_PHRASES]
    known = F.coalesce(*(F.when(low == k, v) for k, v in SHORT_MODES.items()))
    canonical = F.when(t.isin(sorted(set(SHORT_MODES.values()))), t)
    return F.when(F.coalesce(t, F.lit("")) == "", "").otherwise(F.coalesce(canonical, known, *found, F.upper(t)))


def phenotype_ids(c: Column, prefix: str) -> Column:
    """Distinct ids such as MONDO:0001234 in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(rf"({prefix}:\d+)"), F.lit(1))))
