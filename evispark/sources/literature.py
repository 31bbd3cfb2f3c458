"""Provider records of literature searches as rows of one item schema; logs; links to open copies.

A provider is a mapping from item columns to expressions over its JSON text; adding one is adding a mapping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(path: str) -> Column:
    return F.nullif(F.trim(F.get_json_object("raw", path)), F.lit(""))


def _first(*paths: str) -> Column:
    return F.coalesce(*(_at(p) for p in paths))


def _year(*paths: str) -> Column:
    return F.nullif(F.regexp_extract(_first(*paths), r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")


def _names(path: str, schema: str, name) -> Column:
    parsed = F.from_json(F.get_json_object("raw", path), F.lit(f"ARRAY<STRUCT<{schema}>>"))
    return F.array_distinct(F.filter(F.transform(parsed, name), lambda x: x.isNotNull() & (x != "")))


def _full(a) -> Column:
    return F.nullif(F.trim(F.concat_ws(" ", a["given"], a["family"])), F.lit(""))


def mappings() -> dict[str, dict[str, Column]]:
    """Column expressions of each provider; built when needed, as expressions need a running session."""
    return {
        "crossref": {"title": _first("$.title[0]", "$.title"), "authors": _names("$.author", "given STRING, family STRING", _full), "journal": _first("$.container-title[0]"), "year": _year("$.issued", "$.published", "$.created"), "doi": _first("$.DOI", "$.doi"), "url": _first("$.URL", "$.url")},
        "openalex": {"title": _first("$.title"), "authors": _names("$.authorships", "author STRUCT<display_name: STRING>", lambda a: a["author"]["display_name"]), "journal": _first("$.primary_location.source.display_name"), "year": _year("$.publication_year", "$.year"), "doi": _first("$.doi"), "url": _first("$.id")},
        "semantic_scholar": {"title": _first("$.title"), "authors": _names("$.authors", "name STRING", lambda a: a["name"]), "journal": _first("$.journal.name", "$.venue"), "year": _year("$.year", "$.publicationDate"), "doi": _first("$.externalIds.DOI"), "url": _first("$.url", "$.openAccessPdf.url")},
        "europepmc": {"title": _first("$.title"), "authors": _names("$.authorList.author", "fullName STRING", lambda a: a["fullName"]), "journal": _first("$.journalInfo.journal.title", "$.journalTitle"), "year": _year("$.pubYear", "$.firstPublicationDate"), "doi": _first("$.doi"), "url": _first("$.fullTextUrlList.fullTextUrl[0].url")},
        "pmc": {"title": _first("$.title"), "authors": _names("$.authors", "name STRING", lambda a: a["name"]), "journal": _first("$.fulljournalname", "$.source"), "year": _year("$.pubdate", "$.epubdate"), "doi": F.get(F.filter(F.from_json(F.get_json_object("raw", "$.articleids"), F.lit("ARRAY<STRUCT<idtype: STRING, value: STRING>>")), lambda a: a["idtype"] == "doi"), F.lit(0))["value"], "url": _first("$.url")},
        "unpaywall": {"title": _first("$.title"), "authors": _names("$.z_authors", "given STRING, family STRING", _full), "journal": _first("$.journal_name"), "year": _year("$.year", "$.published_date"), "doi": _first("$.doi"), "url": _first("$.best_oa_location.url_for_pdf", "$.best_oa_location.url")},
        "zenodo": {"title": _first("$.metadata.title", "$.title"), "authors": _names("$.metadata.creators", "name STRING", lambda a: a["name"]), "journal": _first("$.metadata.journal.title"), "year": _year("$.metadata.publication_date"), "doi": _first("$.doi", "$.metadata.doi"), "url": _first("$.links.self_html", "$.links.html")},
        "clinical_trials": {"title": _first("$.protocolSection.identificationModule.officialTitle", "$.protocolSection.identificationModule.briefTitle"), "authors": _names("$.protocolSection.contactsLocationsModule.overallOfficials", "name STRING", lambda a: a["name"]), "journal": F.lit(None).cast("string"), "year": _year("$.protocolSection.statusModule.startDateStruct.date"), "doi": F.lit(None).cast("string"), "url": F.concat(F.lit("https://clinicaltrials.gov/study/"), _first("$.protocolSection.identificationModule.nctId"))},
        "generic": {"title": _first("$.title[0]", "$.title", "$.name"), "authors": _names("$.authors", "name STRING", lambda a: a["name"]), "journal": _first("$.journal", "$.venue", "$.source"), "year": _year("$.year", "$.published", "$.date"), "doi": _first("$.doi", "$.DOI"), "url": _first("$.url", "$.link")},
    }


COLUMNS = ["title", "authors", "journal", "year", "doi", "url"]


def items(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(provider, raw: JSON text) -> provider, the columns to ``keep`` and the item columns; unknown providers take the
    generic mapping."""
    known = mappings()
    empty = F.array().cast("array<string>")
    out = {}
    for c in COLUMNS:
        e = known["generic"][c]
        for name, m in known.items():
            if name != "generic":
                e = F.when(F.col("provider") == name, m[c]).otherwise(e)
        out[c] = F.coalesce(e, empty) if c == "authors" else e
    return records.select("provider", *keep, *(e.alias(c) for c, e in out.items()))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(level, location, message) of ``... | LEVEL | location - message`` lines, gzip or not; other lines are dropped."""
    pattern = r"\|\s*([A-Z]+)\s*\|\s*(\S+)\s+-\s+(.*)$"
    e = lambda i: F.regexp_extract("value", pattern, i)
    return spark.read.text(path).select(e(1).alias("level"), e(2).alias("location"), e(3).alias("message")).filter("level <> ''")


def template(message: Column) -> Column:
    """A message with quoted texts, ids, numbers and paths masked."""
    out = message
    for pattern, mask in ((r"'[^']*'|\"[^\"]*\"", "<str>"), (r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b", "<id>"), (r"(?:/[\w.-]+){2,}", "<path>"), (r"\d+(?:\.\d+)?", "<num>")):
        out = F.regexp_replace(out, pattern, mask)
    return out


def open_copy(links: Column) -> Column:
    """The best of structs (kind, url): a download, then a pdf, then a landing page."""
    def best(*kinds: str) -> Column:
        return F.get(F.filter(links, lambda x: x["kind"].isin(*kinds) & x["url"].isNotNull()), F.lit(0))["url"]

    return F.coalesce(best("download"), best("oa_pdf"), best("pdf"), best("landing"))
