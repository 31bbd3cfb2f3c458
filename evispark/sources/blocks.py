"""Documents as blocks: HTML tables, markdown to blocks, blocks to text."""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


class _Cells(HTMLParser):
    """Cells as (row, text); a row without cells is none."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.open: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.open = []

    def handle_data(self, data):
        if self.open is not None:
            self.open.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.open is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("".join(self.open).strip())
            self.open = None


def table_rows(html: str | None) -> list[list[str]]:
    parser = _Cells()
    parser.feed(html or "")
    return [r for r in parser.rows if r]


def table_markdown(html: str | None) -> str:
    """A markdown table, ragged rows filled up; the first row is the head."""
    rows = table_rows(html)
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def html_rows(s: pd.Series) -> pd.Series:
    return s.map(table_rows)


@F.pandas_udf(StringType())
def html_markdown(s: pd.Series) -> pd.Series:
    return s.map(table_markdown)


BLOCK = ArrayType(StructType([StructField("type", StringType()), StructField("level", IntegerType()), StructField("text", StringType()), StructField("body", StringType())]))


def _marker(line: str) -> tuple[str, str]:
    """(kind, rest) of a stripped line by what it begins with: "#", "!", "<table", "|", "-" for list items, "" else."""
    word, _, rest = line.replace("\t", " ").partition(" ")
    if rest.strip() and len(word) <= 6 and word == "#" * len(word) != "":
        return "#", rest.strip()
    if word in ("-", "*") or (word.endswith(".") and word[:-1].isdecimal()):
        # A marker alone is no item: blanks at its end were stripped.
        return ("-", rest.lstrip()) if rest else ("", line)
    if line.startswith("!["):
        caption, middle, path = line[2:].partition("](")
        return "!" if middle and "]" not in caption and path.find(")") == len(path) - 1 > 0 else "![", line
    return ("<table", line) if line[:6].lower() == "<table" else ("|" if line.startswith("|") else "", line)


def _is_rule(line: str) -> bool:
    """A line that parts a table's head from its body."""
    return len(line) > 1 and line[0] == "|" and not line[1:].strip(" \t:|-")


def _labelled(lines: list[str]) -> list[tuple[str, int] | None]:
    """(kind, number of its block) of each line, None for blank ones; a block's lines follow each other."""
    out: list[tuple[str, int] | None] = []
    number, before, until = 0, "blank", ""
    for i, raw in enumerate(lines):
        line = raw.strip()
        mark = _marker(line)[0]
        if until == "</table>":
            kind = "html"
            if until in line.lower():
                until = ""
        elif mark == "|" and before == "table":
            kind = "table"
        elif not line:
            kind = "blank"
        elif mark == "<table":
            # The table's first line is never its last, as a reader of whole elements would have it.
            kind, until = "html", "</table>"
            number += 1
        elif mark == "|" and i + 1 < len(lines) and _is_rule(lines[i + 1].strip()):
            kind = "table"
        else:
            kind = {"#": "title", "!": "image", "-": "list"}.get(mark, "text")
        if kind != before or kind in ("title", "image") or mark == "![":
            number += 1
        before = kind
        out.append(None if kind == "blank" else (kind, number))
    return out


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def _block(kind: str, lines: list[str]) -> tuple[str, int | None, str, str]:
    first = lines[0].strip()
    if kind == "title":
        return "title", len(first) - len(first.lstrip("#")), _marker(first)[1], ""
    if kind == "image":
        caption, _, path = first[2:-1].partition("](")
        return "image", None, caption, path.strip()
    if kind == "html":
        return "table", None, "", "\n".join(lines)
    if kind == "table":
        head, *body = [_cells(x) for k, x in enumerate(lines) if k != 1]
        marked = [f"<tr>{''.join(f'<{tag}>{c}</{tag}>' for c in row)}</tr>" for tag, rows in (("th", [head]), ("td", body)) for row in rows]
        return "table", None, "", f"<table><thead>{marked[0]}</thead><tbody>{''.join(marked[1:])}</tbody></table>"
    if kind == "list":
        return "list", None, "\n".join(_marker(x.strip())[1] for x in lines), ""
    return "text", None, "\n".join(lines).strip(), ""


def markdown_blocks(markdown: str | None) -> list[tuple[str, int | None, str, str]]:
    """(type, heading level, text, body) of titles, images, tables, lists and paragraphs, in order."""
    lines = (markdown or "").split("\n")
    labelled = zip(_labelled(lines), lines, strict=True)
    return [_block(label[0], [x for _, x in group]) for label, group in groupby(labelled, key=lambda p: p[0]) if label]


@F.pandas_udf(BLOCK)
def blocks_of_markdown(s: pd.Series) -> pd.Series:
    return s.map(markdown_blocks)


def block_text(block: Column) -> Column:
    """Captions, text fields, then list items of a block struct, joined by line breaks; blanks are skipped."""
    parts = F.array(block["caption"], block["text"], block["body"], F.array_join(block["items"], "\n"))
    return F.array_join(F.filter(parts, lambda x: F.trim(x) != ""), "\n")


def document_text(formatted: Column, blocks: Column) -> Column:
    """The formatted text if there is any, else the blocks' texts with blank lines between."""
    return F.coalesce(F.nullif(F.trim(formatted), F.lit("")), F.nullif(F.array_join(F.filter(blocks, lambda x: F.trim(x) != ""), "\n\n"), F.lit("")))


def body_lines(df: DataFrame, key: str, text: str, start: str, end: str) -> DataFrame:
    """(key, body): the lines from the first that matches ``start`` to before the first later one that matches ``end``.

    The whole text stands in if no line starts the body.
    """
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    df = df.withColumn("_l", lines)
    first = F.get(F.filter("_l", lambda r: F.rlike(r["x"], F.lit(start))), F.lit(0))["i"]
    df = df.withColumn("_a", first)
    stop = F.get(F.filter("_l", lambda r: (r["i"] > F.col("_a")) & F.rlike(r["x"], F.lit(end))), F.lit(0))["i"]
    df = df.withColumn("_z", F.coalesce(stop, F.size("_l")))
    body = F.array_join(F.transform(F.filter("_l", lambda r: (r["i"] >= F.col("_a")) & (r["i"] < F.col("_z"))), lambda r: r["x"]), "\n")
    return df.select(key, F.when(F.col("_a").isNull(), F.col(text)).otherwise(F.coalesce(body, F.col(text))).alias("body"))
