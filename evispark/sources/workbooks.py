"""Workbooks (.xlsx): every sheet's cells as rows, read where the file lies by Spark's binary reader."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet string, row int, col int, value string"


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == "t")


def column_number(name: str) -> int:
    """A -> 0, Z -> 25, AA -> 26."""
    n = 0
    for c in name:
        n = 26 * n + ord(c) - 64
    return n - 1


def cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of the cells that hold something."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"):
            target = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            path = links[target].lstrip("/")
            path = path if path.startswith("xl/") else f"xl/{path}"
            for c in (e for e in ElementTree.fromstring(z.read(path)).iter() if _tag(e) == "c"):
                letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                value = next((e.text for e in c if _tag(e) == "v"), None)
                text = _text(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value is not None else value
                if text:
                    yield sheet.get("name"), int(digits) - 1, column_number(letters), text


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, value) of all cells of the workbooks below a path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(name, *c) for c in cells(bytes(content))], columns=["path", "sheet", "row", "col", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(run, CELLS)


def records(cells_: DataFrame) -> DataFrame:
    """(path, sheet, row, fields: map from the header in row 0 to the row's values) of each row below the header."""
    head = cells_.filter("row = 0").select("path", "sheet", "col", F.trim("value").alias("name"))
    body = cells_.filter("row > 0").join(head, ["path", "sheet", "col"])
    return body.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("fields"))
