"""A data source for folders of JSON documents: ``spark.read.format("document_json").load(folder)``.

Each file is one document of a track, or a list of benchmark entries; a partition holds files of bounded size, so a folder of
many small files makes few tasks and a large one is a task of its own.  The schema is declared, not inferred: a file that is
no JSON, or whose root is of another kind, gives one row with its text in ``corrupt`` and nulls elsewhere.

Kinds (option ``kind``): ``track`` reads track documents (blocks become ``blocks``, their texts ``text``), ``entries`` reads
lists of entries, either plain or below ``entries`` or ``cases`` of a manifest.

The driver lists the folder and executors read the files, both through the file system that pyarrow finds for the path, so
the folder has to be reachable from all of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

TRACK = "path string, document_id string, track string, title string, text string, n_blocks int, blocks array<struct<index:int,type:string,page:int,text:string>>, corrupt string"
ENTRIES = "path string, pos int, entry_id string, gene_symbol string, disease string, variant string, raw string, corrupt string"
SCHEMAS = {"track": TRACK, "entries": ENTRIES}
#: Bytes of files in a partition.
PARTITION_BYTES = 32 << 20
#: Keys under which a manifest lists its entries, and names that a field goes by.
LISTS = ["entries", "cases"]
NAMES = {"entry_id": ["entry_id", "id"], "gene_symbol": ["gene_symbol", "gene"], "disease": ["disease_label", "disease_name", "disease"], "variant": ["variant_hgvs_c", "variant"]}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path there) of a path or uri."""
    if not urlparse(path).scheme:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _text(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _first(record: dict, names: list[str]) -> str | None:
    return next((_text(record[n]) for n in names if record.get(n) not in (None, "")), None)


def _block_text(block: dict) -> str:
    for name in ("text", "content", "table_body", "code_body"):
        if isinstance(block.get(name), str) and block[name].strip():
            return block[name].strip()
    items = block.get("list_items")
    return "\n".join(str(x) for x in items) if isinstance(items, list) else ""


def track_rows(path: str, raw: str) -> Iterator[tuple]:
    """One row of a track document: its blocks in order, and the texts of those that have one, between blank lines."""
    try:
        doc = json.loads(raw)
    except ValueError:
        doc = None
    if not isinstance(doc, dict):
        yield (path, None, None, None, None, None, None, raw)
        return
    given = doc.get("blocks") or doc.get("content") or []
    blocks = [b for b in given if isinstance(b, dict)] if isinstance(given, list) else []
    rows = [{"index": i, "type": _text(b.get("type")) or "text", "page": b["page_idx"] if isinstance(b.get("page_idx"), int) else None, "text": _block_text(b)} for i, b in enumerate(blocks)]
    whole = doc.get("formatted_text") if isinstance(doc.get("formatted_text"), str) and doc["formatted_text"].strip() else "\n\n".join(r["text"] for r in rows if r["text"])
    yield (path, _first(doc, ["document_id", "id"]), _text(doc.get("track")), _text(doc.get("title")), whole, len(rows), rows, None)


def entry_rows(path: str, raw: str) -> Iterator[tuple]:
    """A row for each entry of a list or manifest; an entry that is no record is corrupt by itself."""
    try:
        found = json.loads(raw)
    except ValueError:
        found = None
    if isinstance(found, dict):
        found = next((found[k] for k in LISTS if isinstance(found.get(k), list)), None)
    if not isinstance(found, list):
        yield (path, None, None, None, None, None, None, raw)
        return
    for pos, entry in enumerate(found):
        if isinstance(entry, dict):
            yield (path, pos, *(_first(entry, NAMES[n]) for n in ("entry_id", "gene_symbol", "disease", "variant")), _text(entry), None)
        else:
            yield (path, pos, None, None, None, None, None, _text(entry))


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class Reader(DataSourceReader):
    def __init__(self, folder: str, kind: str, schema: StructType, partition_bytes: int) -> None:
        self.folder, self.kind, self.schema, self.partition_bytes = folder, kind, schema, partition_bytes

    def partitions(self) -> list[Files]:
        """Files in order of name, so many in a partition that their bytes stay near the bound."""
        system, root = file_system(self.folder)
        infos = sorted((i.path, i.size or 0) for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.endswith(".json"))
        out: list[list[str]] = []
        size = self.partition_bytes
        for path, n in infos:
            if size + n > self.partition_bytes or not out:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [Files(paths) for paths in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        system, _ = file_system(self.folder)
        parse = track_rows if self.kind == "track" else entry_rows
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                raw = f.read().decode("utf-8", "replace")
            rows = [dict(zip(arrow.names, r, strict=True)) for r in parse(path, raw)]
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_pylist(rows[at : at + 4096], arrow)


class DocumentJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_json"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "track")]

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("kind", "track"), schema, int(self.options.get("partitionbytes", self.options.get("partitionBytes", PARTITION_BYTES))))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(DocumentJson)
