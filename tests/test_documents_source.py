"""The JSON document source: declared schema, corrupt files, partitions of bounded size."""

import json

from evispark.sources import documents_source as D


def write(folder, name, value):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_track_documents(spark, tmp_path):
    D.register(spark)
    blocks = [{"type": "title", "text": "Títle", "page_idx": 0}, {"type": "table", "table_body": "<table/>", "page_idx": 1}, {"list_items": ["a", "b"]}, {"type": "image"}, "odd"]
    write(tmp_path, "a/one.json", {"document_id": "d1", "track": "original", "title": "T", "blocks": blocks})
    write(tmp_path, "b/two.json", {"id": 7, "formatted_text": "whole text", "content": []})
    write(tmp_path, "bad.json", "{not json")
    write(tmp_path, "list.json", [1, 2])
    write(tmp_path, "other.txt", "ignored")
    df = spark.read.format("document_json").load(str(tmp_path))
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in df.collect()}
    assert set(rows) == {"one.json", "two.json", "bad.json", "list.json"}
    one = rows["one.json"]
    assert (one["document_id"], one["track"], one["n_blocks"], one["text"]) == ("d1", "original", 4, "Títle\n\n<table/>\n\na\nb")
    assert [(b["index"], b["type"], b["page"]) for b in one["blocks"]] == [(0, "title", 0), (1, "table", 1), (2, "text", None), (3, "image", None)]
    assert (rows["two.json"]["document_id"], rows["two.json"]["text"], rows["two.json"]["corrupt"]) == ("7", "whole text", None)
    assert rows["bad.json"]["corrupt"] == "{not json" and rows["bad.json"]["document_id"] is None and rows["list.json"]["corrupt"] == "[1, 2]"


def test_entries_and_partitions(spark, tmp_path):
    D.register(spark)
    write(tmp_path, "selection.json", [{"entry_id": "e1", "gene": "TP53", "disease_name": "x", "more": {"k": [1]}}, {"id": 2, "variant_hgvs_c": "c.1A>G"}, 5])
    write(tmp_path, "manifest.json", {"version": 1, "cases": [{"entry_id": "e3"}]})
    write(tmp_path, "nothing.json", {"version": 1})
    df = spark.read.format("document_json").option("kind", "entries").option("partitionBytes", 10).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    got = sorted((r["path"].rsplit("/", 1)[-1], r["pos"] if r["pos"] is not None else -1, r["entry_id"], r["gene_symbol"], r["disease"], r["variant"], r["corrupt"]) for r in df.collect())
    assert got == [
        ("manifest.json", 0, "e3", None, None, None, None), ("nothing.json", -1, None, None, None, None, '{"version": 1}'), ("selection.json", 0, "e1", "TP53", "x", None, None),
        ("selection.json", 1, "2", None, None, "c.1A>G", None), ("selection.json", 2, None, None, None, None, "5"),
    ]
    one = spark.read.format("document_json").option("kind", "entries").load(str(tmp_path))
    assert one.rdd.getNumPartitions() == 1
    assert json.loads(one.filter("entry_id = 'e1'").first()["raw"])["more"] == {"k": [1]}


def test_empty_folder(spark, tmp_path):
    D.register(spark)
    assert spark.read.format("document_json").load(str(tmp_path)).collect() == []
