"""The stored literature graph on small cases."""

from evispark.operators import backfill as B

RUNS, ITEMS = "run_id long, document_id string, status string", "item_id string, run_id long"
BOUND, ENTITIES = "item_id string, entity_id long, role string", "entity_id long, entity_type string, external_id string"


def test_bindings(spark):
    matches = spark.createDataFrame([(1, 10, "gene", "subject", "A"), (2, None, "gene", "object", "B"), (3, 11, "gene", None, "C"), (None, 12, "gene", "object", "D")], "key long, entity_id long, entity_type string, role string, raw_text string")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "key long, item_id string")
    got = sorted(tuple(r) for r in B.bindings(matches, rows).collect())
    assert got == [("a", 10, "gene", "subject", 0, "A"), ("b", 10, "gene", "subject", 0, "A")]


def test_literature_graph(spark):
    runs = spark.createDataFrame([(1, "d", "completed"), (2, "d", "failed"), (3, "e", "completed"), (4, "f", None)], RUNS)
    items = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 9), ("h", None)], ITEMS)
    bound = spark.createDataFrame([("a", 5, "subject"), ("a", 5, "subject"), ("a", 6, None), ("a", 7, "object"), ("a", 8, "object"), ("b", 5, "subject")], BOUND)
    entities = spark.createDataFrame([(5, "gene", "HG1"), (6, "gene", ""), (7, "odd", "X"), (9, None, None)], ENTITIES)
    nodes, edges = B.literature_graph(runs, items, bound, entities, {"gene": "Gene"})
    assert sorted(map(tuple, nodes.collect())) == [
        ("document:d", "Document"), ("document:e", "Document"), ("entity:6", "Gene"), ("evidence:a", "Evidence"),
        ("gene:HG1", "Gene"), ("run:1", "ProcessingRun"), ("run:3", "ProcessingRun"),
    ]
    assert sorted((r["src"], r["dst"], r["relation"], r["role"] or "") for r in edges.collect()) == [
        ("evidence:a", "document:d", "FROM_DOCUMENT", ""), ("evidence:a", "entity:6", "MENTIONS", ""),
        ("evidence:a", "gene:HG1", "SUPPORTS", "subject"), ("evidence:a", "run:1", "FROM_RUN", ""),
    ]


def test_graph_of_nothing(spark):
    empty = [spark.createDataFrame([], s) for s in (RUNS, ITEMS, BOUND, ENTITIES)]
    assert [x.count() for x in B.literature_graph(*empty, {"gene": "Gene"})] == [0, 0]
