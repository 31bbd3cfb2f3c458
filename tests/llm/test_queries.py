"""Registered queries of the training-data operators against their SQL twins."""

import duckdb
import pytest

from evispark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    frame = queries.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    found = [d[0] for d in rel.description]
    assert sorted(found) == columns
    want = sorted(repr(tuple(r[found.index(c)] for c in columns)) for r in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect()) == want
