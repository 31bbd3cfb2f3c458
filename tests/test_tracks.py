"""Queries of spans where lines share an id: the first in the table counts, whatever its files' sizes."""

import os
import tempfile

import pytest

from evispark.plans import catalog


@pytest.mark.parametrize("name", ["e21_narrowest_pair", "e22_projected", "e23_first_block"])
def test_first_line_of_an_id_in_the_table(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    line = lambda lo, n, shift: f"SELECT i // 3 AS l_orderkey, (i * 7 + {shift}) % 500 AS l_partkey, (i + {shift}) % 5 AS l_suppkey, CAST(i % 3 AS INTEGER) AS l_linenumber, CAST((i + {shift}) % 50 + 1 AS DOUBLE) AS l_quantity FROM range({lo}, {lo + n}) r(i)"
    con = duckdb.connect()
    con.sql("SET threads = 1")
    # The larger file, which Spark reads first, is the second one.
    os.mkdir(f"{folder}/lineitem.parquet")
    con.sql(f"COPY ({line(0, 300, 0)}) TO '{folder}/lineitem.parquet/a.parquet' (FORMAT parquet)")
    con.sql(f"COPY ({line(0, 3000, 11)}) TO '{folder}/lineitem.parquet/b.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    rel = con.sql(catalog.ORACLE_SQL[name])
    frame = catalog.QUERIES[name](spark, folder).select(*[d[0] for d in rel.description])
    assert sorted(map(tuple, frame.collect())) == sorted(rel.fetchall())
