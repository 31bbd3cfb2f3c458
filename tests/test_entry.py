import pytest

import __spark_entry__ as entry
from evispark.plans import catalog

SF = "/root/testdata/sf0.001"


def test_entry_and_registries(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    """Each query runs; where it has an SQL twin, both give the same rows."""
    duckdb = pytest.importorskip("duckdb")
    frame = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()]
    if name not in catalog.ORACLE_SQL:
        return
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(frame.columns)
    want = [tuple(r[columns.index(c)] for c in sorted(columns)) for r in rel.fetchall()]
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    key = lambda r: repr(tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else plain(v) for v in r))
    assert sorted(map(key, rows)) == sorted(map(key, want))
