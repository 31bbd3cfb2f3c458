"""Queries over whole tables, against brute force."""

import tempfile

import numpy as np
import pytest

from evispark.operators import matching as M
from evispark.plans import catalog

SF = "/root/testdata/sf0.001"


def test_nearest_of_every_hundredth_vector(spark):
    rows = sorted(((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()))
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in catalog.QUERIES["e9_knn_whole"](spark, SF).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["score"]
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    for q, ranks in got.items():
        want = np.sort((unit @ unit[ids == q][0])[ids != q])[::-1][:5]
        assert np.allclose([ranks[k] for k in sorted(ranks)], want, atol=2e-6)
    assert catalog.QUERIES["e10_margin_whole"](spark, SF).count() == len(got)


def test_many_queries_are_answered_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 7 + 1), float(i)]) for i in range(40)], "vec_id long, embedding array<float>")
    q = df.selectExpr("vec_id AS query_id", "embedding AS q")
    rows = lambda n: sorted(tuple(r[c] for c in ("query_id", "vec_id", "rank")) for r in M.k_nearest(q, df, 3, n).collect())
    assert rows(10) == rows(1000) and len(rows(10)) == 120


def test_section_state_and_graded_match_read_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    marks = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    # Documents beyond the ids that the SQL twins read.
    fixture = Fixture(spark, [(i + 1000, t) for i, t in docs.items()], [(r["item_id"] + 1000, r["text"]) for r in marks])
    state = {r["doc_id"]: (r["n"], r["kept"]) for r in fixture.run("h78_section_state_whole")}
    want = {}
    for i, text in docs.items():
        if text is not None:
            keep, kept, lines = True, 0, text.split("\n")
            for k, line in enumerate(lines):
                keep = k % 2 == 0 if len(line) <= 60 else keep
                kept += keep
            want[i + 1000] = (len(lines), kept)
    assert state == want
    kinds = {}
    for r in marks:
        a, b = (docs.get(r["item_id"]) or "").lower(), r["text"].lower()
        kind = "missing" if docs.get(r["item_id"]) is None else "exact" if a == b else "normalized" if b in a else "wrong_value"
        kinds[kind] = kinds.get(kind, 0) + 1
    assert {r["match_type"]: r["n"] for r in fixture.run("e17_graded_match_whole")} == kinds


@pytest.mark.parametrize(("name", "cut"), [("h35_category", "WHERE l_orderkey < 200"), ("j21_weight_grid", "WHERE l_orderkey < 500"), ("n_ranking_windows", "WHERE l_orderkey < 1000"), ("d8_group_pairs", "WHERE user_id < 20")])
def test_whole_tables_equal_the_sql_without_its_cut(spark, name, cut):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert cut not in catalog.ORACLE_SQL[name]
    rel = con.sql(catalog.ORACLE_SQL[name])
    frame = catalog.QUERIES[f"{name}_whole"](spark, SF).select(*[d[0] for d in rel.description])
    key = lambda r: repr([round(float(v), 6) if isinstance(v, float | int) else v for v in r])
    assert sorted(map(key, frame.collect())) == sorted(map(key, rel.fetchall()))


def test_resampling_has_the_reference_counts(spark):
    assert catalog.QUERIES["j10_clustered_bootstrap_whole"](spark, SF).count() == 5000
    p = catalog.QUERIES["j4_permutation_whole"](spark, SF).first()["p"]
    assert abs(p * 10001 - round(p * 10001)) < 0.01
    for name in ("j2_bootstrap_whole", "j3_paired_bootstrap_whole"):
        r = catalog.QUERIES[name](spark, SF).first()
        assert r["low"] < r["high"]


class Fixture:
    def __init__(self, spark, documents, benchmark):
        self.spark, self.dir = spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{self.dir}/documents.parquet")
        spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{self.dir}/benchmark.parquet")

    def run(self, name):
        return catalog.QUERIES[name](self.spark, self.dir).collect()
