"""Approximate nearest neighbours by sharded, robust-pruned directed graphs.

Distinct vectors are dealt to shards of bounded size.  In a shard, points enter a graph in batches: a greedy search from
the shard's medoid proposes neighbours, and robust pruning keeps an edge only if no kept neighbour is nearer to the
target by the factor ``alpha``.  A shard's graph stays in one place (or a few, if there are fewer shards than tasks) and
the queries travel: each shard answers each query by a beam search over its graph, and the best of all shards are merged.
Nearness is cosine; what a beam holds is scored again in double precision on the original vectors.

Equal vectors are one point with the smallest ids of its members, so copies neither crowd the graph nor are lost.

Results: vectors that are null, empty, zero or hold null or non-finite components take no part.  Vectors of different
lengths have no cosine: each length is searched by itself.  Ties go to the smaller id.  A query has as many rows as there
are other vectors of its length, if they are fewer than k.  Rows that repeat an id and vector count once.  Empty tables
give no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors of a shard on average, queries searched together, edges of a point, beam when building and when searching,
#: points of a beam expanded at once, pruning.
SHARD, BLOCK, DEGREE, BUILD_BEAM, BEAM, WIDE, ALPHA = 20_000, 512, 32, 48, 160, 4, 1.2


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, squared distances) of the ``beam`` nearest points found for each query, nearest first, -1 and inf if fewer;
    and how many distances were evaluated.

    All queries advance together: each expands the ``wide`` nearest points of its beam that it has not expanded yet.
    """
    n, m = len(q), len(x)
    wide = min(wide, beam)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, m), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = 2 - 2 * (q @ x[start])
    seen[:, start] = True
    rows, evaluated = np.arange(n), n
    while len(rows):
        open_dist = np.where(done[rows], np.inf, dist[rows])
        at = np.argpartition(open_dist, wide - 1, axis=1)[:, :wide]
        open_ = np.isfinite(np.take_along_axis(open_dist, at, 1))
        go = open_.any(1)
        rows, at, open_ = rows[go], at[go], open_[go]
        if not len(rows):
            break
        done[rows[:, None], at] = True
        near = np.where(open_[:, :, None], graph[np.where(open_, ids[rows[:, None], at], 0)], -1).reshape(len(rows), -1)
        fresh = (near >= 0) & ~seen[rows[:, None], np.maximum(near, 0)]
        # A point that several expanded ones lead to counts once.
        order = np.argsort(np.where(fresh, near, m), axis=1, kind="stable")
        sorted_near = np.take_along_axis(np.where(fresh, near, m), order, 1)
        first = np.append(np.ones((len(rows), 1), bool), sorted_near[:, 1:] != sorted_near[:, :-1], 1) & (sorted_near < m)
        np.put_along_axis(fresh, order, first, 1)
        r, c = np.nonzero(fresh)
        found = near[r, c]
        seen[rows[r], found] = True
        evaluated += len(r)
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = 2 - 2 * np.einsum("kd,kd->k", x[found], q[rows[r]])
        all_d = np.concatenate([dist[rows], d], 1)
        order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        kept = np.take_along_axis(all_d, order, 1)
        ids[rows] = np.where(np.isfinite(kept), np.take_along_axis(np.concatenate([ids[rows], near], 1), order, 1), -1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~fresh], 1), order, 1) | ~np.isfinite(kept)
        dist[rows] = kept
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), evaluated


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Neighbours (points, degree) out of candidate ids (points, c); -1 stands for none."""
    c = np.sort(candidates, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == points[:, None]] = -1
    vectors = x[np.maximum(c, 0)]
    to_point = np.where(c >= 0, 2 - 2 * np.einsum("pcd,pd->pc", vectors, x[points]), np.inf)
    out = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        best = to_point.argmin(1)
        some = np.isfinite(to_point[rows, best])
        if not some.any():
            break
        out[some, k] = c[rows, best][some]
        between = 2 - 2 * np.einsum("pcd,pd->pc", vectors, vectors[rows, best])
        # Distances are squared, and so is alpha's factor.
        to_point[(alpha * alpha * between <= to_point) & some[:, None]] = np.inf
        to_point[rows, best] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(graph, entry point) over unit vectors; points enter in batches that double."""
    n = len(x)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(5).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at, size = 1, 16
    while at < n:
        batch = order[at : at + size]
        at += len(batch)
        size = min(2 * size, BLOCK)
        found, _, _ = beam_search(x, graph, start, x[batch], beam)
        graph[batch] = robust_prune(x, batch, found, alpha, degree)
        # Each new edge is offered backwards; points offered any are pruned anew.
        to = graph[batch].ravel()
        back = np.repeat(batch, degree)[to >= 0]
        to = to[to >= 0]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        which, first, count = np.unique(to, return_index=True, return_counts=True)
        width = int(min(count.max(), 2 * degree)) if len(count) else 0
        nth = np.arange(len(to)) - np.repeat(first, count)
        offered = np.full((len(which), width), -1, np.int64)
        inside = nth < width
        offered[np.repeat(np.arange(len(which)), count)[inside], nth[inside]] = back[inside]
        for a in range(0, len(which), BLOCK):
            some = which[a : a + BLOCK]
            graph[some] = robust_prune(x, some, np.concatenate([graph[some], offered[a : a + BLOCK]], 1), alpha, degree)
    return graph, start


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision; scaled by the largest component first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision between vectors a (n, d) and b (n, k, d)."""
    return np.einsum("nd,nkd->nk", a, b) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(2)))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id long, v array<double>, n int) of the vectors that take part; n is their length."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL")
    return rows.filter(finite & (F.size("v") > 0) & F.exists("v", lambda e: e != 0)).withColumn("n", F.size("v"))


ROWS = "n int, shard int, replica int, query_id long, v array<double>, graph binary, x binary, start int, ids binary, sizes binary"


def _search(k: int, beam: int):
    def answer(shard: dict, query_ids: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        x, ids, stops = shard["x"], shard["ids"], shard["stops"]
        found, _, _ = beam_search(shard["unit"], shard["graph"], shard["start"], _unit(q), min(max(beam, k + 1), len(x)))
        score = np.where(found >= 0, cosine(q, x[np.maximum(found, 0)]), -np.inf)
        out_q, out_v, out_s = [], [], []
        for i, query in enumerate(query_ids.tolist()):
            # No more than k + 1 points can hold the k nearest, but for ties.
            limit = np.sort(score[i])[::-1][min(k, found.shape[1] - 1)]
            hits = np.flatnonzero((found[i] >= 0) & (score[i] >= limit))
            points = found[i][hits]
            at = np.concatenate([np.arange(stops[p], stops[p + 1]) for p in points]) if len(points) else np.zeros(0, np.int64)
            v, s = ids[at], np.repeat(score[i][hits], stops[points + 1] - stops[points])
            other = v != query
            v, s = v[other], s[other]
            best = np.lexsort((v, -s))[:k]
            out_q.append(np.full(len(best), query))
            out_v.append(v[best])
            out_s.append(s[best])
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (n, shard, replica), a shard's graph before its queries."""
        shard: dict = {}
        for pdf in frames:
            is_graph = pdf["graph"].notna().to_numpy()
            cuts = [*np.flatnonzero(is_graph).tolist(), len(pdf)]
            for a, z in [(0, cuts[0]), *zip(cuts[:-1], cuts[1:], strict=True)]:
                if a < z and is_graph[a]:
                    r = pdf.iloc[a]
                    x = np.frombuffer(r["x"]).reshape(-1, int(r["n"]))
                    sizes = np.frombuffer(r["sizes"], np.int64)
                    graph = np.frombuffer(r["graph"], np.int32).reshape(len(x), -1)
                    shard = {"x": x, "unit": _unit(x), "graph": graph, "start": int(r["start"]), "ids": np.frombuffer(r["ids"], np.int64), "stops": np.append(0, np.cumsum(sizes))}
                    a += 1
                for i in range(a, z, BLOCK):
                    part = pdf.iloc[i : min(i + BLOCK, z)]
                    yield answer(shard, part["query_id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.float64))

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", shard_size: int = SHARD, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query among all vectors but its own id."""
    points = usable(vectors, id_col, vec_col)
    # A class of equal vectors is known by its k + 1 smallest ids; Spark keeps only those of each task before shuffling.
    first = Window.partitionBy("v").orderBy("vec_id")
    members = points.withColumn("r", F.dense_rank().over(first)).filter(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    classes = materialize(members.withColumn("n", F.size("v")))
    sizes = materialize(classes.groupBy("n").agg(F.ceil(F.count("*") / F.lit(shard_size)).cast("int").alias("shards")))
    total = sizes.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Several copies of a graph where there are fewer shards than tasks to answer side by side.
    replicas = max(1, -(-parts // max(total, 1)))
    spread = min(4 * max(total, 1), 20_000)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        graph, start = build(_unit(x))
        counts = np.array([len(i) for i in pdf["ids"]], np.int64)
        ids = np.concatenate(list(pdf["ids"])).astype(np.int64)
        row = {"n": int(pdf["n"].iloc[0]), "shard": int(pdf["shard"].iloc[0]), "graph": graph.astype(np.int32).tobytes(), "x": x.tobytes(), "start": start, "ids": ids.tobytes(), "sizes": counts.tobytes()}
        return pd.DataFrame([row])

    dealt = classes.join(F.broadcast(sizes), "n").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))
    # The number of partitions is given, so that no task is made to build several graphs for their being small.
    graphs = materialize(dealt.repartition(spread, "n", "shard").groupBy("n", "shard").applyInPandas(make, "n int, shard int, graph binary, x binary, start int, ids binary, sizes binary"))
    copies = graphs.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))).withColumns({"query_id": F.lit(None).cast("long"), "v": F.lit(None).cast("array<double>")})
    asked = usable(queries, id_col, vec_col).withColumnRenamed("vec_id", "query_id").dropDuplicates()
    # Every query meets every shard of its length once; that is the searches' own work, done side by side.
    sent = asked.join(F.broadcast(sizes), "n").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("replica", F.pmod(F.xxhash64("query_id", "v"), F.lit(replicas)).cast("int"))
    empty = {c: F.lit(None).cast(t) for c, t in (("graph", "binary"), ("x", "binary"), ("start", "int"), ("ids", "binary"), ("sizes", "binary"))}
    names = [c.split()[0] for c in ROWS.split(", ")]
    met = copies.select(names).unionByName(sent.withColumns(empty).select(names)).repartition(min(4 * max(total, 1) * replicas, 20_000), "n", "shard", "replica")
    hits = met.sortWithinPartitions("n", "shard", "replica", F.col("graph").isNull()).mapInPandas(_search(k, beam), "query_id long, vec_id long, score double")
    single = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return single.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
