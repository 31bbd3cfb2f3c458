"""Retrieval on a graph for many targets at once: nodes found by label and value, bounded surroundings, cited evidence.

Nodes are (node, labels array<string>, ...), edges (src, dst).  Traversal is that of :mod:`graph`: frontiers are written
level by level, hubs are dealt into shares.  Null labels are none; edges that name no node bring none; an empty table gives
no rows; nodes should be unique.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .graph import bfs, undirected

#: Labels of what literature adds to terminology.
LITERATURE = ("Evidence", "Document", "ProcessingRun")


def labelled(labels: Sequence[str]) -> Column:
    """Whether a node has one of the labels."""
    return F.coalesce(F.arrays_overlap("labels", F.array(*(F.lit(x) for x in labels))), F.lit(False)) if labels else F.lit(False)


def find_nodes(nodes: DataFrame, labels: Sequence[str] = (), equal: Mapping[str, object] | None = None, limit: int = 100) -> DataFrame:
    """At most ``limit`` nodes, by id, that have all labels and the given values; a value of null equals none."""
    out = nodes
    for label in labels:
        out = out.filter(F.array_contains("labels", label))
    for name, value in (equal or {}).items():
        out = out.filter(F.col(name) == F.lit(value))
    return out.orderBy("node").limit(limit)


def surroundings(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 2, limit: int = 200, mode: str = "full") -> tuple[DataFrame, DataFrame]:
    """(target, node, depth) and (target, src, dst): for each target the nodes around its seeds (target, node), nearest first,
    then by id, ``limit`` of them at most, and the edges between them.

    The mode terminology_only leaves nodes of :data:`LITERATURE` out of what was found, and edges at them; they still count
    for the limit and lead on to others.  Seeds that are no node are not used.

    A seed brings its nearest ``limit`` nodes only.  That loses none: what is nearer to the seed is nearer to its target, so a
    node's place among its nearest seed's nodes is never behind its place among the target's.
    """
    if mode not in ("full", "terminology_only"):
        raise ValueError(f"mode is full or terminology_only, not {mode}")
    known = nodes.select("node", labelled(LITERATURE).alias("literature"))
    used = stored(seeds.select("target", "node").distinct().join(known, "node", "left_semi"))
    # Edges to what is no node are left out before the search, so they take no place.
    ids = known.select("node")
    inner = stored(edges.select("src", "dst").distinct().join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    near = bfs(undirected(inner), used.select("node").distinct(), hops, limit)
    of_target = used.withColumnRenamed("node", "seed").join(near, "seed").groupBy("target", "node").agg(F.min("depth").alias("depth"))
    place = F.row_number().over(Window.partitionBy("target").orderBy("depth", "node"))
    found = of_target.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")
    if mode == "terminology_only":
        found = found.join(known.filter(~F.col("literature")), "node", "left_semi")
    found = stored(found.select("target", "node", "depth"))
    ends = found.select("target", F.col("node").alias("dst"))
    between = found.select("target", F.col("node").alias("src")).join(inner, "src").join(ends, ["target", "dst"], "left_semi")
    return found, between.select("target", "src", "dst")


def citations(answers: DataFrame, found: DataFrame, evidence: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(answer, place, node, fields...): evidence that answers (answer, target, pos, node) name, in their order, from 1 on.

    What is no evidence node (node, fields...), or was not found for the answer's target, is dropped and takes no place; what
    an answer names twice is cited twice.  Empty fields are null.
    """
    cited = answers.join(found.select("target", "node").distinct(), ["target", "node"], "left_semi").join(evidence.select("node", *fields), "node")
    place = F.row_number().over(Window.partitionBy("answer").orderBy("pos", "node"))
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    return cited.select("answer", place.alias("place"), "node", *(text(c).alias(c) for c in fields))


def scoped_or_full(scoped: DataFrame, full: DataFrame, by: str) -> DataFrame:
    """Rows of each group: the scoped ones where one of them matches, else the full ones if one of those does, else the scoped.

    Both have the same columns, among them ``matches`` (null: no).  Groups are null-safe; rows are not made distinct.
    """
    has = lambda df, name: df.groupBy(by).agg(F.bool_or(F.coalesce("matches", F.lit(False))).alias(name))
    # One row for each group; pre-aggregated where rows stand, so a large group is never taken together.
    flag = has(scoped, "in_scoped").withColumn("in_full", F.lit(False)).unionByName(has(full, "in_full").withColumn("in_scoped", F.lit(False)))
    widened = flag.groupBy(by).agg(F.bool_or("in_scoped").alias("s"), F.bool_or("in_full").alias("f")).filter("f AND NOT s").select(F.col(by).alias("_g"))
    same = F.col(by).eqNullSafe(F.col("_g"))
    return scoped.join(widened, same, "left_anti").unionByName(full.join(widened, same, "left_semi"))
