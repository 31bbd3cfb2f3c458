"""Relational idioms: top-1 and first-wins rows, upserts, read models, paging, deltas, diffs.

Everything is declared on DataFrames; order is always data (a position column or a total sort key), never the order of
partitions.  Keys compare null-safely wherever an upsert identifies rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

STATUS_PRIORITY = {"found": 4, "source_invalid": 3, "ocr_gap": 2, "table_ungrounded": 1, "not_found": 0}
REVIEW_SEVERITY = {"provisional": 0, "approved": 1, "corrected": 2, "rejected": 3}


def decode(column: Column, table: dict[str, int], default: int = -1) -> Column:
    """Rank of a status by a small literal table."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def top_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order; Spark limits rows per key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def best_tier(df: DataFrame, keys: Sequence[str], tier: Column) -> DataFrame:
    """All rows of each key's lowest tier (a rank, so ties stay)."""
    w = Window.partitionBy(*keys).orderBy(tier)
    return df.withColumn("_rank", F.rank().over(w)).filter("_rank = 1").drop("_rank")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """Latest row of each key of both tables; changes win at equal versions."""
    both = base.withColumn("_src", F.lit(0)).unionByName(changes.withColumn("_src", F.lit(1)))
    return top_one(both, keys, [*version, F.desc("_src")]).drop("_src")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys equal each other; the right side's keys are dropped."""
    a, b = left.alias("a"), right.alias("b")
    cond = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    rest = [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return a.join(b, cond, how).select("a.*", *([] if how in ("left_semi", "left_anti") else rest))


def owned_by(df: DataFrame, owner: str | None, column: str = "owner_user_id") -> DataFrame:
    """Rows of an owner; without one, the rows that nobody owns."""
    return df.filter(F.col(column).eqNullSafe(F.lit(owner)))


def overlay(base: DataFrame, patches: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields of a patch row replace the base's where they are not null."""
    p = patches.select(*keys, *(F.col(f).alias(f"_p_{f}") for f in fields))
    out = base.join(p, list(keys), "left")
    return out.select(*(F.coalesce(f"_p_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns))


def deltas(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, field, old_value, new_value) of the fields that differ, nulls being a value."""
    o = old.select(*keys, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("o"))
    n = new.select(*keys, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("n"))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").alias("old_value"), F.col(f"n.{f}").alias("new_value")) for f in fields))
    rows = o.join(n, list(keys)).select(*keys, F.explode(F.filter(pairs, lambda d: ~d["old_value"].eqNullSafe(d["new_value"]))).alias("d"))
    return rows.select(*keys, "d.field", "d.old_value", "d.new_value")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def canonical_fold(df: DataFrame, identity: Sequence[str], arrival: str, status: str, confidence: str, text: str) -> DataFrame:
    """The current best row of each identity after folding rows in order of arrival, and whether a conflict was raised.

    A row replaces the best so far if its status ranks higher, or equally with higher confidence; ties keep the
    incumbent.  Each row that does not win raises the flag if the best then differs from it in status or text; one that
    wins leaves no conflict.  The flag is that of the last fold step.
    """
    score = F.struct(decode(F.col(status), STATUS_PRIORITY).alias("p"), F.coalesce(F.col(confidence).cast("double"), F.lit(0.0)).alias("c"), (-F.col(arrival)).alias("a"))
    w = Window.partitionBy(*identity).orderBy(arrival)
    run = df.withColumn("_score", score).withColumn("_best", F.max(F.struct("_score", F.struct(*df.columns).alias("row"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = F.col("_best.row")
    conflict = ~b[status].eqNullSafe(F.col(status)) | ~b[text].eqNullSafe(F.col(text))
    last = top_one(run.withColumn("conflict_flag", conflict), identity, [F.desc(arrival)])
    return last.select("_best.row.*", "conflict_flag")


def running_best(df: DataFrame, keys: Sequence[str], order: Column, value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.max(value).over(w))


def pivot_first(df: DataFrame, keys: Sequence[str], order: str, kind: str, value: str, kinds: dict[str, str]) -> DataFrame:
    """For each key and named kind the first non-null value in order; one hash aggregation."""
    aggs = [F.min_by(F.when(F.col(kind) == k, F.col(value)), F.when((F.col(kind) == k) & F.col(value).isNotNull(), F.col(order))).alias(name) for name, k in kinds.items()]
    return df.groupBy(*keys).agg(*aggs)


def incomplete_groups(df: DataFrame, group: str, *conditions: Column) -> DataFrame:
    """Rows of groups in which not every condition holds for some row, and rows without a group."""
    needs = reduce(lambda a, b: a & b, [F.bool_or(c) for c in conditions])
    complete = df.filter(F.col(group).isNotNull()).groupBy(group).agg(needs.alias("_ok")).filter("_ok").select(group)
    return df.filter(F.col(group).isNotNull()).join(complete, group, "left_anti").unionByName(df.filter(F.col(group).isNull()).select(*df.columns))


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """df, to be broadcast, if it has at most ``most`` rows; else an error, as every row would meet all of it."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"{what} has more than {most} rows")
    return F.broadcast(df)


def running_total(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """df with the sum of ``value`` over all rows up to each one in the given order, without a task that sees all rows.

    Rows are range-sorted and written; each partition adds up its own, and one sum for each partition comes to the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = sorted(out.groupBy("_part").agg(F.sum(value).alias("s")).collect())
    kind = "double" if any(isinstance(r["s"], float) for r in sums) else "long"
    bases, total = [], 0.0 if kind == "double" else 0
    for r in sums:
        bases.append((r["_part"], total))
        total += r["s"]
    base = F.broadcast(spark.createDataFrame(bases, f"_part int, _base {kind}"))  # a row for each partition
    upto = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("_sofar", upto).join(base, "_part").withColumn(name, F.col("_base") + F.col("_sofar")).drop("_part", "_sofar", "_base")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with each row's position in the given order, from 0."""
    return running_total(df, order, F.lit(1), name).withColumn(name, F.col(name) - 1)


def densify(df: DataFrame, groups: DataFrame, catalog: DataFrame, keys: Sequence[str], defaults: dict[str, object], most: int = 10_000) -> DataFrame:
    """A row for each group and catalog entry, defaults where df has none; the catalog has at most ``most`` rows."""
    grid = groups.join(bounded(catalog, most, "the catalog"))
    out = grid.join(df, list(keys), "left")
    return out.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in out.columns))


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row that sorts first within each key."""
    return top_one(df, keys, order)


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold; a gate accepts a row whose array is empty."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))


def first_wins(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    return top_one(df, keys, [F.asc(position)])


def replace_all(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last writer wins for each key."""
    return top_one(df, keys, [F.desc(version)])


def merge_properties(df: DataFrame, keys: Sequence[str], version: str, properties: str) -> DataFrame:
    """Property maps of a key folded in order of version, later entries replacing earlier ones."""
    entries = df.select(*keys, version, F.explode(properties).alias("_k", "_v"))
    last = entries.groupBy(*keys, "_k").agg(F.max_by("_v", version).alias("_v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(properties))


def with_endpoints(edges: DataFrame, nodes: DataFrame, node_id: str = "node_id", ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """Edges whose two ends exist."""
    for end in ends:
        edges = edges.join(nodes.select(F.col(node_id).alias(end)), end, "left_semi")
    return edges


def profile(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(column, non_null) of every column, and (duplicate_keys) of a composite key as a row of its own."""
    counts = df.agg(*(F.count(c).alias(c) for c in df.columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in df.columns))
    rows = counts.select(F.explode(pairs).alias("r")).select("r.*")
    dup = df.groupBy(*key).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_keys").alias("name"), "n")
    return rows.unionByName(dup)
