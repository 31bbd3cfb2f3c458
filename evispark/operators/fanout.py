"""Searches that ask many providers and stop early, with the order in which providers answer given as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def answered(plan: DataFrame, counts: DataFrame, limit: int, early_stop: bool = True) -> DataFrame:
    """plan (request, provider, done) rows whose answers are taken, and so many items as they brought.

    Answers are taken in order of ``done`` until twice ``limit`` items are there and at least two, and half of the request's
    providers, have answered; counts (request, provider, n) has no row for a provider without items.
    """
    w = Window.partitionBy("request").orderBy("done", "provider")
    j = plan.join(counts, ["request", "provider"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    asked = F.count("*").over(Window.partitionBy("request"))
    enough = (F.coalesce(F.sum("n").over(before), F.lit(0)) >= 2 * limit) & (F.count("*").over(before) >= F.greatest(F.lit(2), F.floor(asked / 2)))
    taken = j.withColumn("_enough", enough if early_stop else F.lit(False))
    return taken.filter(~F.col("_enough")).select("request", "provider", "done", "n")


def threshold_depth(lists: DataFrame, k: int) -> DataFrame:
    """(request, depth): how deep ranked lists must be read until no unseen item can be among the k best by summed score.

    lists (request, provider, rank from 1, item, score) are sorted by falling score.  At a depth an unseen item has at most
    the sum of the scores there (lists that ended count 0), the threshold.  An item counts from the depth at which it was
    seen and the threshold is no more than its own sum; the k-th such depth ends the search.  Requests with fewer than k
    items are read to their end.
    """
    ends = lists.groupBy("request").agg(F.max("rank").cast("long").alias("deepest"))
    limits = lists.groupBy("request", F.col("rank").cast("long").alias("depth")).agg(F.sum("score").alias("value"))
    items = lists.groupBy("request", "item").agg(F.sum("score").alias("value"), F.min("rank").cast("long").alias("seen"))
    # Thresholds fall with depth: those above an item's sum are the depths before the one at which it counts.
    both = limits.select("request", "value", F.lit(1).alias("_limit"), F.lit(None).cast("long").alias("seen")).unionByName(items.select("request", "value", F.lit(0).alias("_limit"), "seen"))
    above = F.sum("_limit").over(Window.partitionBy("request").orderBy(F.desc("value"), "_limit").rowsBetween(Window.unboundedPreceding, 0))
    counted = both.withColumn("_above", above).filter("_limit = 0").select("request", F.greatest("seen", F.col("_above") + 1).alias("depth"))
    place = F.row_number().over(Window.partitionBy("request").orderBy("depth"))
    kth = counted.withColumn("_r", place).filter(F.col("_r") == k).select("request", "depth")
    return ends.join(kth, "request", "left").select("request", F.least("deepest", F.coalesce("depth", "deepest")).alias("depth"))


def top_items(lists: DataFrame, k: int) -> DataFrame:
    """(request, item, score, place): the k best items by summed score, ties to the smaller item, of those that
    :func:`threshold_depth` reads."""
    deep = lists.join(threshold_depth(lists, k), "request").filter(F.col("rank") <= F.col("depth")).select("request", "item").distinct()
    total = lists.join(deep, ["request", "item"], "left_semi").groupBy("request", "item").agg(F.sum("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "item"))
    return total.withColumn("place", place).filter(F.col("place") <= k)
