"""Mergeable sketches: kept for each day and key, merged over any days without reading the rows again.

Distinct counts are HyperLogLog sketches, quantiles are KLL sketches of numbers; both are columns of a table, a few KB a row
whatever they saw, so days may be written as they end.  ``registers`` is the logarithm of a distinct sketch's size (relative
error about 0.8 / sqrt(2 ** registers)), ``k`` the size of a quantile sketch (rank error about 1.7 / k at the default).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTERS, K = 12, 400


def daily(df: DataFrame, day: Column, keys: Sequence[str], distinct: str, number: str, registers: int = REGISTERS, k: int = K) -> DataFrame:
    """(day, keys, n, distinct_sketch, number_sketch) of rows; nulls are in neither sketch."""
    value = F.col(number).cast("double")
    return df.groupBy(day.alias("day"), *keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(distinct), registers).alias("distinct_sketch"), F.kll_sketch_agg_double(value, k).alias("number_sketch"))


def merged(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """keys, n, distinct and quantiles (array, one for each share) over all rows of the sketches given."""
    g = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("_d"), F.kll_merge_agg_double("number_sketch").alias("_q"))
    return g.select(*keys, "n", F.hll_sketch_estimate("_d").alias("distinct"), F.kll_sketch_get_quantile_double("_q", F.array(*(F.lit(float(s)) for s in shares))).alias("quantiles"))
