"""Exact order statistics by index rule, without collecting a group's values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per group with their counts and the ranks (from 0) that they occupy.

    The partial aggregate shrinks repeats before the shuffle; ranks come from running sums of counts.
    """
    grouped = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*keys).orderBy(value)
    return grouped.withColumn("_hi", F.sum("_c").over(order)).withColumn("_lo", F.col("_hi") - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))


def pick(df: DataFrame, keys: list[str], value: str, **rules: Callable[[Column], Column]) -> DataFrame:
    """Per group, for each name the value at rank ``rule(n)`` of the sorted values."""
    ranks = counted(df, keys, value)
    out = []
    for name, rule in rules.items():
        at = rule(F.col("_n"))
        out.append(F.max(F.when((F.col("_lo") <= at) & (at < F.col("_hi")), F.col(value))).alias(name))
    return ranks.groupBy(*keys).agg(*out)


def capped_weighted_median(df: DataFrame, keys: list[str], size: str, name: str = "median") -> DataFrame:
    """The value at which half of the sum is reached, sizes over the 98th percentile counting as that percentile."""
    ranks = counted(df, keys, size)
    cap = F.max(F.when((F.col("_lo") <= F.floor(F.col("_n") * 0.98)) & (F.floor(F.col("_n") * 0.98) < F.col("_hi")), F.col(size))).over(Window.partitionBy(*keys))
    weighed = ranks.withColumn("_w", F.least(F.col(size), cap) * F.col("_c"))
    weighed = weighed.withColumn("_run", F.sum("_w").over(Window.partitionBy(*keys).orderBy(size))).withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    # the first rank whose running sum exceeds half is in the first value whose last rank does
    return weighed.where(F.col("_run") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min(size).alias(name))
