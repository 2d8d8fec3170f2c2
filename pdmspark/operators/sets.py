"""Set operations on tables and id sets (K1 to K3)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stack(*dfs: DataFrame) -> DataFrame:
    """K1: tables one below the other; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """K2: of rows with equal keys the first in a declared order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def set_algebra(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """K3: the distinct keys of both with ``part``: both, only_a or only_b."""
    x, y = a.select(*on).distinct().withColumn("_a", F.lit(1)), b.select(*on).distinct().withColumn("_b", F.lit(1))
    part = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "only_a").otherwise("only_b")
    return x.join(y, list(on), "full").withColumn("part", part).select(*on, "part")


def is_partition(parts: Sequence[DataFrame], whole: DataFrame, on: Sequence[str]) -> DataFrame:
    """K3: one row (overlapping, missing, foreign): all 0 if the parts are disjoint and cover the whole exactly."""
    all_ = reduce(DataFrame.unionByName, [p.select(*on).distinct() for p in parts]).groupBy(*on).agg(F.count(F.lit(1)).alias("_c"))
    met = all_.join(whole.select(*on).distinct().withColumn("_w", F.lit(1)), list(on), "full")
    return met.agg(F.count_if(F.col("_c") > 1).alias("overlapping"), F.count_if(F.col("_c").isNull()).alias("missing"), F.count_if(F.col("_w").isNull()).alias("foreign"))
