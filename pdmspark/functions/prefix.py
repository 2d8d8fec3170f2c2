"""Global order without a single-partition window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable
from .scan import Series


def global_prefixes(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of its value over all rows up to this one in a total order.

    Rows are sorted by range; partition totals (one row each) give the offsets. Ties in ``order`` must not matter.
    """
    values = {f"_v{i}": v for i, v in enumerate(sums.values())}
    placed = stable(df.withColumns(values).repartitionByRange(*order).withColumn("_range_no", F.spark_partition_id()))
    totals = placed.groupBy("_range_no").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.orderBy("_range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range_no", *[F.sum(v).over(before).alias(f"_o{v}") for v in values])
    inside = Window.partitionBy("_range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "_range_no")
    out = out.withColumns({n: F.coalesce(F.col(f"_o{v}"), F.lit(0)) + F.sum(v).over(inside) for n, v in zip(sums, values, strict=True)})
    return out.drop("_range_no", *values, *[f"_o{v}" for v in values])


def global_prefix(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """``global_prefixes`` of one value."""
    return global_prefixes(df, order, {name: value})


def running_sums(df: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, Column], reverse: bool = False) -> DataFrame:
    """Running sums, this row included, within groups; without groups over sorted ranges. No task has all rows of a large group."""
    if not by:
        return global_prefixes(df, [F.col(order).desc() if reverse else F.col(order)], sums)
    series = Series(df, by, [order], reverse)
    return series.done(series.scan(series.rows, sums=sums))
