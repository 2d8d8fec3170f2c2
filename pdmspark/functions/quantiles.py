"""Exact quantiles by bracketing: a sketch says between which values a quantile lies, and only what is there is sorted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable

#: Places of the sketch are right to one part in so many of a group's rows; brackets are MARGIN such parts to each side.
ACCURACY, MARGIN = 10_000, 3
#: Groups of up to so many rows are sorted whole: there the margin is less than the two rows that interpolation needs.
SMALL = 2 * ACCURACY // MARGIN
#: Brackets of up to so many groups go to all tasks. Of more groups, those of over LARGE rows do.
BROADCAST_GROUPS, LARGE = 10_000, 250_000


def _joined(left: DataFrame, right: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Joined on ``by``, where null equals null; ``right`` has one row where there is no ``by``."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    right = right.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_by{i}"]) for i, c in enumerate(by)])
    return left.join(right, same, how).drop(*[f"_by{i}" for i in range(len(by))])


def _bracketed(x: DataFrame, sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows with their group's brackets; rows of a large group stay where they are, so that no task gets them all."""
    if not by:
        return _joined(x, sketch.drop("_q_n"), by, "inner")
    sketch = stable(sketch)
    if sketch.count() <= BROADCAST_GROUPS:
        return _joined(x, F.broadcast(sketch.drop("_q_n")), by, "inner")
    large, rest = (sketch.where(c).drop("_q_n") for c in (F.col("_q_n") > LARGE, F.col("_q_n") <= LARGE))
    marked = _joined(x, F.broadcast(large), by, "left")
    return marked.where("_q_b is not null").unionByName(_joined(marked.where("_q_b is null").drop("_q_b"), rest, by, "inner"))


def percentiles(df: DataFrame, by: Sequence[str], value: Column, probs: Mapping[str, float], higher: Mapping[str, float] | None = None) -> DataFrame:
    """(by, name...): linearly interpolated quantiles; those of ``higher`` are the next real value at or above the place.

    Groups without a value are not in the result; without ``by`` there is one row, of nulls if there is no value.
    NaN is the greatest value. A first pass makes a mergeable sketch of each group, a second counts what lies below each
    bracket, and the different values inside (a few parts in ``ACCURACY`` of a large group), which alone are sorted.
    """
    wanted = {**probs, **(higher or {})}
    x = df.select(*by, value.cast("double").alias("_q_v")).where("_q_v is not null")
    edges = [min(1.0, max(0.0, p + side * MARGIN / ACCURACY)) for p in wanted.values() for side in (-1, 1)]
    inf = F.lit(float("inf"))
    plain = F.when(F.isnan("_q_v"), inf).otherwise(F.col("_q_v"))
    sketch = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_q_n"), F.percentile_approx(plain, edges, ACCURACY).alias("_q_e"))
    small = F.col("_q_n") <= SMALL
    bracket = lambda i, p: F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_q_n") - 1)).alias("place"), F.when(small, -inf).otherwise(F.col("_q_e")[2 * i]).alias("low"), F.when(small, inf).otherwise(F.col("_q_e")[2 * i + 1]).alias("high"))
    sketch = sketch.select(*by, F.array(*[bracket(i, p) for i, p in enumerate(wanted.values())]).alias("_q_b"), "_q_n")
    y = _bracketed(x, sketch, by)
    n_below = [F.count_if(F.col("_q_v") < F.col("_q_b")[i]["low"]) for i in range(len(wanted))]
    below = y.groupBy(*by).agg(F.array(*n_below).alias("_q_below"))
    here = F.filter("_q_b", lambda b: (F.col("_q_v") >= b["low"]) & ((F.col("_q_v") <= b["high"]) | (b["high"] == inf)))
    inside = y.select(*by, "_q_v", F.explode(here).alias("_q_b")).groupBy(*by, "_q_b", "_q_v").agg(F.count(F.lit(1)).alias("_q_c"))
    z = _joined(inside, below, by, "inner").withColumn("_q_upto", F.element_at("_q_below", F.col("_q_b.i") + 1) + F.sum("_q_c").over(Window.partitionBy(*by, "_q_b").orderBy("_q_v")))
    at = lambda k: F.min(F.when(F.col("_q_upto") > k, F.col("_q_v")))
    found = z.groupBy(*by, "_q_b").agg(at(F.floor("_q_b.place")).alias("_q_l"), at(F.ceil("_q_b.place")).alias("_q_h"), F.min(F.col("_q_upto") - F.col("_q_c")).alias("_q_first"))
    missed = (F.col("_q_first") > F.floor("_q_b.place")) | F.col("_q_h").isNull()
    part = F.col("_q_b.place") - F.floor("_q_b.place")
    mid = F.when(F.col("_q_l") == F.col("_q_h"), F.col("_q_l")).otherwise(F.col("_q_l") + (F.col("_q_h") - F.col("_q_l")) * part)
    mid = F.when(missed, F.raise_error("a quantile lies outside its bracket")).otherwise(mid)
    aggs = [F.max(F.when(F.col("_q_b.i") == i, mid if i < len(probs) else F.when(missed, mid).otherwise(F.col("_q_h")))).alias(name) for i, name in enumerate(wanted)]
    return found.groupBy(*by).agg(*aggs)


def with_percentiles(out: DataFrame, df: DataFrame, by: Sequence[str], value: Column, probs: Mapping[str, float], higher: Mapping[str, float] | None = None) -> DataFrame:
    """``out``, a row for each group, with the ``percentiles`` of the rows of ``df``; null in groups without a value."""
    return _joined(out, percentiles(df, by, value, probs, higher), by, "left")
