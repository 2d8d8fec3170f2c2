"""Checked, as-of, interval and membership joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import Series


def cardinality_faults(left: DataFrame, right: DataFrame, on: Sequence[str], validate: str = "m:1") -> DataFrame:
    """The keys that break ``validate`` (1:1, 1:m, m:1), with ``side`` and ``n``."""
    out = None
    for side, df, one in (("left", left, validate[0] == "1"), ("right", right, validate[-1] == "1")):
        if one:
            d = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("side", F.lit(side))
            out = d if out is None else out.unionByName(d)
    return out if out is not None else left.select(*on).limit(0).withColumns({"n": F.lit(0).cast("long"), "side": F.lit("left")})


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "m:1", all_matched: bool = False) -> DataFrame:
    """An equi-join that raises if a key repeats on a unique side, or a left row has no match when ``all_matched``."""
    if not cardinality_faults(left, right, on, validate).isEmpty():
        raise ValueError(f"keys {list(on)} are not {validate}")
    if all_matched and not left.join(right, list(on), "left_anti").isEmpty():
        raise ValueError("left rows without a match")
    return left.join(right, list(on), how)


def keep_ids(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``ids``; never multiplies rows."""
    return df.join(ids.select(*on), list(on), "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``ids``; rows with null keys stay."""
    return df.join(ids.select(*on), list(on), "left_anti")


def _found(rows: DataFrame, events: DataFrame, by: Sequence[str], time: str, carry: Sequence[str], prefix: str, later: bool) -> DataFrame:
    """``rows`` with the carried columns of the nearest event of the group, at the row's time included; ``later`` or earlier.

    Events and rows are one series, in which a row stands on the far side of its equals among the events.
    """
    r = rows.select(*by, F.col(time).alias("_at"), F.lit(0).alias("_e"), F.struct(*rows.columns).alias("_row"), *[F.lit(None).cast(events.schema[c].dataType).alias(f"_c_{c}") for c in carry])
    e = events.select(*by, F.col(time).alias("_at"), F.lit(-1 if not later else 1).alias("_e"), F.lit(None).cast(r.schema["_row"].dataType).alias("_row"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    series = Series(r.unionByName(e), by, ["_at", "_e", *[f"_c_{c}" for c in carry[1:]]], reverse=later)
    x = series.scan(series.rows, lasts={"_f": F.when(F.col("_e") != 0, F.struct(*[F.col(f"_c_{c}") for c in carry]))}).where("_e = 0")
    return x.select("_row.*", *[F.col("_f")[f"_c_{c}"].alias(f"{prefix}{c}") for c in carry])


def asof_next(events: DataFrame, df: DataFrame, by: Sequence[str], time: str, carry: Sequence[str] = (), prefix: str = "next_") -> DataFrame:
    """The first event at or after each row's time, inclusive; ``next_<time>`` and carried columns, null if none."""
    return _found(df, events, by, time, [time, *carry], prefix, True)


def asof_prev(df: DataFrame, observed: DataFrame, by: Sequence[str], time: str, carry: Sequence[str] = (), prefix: str = "prev_") -> DataFrame:
    """C4: for each row of ``df`` the last observation at or before it; adds lag (time difference) and exact_hit."""
    out = _found(df, observed, by, time, [time, *carry], prefix, False)
    return out.withColumns({"lag": F.col(time) - F.col(f"{prefix}{time}"), "exact_hit": F.col(time) == F.col(f"{prefix}{time}")})


def window_extract(df: DataFrame, intervals: DataFrame, by: Sequence[str], ordinal: str, start: str = "start", end: str = "end", width: int = 1024) -> DataFrame:
    """Rows whose ordinal lies in [start, end] of an interval of the same group; once for each interval.

    Intervals are spread over buckets of ``width`` ordinals, so this is an equi-join and no nested loop.
    """
    spread = intervals.where(F.col(end) >= F.col(start)).withColumn("_k", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    rows = df.withColumn("_k", F.floor(F.col(ordinal) / width))
    return rows.join(spread, [*by, "_k"]).where(F.col(ordinal).between(F.col(start), F.col(end))).drop("_k")


def cohort_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """One row: shared rows (by keys) and shared groups of two cohorts."""
    rows = a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_semi").agg(F.count(F.lit(1)).alias("shared_rows"))
    groups = a.select(*group).distinct().join(b.select(*group).distinct(), list(group), "left_semi").agg(F.count(F.lit(1)).alias("shared_groups"))
    return rows.crossJoin(groups)  # one row each


def exclude_seen(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows not used before."""
    return df.join(seen.select(*keys), list(keys), "left_anti")


#: Most distinct cut points that are paired with each other.
MAX_CUTS = 2000


def ordered_pairs(cuts: DataFrame, col: str, most: int = MAX_CUTS) -> DataFrame:
    """All pairs t1 < t2 of distinct cut points. Raises beyond ``most`` of them: the grid is for small tables."""
    d = cuts.select(F.col(col).alias("t")).where("t is not null").distinct()
    if d.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} cut points")
    return d.select(F.col("t").alias("t1")).join(F.broadcast(d.select(F.col("t").alias("t2"))), F.col("t1") < F.col("t2"))


def label_consistency(df: DataFrame, events: DataFrame, by: Sequence[str], time: str, label: str, examples: int = 5) -> DataFrame:
    """One row: rows whose recorded label equals next event - time, those that differ, and a few of these."""
    x = asof_next(events, df, by, time).withColumn("_want", F.col(f"next_{time}") - F.col(time))
    same = F.col(label).eqNullSafe(F.col("_want"))
    order = F.array_sort(F.collect_list("_bad"))
    bad = x.where(~same).select(F.struct(*by, time, label, "_want").alias("_bad")).orderBy("_bad").limit(examples)
    return x.agg(F.count_if(same).alias("matched"), F.count_if(~same).alias("mismatched")).crossJoin(bad.agg(order.alias("examples")))


def cache_plan(requests: DataFrame, cache: DataFrame, key: str, order: Sequence[str], cap: int) -> DataFrame:
    """The requests that need a new call: one for each key, without those in the cache, the first ``cap`` in order."""
    first = requests.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(cache.select(key).distinct(), key, "left_anti").orderBy(*order).limit(cap)
