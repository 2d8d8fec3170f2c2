"""Statistics without each group in turn (H4) that no sums give: quantiles, and any aggregate of mergeable states."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running_sums
from ..functions.quantiles import percentiles
from ..session import stable

#: Rows that a task of the first pass makes states of at once, and tasks that share a group of more rows than these.
HELD, SALTS = 100_000, 64
#: Groups of a range, on average.
RANGE_GROUPS = 50_000


def _next_known(df: DataFrame, at: str, then: str, value: str, name: str) -> DataFrame:
    """Adds the first ``value`` that is not null in this row or later ones by (at, then); sorted by range of ``at``."""
    placed = stable(df.repartitionByRange(at).withColumn("_range", F.spark_partition_id()))
    place = F.struct(at, then)
    later = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)  # one row a range
    ranges = placed.groupBy("_range").agg(F.min_by(value, F.when(F.col(value).isNotNull(), place)).alias("_head"))
    ranges = ranges.select("_range", F.first("_head", ignorenulls=True).over(later).alias("_comes"))
    inside = Window.partitionBy("_range").orderBy(at, then).rowsBetween(0, Window.unboundedFollowing)
    return placed.join(F.broadcast(ranges), "_range").withColumn(name, F.coalesce(F.first(value, ignorenulls=True).over(inside), "_comes")).drop("_range", "_comes")


def leave_one_group_out_quantile(df: DataFrame, group: str, col: str, p: float = 0.5) -> DataFrame:
    """H4: (group, without, influence): the exact quantile (linearly interpolated) of the values of all other groups, and
    its difference to that of all. Null where the other groups have no value; nulls of ``col`` are left out.

    The m-th value of the others is the (m + j)-th of all, where j counts the group's values that have fewer than m of the
    others at or below them. So ranks of all and ranks within groups are counted once, and no group's rest is sorted.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(col).cast("double").alias("_x"))
    each = stable(rows.groupBy("_g", "_x").agg(F.count("_x").alias("_n")))
    known = each.where("_x is not null")
    ranks = stable(running_sums(known.groupBy("_x").agg(F.sum("_n").alias("_n")), [], "_x", {"_rank": F.col("_n")}))
    n_all = ranks.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"))
    sizes = each.groupBy("_g").agg(F.sum("_n").alias("_own")).crossJoin(F.broadcast(n_all))  # one row
    place = F.lit(float(p)) * (F.col("_all") - F.col("_own") - 1)
    sizes = stable(sizes.withColumns({"_place": place, "_low": F.floor(place) + 1, "_high": F.ceil(place) + 1}))
    inside = running_sums(known, ["_g"], "_x", {"_upto": F.col("_n")})
    others = inside.join(ranks.select("_x", "_rank"), "_x").withColumn("_rest", F.col("_rank") - F.col("_upto"))
    others = others.select(F.col("_g").alias("_same"), "_n", "_rest")
    met = sizes.join(others, F.col("_g").eqNullSafe(F.col("_same")), "left").groupBy("_g", "_place", "_low", "_high", "_all", "_own")
    fewer = lambda m: F.coalesce(F.sum(F.when(F.col("_rest") < F.col(m), F.col("_n"))), F.lit(0))
    wanted = met.agg((F.col("_low") + fewer("_low")).alias("_a"), (F.col("_high") + fewer("_high")).alias("_b"))
    wanted = stable(wanted)
    asked = wanted.where("_all > _own").select(F.explode(F.array("_a", "_b")).alias("_rank")).distinct()
    marks = ranks.select("_rank", F.lit(1).alias("_kind"), "_x").unionByName(asked.select("_rank", F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_x")))
    found = stable(_next_known(marks, "_rank", "_kind", "_x", "_v").where("_kind = 0").select("_rank", "_v"))
    at = lambda r, v: found.select(F.col("_rank").alias(r), F.col("_v").alias(v))
    out = wanted.join(at("_a", "_va"), "_a", "left").join(at("_b", "_vb"), "_b", "left")
    part = F.col("_place") - F.floor("_place")
    without = F.when(F.col("_va") == F.col("_vb"), F.col("_va")).otherwise(F.col("_va") + (F.col("_vb") - F.col("_va")) * part)
    out = out.withColumn("without", F.when(F.col("_all") > F.col("_own"), without))
    whole = percentiles(rows, [], F.col("_x"), {"_whole": p})
    return out.crossJoin(F.broadcast(whole)).select(F.col("_g").alias(group), "without", (F.col("without") - F.col("_whole")).alias("influence"))  # one row


State = Any


def leave_one_group_out_merged(df: DataFrame, group: str, cols: Sequence[str], state: Callable[[pd.DataFrame], State], merge: Callable[[State, State], State], finish: Callable[[State], float | None]) -> DataFrame:
    """H4: (group, without, influence) for any aggregate: ``state`` makes a state of some rows (columns ``cols``), ``merge`` one of
    two, ``finish`` the statistic. ``merge`` is associative and commutative and leaves its arguments as they are; a state
    should be small. Null where there is no other group.

    Rows are brought together by group, a group of over ``HELD`` rows in ``SALTS`` tasks, so ``state`` is called about once
    for ``HELD`` rows of a group and for a smaller one. Groups are then put in order and cut into ranges: what is outside a
    group is what comes before and after it in its range, and the other ranges, so nothing is read again for a group.
    """
    key = F.when(F.col(group).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    load, dump = pickle.loads, pickle.dumps
    names = list(cols)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def states(frames: list[pd.DataFrame]) -> pd.DataFrame:
            x = pd.concat(frames)
            keys = x["_k"].to_numpy()
            ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]  # rows come in order of their keys
            x = x[["_salt", *names]]
            found = [(keys[a], x["_salt"].iat[a], dump(state(x.iloc[a:b][names].reset_index(drop=True)))) for a, b in zip([0, *ends], ends, strict=False)]
            return pd.DataFrame(found, columns=["_k", "_salt", "_state"])

        frames, n = [], 0
        for batch in batches:
            frames.append(batch)
            n += len(batch)
            if n >= HELD:
                yield states(frames)
                frames, n = [], 0
        if n:
            yield states(frames)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """States in order of their keys, those of a key merged as they come."""
        last, held = None, None
        for batch in batches:
            out = []
            for *k, raw in batch.itertuples(index=False, name=None):
                if last is not None and k != last:
                    out.append((*last, dump(held)))
                last, held = k, load(raw) if k != last else merge(held, load(raw))
            yield pd.DataFrame(out, columns=batch.columns)
        if last is not None:
            yield pd.DataFrame([(*last, dump(held))], columns=batch.columns)

    def by_key(x: DataFrame, keys: list[str]) -> DataFrame:
        x = x.select(*keys, "_state")
        return x.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(merged, x.schema)

    def together(by: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(x: pd.DataFrame) -> pd.DataFrame:
            return x[by].head(1).assign(_state=dump(reduce(merge, map(load, x["_state"]))))

        return run

    def outside(states: list[State]) -> list[State | None]:
        """Of each, all the others merged; None where there is none."""
        after: list[State | None] = [None]
        both = lambda a, b: b if a is None else a if b is None else merge(a, b)
        for s in reversed(states[1:]):
            after.append(both(s, after[-1]))
        out, before = [], None
        for s, a in zip(states, reversed(after), strict=True):
            out.append(both(before, a))
            before = both(before, s)
        return out

    def rest(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("_range")
        states = [load(v) for v in x["_state"]]
        whole = finish(reduce(merge, states))
        return pd.DataFrame({"_range": x["_range"], "_rest": [None if s is None else dump(s) for s in outside(states)], "_whole": whole})

    def each(x: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("_k")
        far = others["_rest"].iloc[0]
        far = None if far is None else load(far)
        near = outside([load(v) for v in x["_state"]])
        got = [n if far is None else far if n is None else merge(n, far) for n in near]
        value = pd.Series([None if s is None else finish(s) for s in got], dtype="Float64")
        return pd.DataFrame({"_k": list(x["_k"]), "without": value, "influence": value - others["_whole"].iloc[0]})

    rows = df.select(key.alias("_k"), *names)
    sizes = stable(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_size")))
    n_rows, n_groups = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    large = sizes.where(F.col("_size") > HELD)  # at most one of HELD rows
    salt = F.when(F.col("_size").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
    rows = rows.join(F.broadcast(large), "_k", "left").withColumn("_salt", salt).drop("_size")
    rows = rows.repartition(max(1, math.ceil(n_rows / HELD)), "_k", "_salt").sortWithinPartitions("_k", "_salt")
    states = by_key(rows.mapInPandas(partial, "_k string, _salt int, _state binary"), ["_k"])
    placed = stable(states.repartitionByRange(max(1, math.ceil(n_groups / RANGE_GROUPS)), "_k").withColumn("_range", F.spark_partition_id()))
    ranges = placed.groupBy("_range").applyInPandas(together(["_range"]), "_range int, _state binary")
    others = stable(ranges.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(rest, "_range int, _rest binary, _whole double"))  # one state a range
    out = placed.groupBy("_range").cogroup(others.groupBy("_range")).applyInPandas(each, "_k string, without double, influence double")
    return df.select(group).distinct().withColumn("_k", key).join(out, "_k").select(group, "without", "influence")
