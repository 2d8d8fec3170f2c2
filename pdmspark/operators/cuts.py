"""Two cuts of a score into three classes (F13), among any number of distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import global_prefix
from ..session import stable

#: Blocks of cuts are cut in so many by each round of the search, and it starts with at most START blocks a side.
FAN, START = 8, 64
#: Numbers that a task holds at once for its running counts by class and group.
VALUES = 3_000_000
#: Objectives are compared at so many places; block bounds have this much to spare.
PLACES, SPARE = 12, 1e-10


def _placed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` sorted by range, with the number of the range."""
    return stable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def _counts(df: DataFrame, score: str, truth: str, classes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(g, t, _0, _1, _2, _a0, _a1, _a2): rows of each class by group and score, and of the group."""
    known = df.where(F.col(score).isNotNull() & F.col(truth).isin(list(classes)))
    for c in by:
        known = known.where(F.col(c).isNotNull())
    g = F.struct(*by) if by else F.lit(0)
    each = known.groupBy(g.alias("g"), F.col(score).cast("double").alias("t")).agg(*[F.count_if(F.col(truth) == c).alias(f"_{i}") for i, c in enumerate(classes)])
    each = stable(each)
    totals = each.groupBy("g").agg(*[F.sum(f"_{i}").alias(f"_a{i}") for i in range(3)])
    totals = stable(totals.withColumn("_g", F.row_number().over(Window.orderBy("g")) - 1))  # one row a group
    groups = totals.count()
    totals = totals.withColumnRenamed("g", "_same").withColumn("_groups", F.lit(groups))
    return each.join(F.broadcast(totals) if groups <= 100_000 else totals, F.col("g").eqNullSafe(F.col("_same"))).drop("_same", "g")


def _objective(counts: DataFrame, ends: bool) -> DataFrame:
    """(t, f1, f2, _range), by range: each cut with what it adds to the mean balanced accuracy as t1 and as t2.

    t1 adds (first below) - (second below), t2 (second below) + 1 - (third below): each row adds its weight to all cuts
    above its score, so one running sum over the scores serves all groups. Weights are decimals: sums are exact.
    """
    share = lambda i: F.coalesce(F.try_divide(F.col(f"_{i}").cast("decimal(12,0)"), (F.col(f"_a{i}") * F.col("_groups") * 3).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,26)")
    w = counts.select("t", (share(0) - share(1)).cast("decimal(38,26)").alias("_w1"), (share(1) - share(2)).cast("decimal(38,26)").alias("_w2"))
    scores = _placed(w.groupBy("t").agg(F.sum("_w1").alias("_w1"), F.sum("_w2").alias("_w2")), "t")
    ranges = scores.groupBy("_range").agg(F.min("t").alias("_first"), F.sum("_w1").alias("_s1"), F.sum("_w2").alias("_s2"))
    over = Window.orderBy("_range")  # one row a range
    ahead = over.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.lead("_first").over(over).alias("_after"), *[F.coalesce(F.sum(f"_s{k}").over(ahead), F.lit(0)).alias(f"_o{k}") for k in (1, 2)])
    inside = Window.partitionBy("_range").orderBy("t")
    x = scores.join(F.broadcast(ranges), "_range")
    x = x.withColumn("_next", F.coalesce(F.lead("t").over(inside), "_after")).withColumn("_mid", (F.col("t") + F.col("_next")) / 2.0)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # A midpoint that is not above the lower score, as of neighbouring doubles, has that score not below it.
    below = lambda k: F.col(f"_o{k}") + F.sum(f"_w{k}").over(upto) - F.when(F.col("_mid") > F.col("t"), F.lit(0)).otherwise(F.col(f"_w{k}"))
    cuts = x.select(F.col("_mid").alias("t"), below(1).alias("_b1"), below(2).alias("_b2")).where("t is not null")
    if ends:
        under = lambda k, e: F.sum(F.when(F.col("t") < e, F.col(f"_w{k}")).otherwise(F.lit(0)))
        edge = scores.agg(F.array(*[F.struct(F.lit(e).alias("t"), under(1, e).alias("_b1"), under(2, e).alias("_b2")) for e in (0.0, 1.0)]).alias("_e"))
        cuts = cuts.where("t not in (0.0, 1.0)").unionByName(edge.select(F.inline("_e")).where("_b1 is not null"))
    third = counts.select("_g", "_a2", "_groups").distinct().agg((F.count_if(F.col("_a2") > 0) / (F.max("_groups") * 3.0)).alias("_third"))
    cuts = cuts.crossJoin(F.broadcast(third))  # one row
    return _placed(cuts.select("t", F.round(F.col("_b1").cast("double"), PLACES).alias("f1"), (F.col("_b2").cast("double") + F.col("_third")).alias("f2")), "t")


def _with_best(f: DataFrame) -> DataFrame:
    """Adds ``best``, the struct (f, m) of the largest f1 of lower cuts and the lowest such cut, negated; null for the first."""
    own = F.struct(F.col("f1").alias("f"), (-F.col("t")).alias("m"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = f.groupBy("_range").agg(F.max(own).alias("_top")).select("_range", F.max("_top").over(ahead).alias("_came"))
    inside = Window.partitionBy("_range").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    x = f.join(F.broadcast(ranges), "_range").withColumn("best", F.greatest(F.max(own).over(inside), "_came"))
    return x.withColumn("o", F.round(F.col("best.f") + F.col("f2"), PLACES)).drop("_came")


def _curves(marks: DataFrame, groups: int) -> DataFrame:
    """Of each candidate (t, one, two, c1, c2): p0 and p2, the mean F1 of the first and third class, and by group the rows
    (n), those of the second class (b) below the cut."""

    chunk = max(1, VALUES // (3 * groups))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "kind"], kind="stable", na_position="first")
        counts, kind, g = rows[["_0", "_1", "_2"]].to_numpy(float), rows["kind"].to_numpy(), rows["_g"].to_numpy()
        totals, sums = np.zeros((3, groups)), np.zeros((3, groups))
        totals[:, g[kind == 0]] = counts[kind == 0].T
        counts[kind == 0] = 0
        out = []
        for at in range(0, len(rows), chunk):
            cut = slice(at, at + chunk)
            upto = np.zeros((len(g[cut]), 3, groups))
            upto[np.arange(len(upto)), :, g[cut]] = counts[cut]
            upto[0] += sums
            upto = upto.cumsum(axis=0)
            sums, upto = upto[-1].copy(), upto[kind[cut] == 2]
            n = upto.sum(axis=1)
            first, third = n + totals[0], totals.sum(axis=0) - n + totals[2]
            p0 = np.divide(2 * upto[:, 0], first, out=np.zeros_like(n), where=first > 0).mean(axis=1)
            p2 = np.divide(2 * (totals[2] - upto[:, 2]), third, out=np.zeros_like(n), where=third > 0).mean(axis=1)
            part = rows.iloc[cut][["t", "one", "two", "c1", "c2"]][kind[cut] == 2]
            out.append(part.assign(p0=p0, p2=p2, n=list(n), b=list(upto[:, 1])))
        return pd.concat(out)

    return marks.groupBy("_range").applyInPandas(run, "t double, one boolean, two boolean, c1 double, c2 double, p0 double, p2 double, n array<double>, b array<double>")


def _candidates(counts: DataFrame, x: DataFrame, top: float) -> DataFrame:
    """The cuts of pairs of the best accuracy, with their curves. As t2 goes with the t1 of the class (value of f1) that it
    has for its best; classes grow with t on both sides."""
    one = F.coalesce(F.col("f1") >= F.col("best.f"), F.lit(True))
    two = F.coalesce(F.col("o") == F.lit(top), F.lit(False))
    cuts = x.select("t", one.alias("one"), two.alias("two"), F.col("f1").alias("c1"), F.col("best.f").alias("c2"))
    # Only classes that some t2 asks for.
    asked = cuts.where("two").select(F.col("c2").alias("c1")).distinct().withColumn("_asked", F.lit(True))
    cuts = cuts.join(asked, "c1", "left").withColumn("one", F.col("one") & F.col("_asked").isNotNull()).drop("_asked").where("one or two")
    none = {k: F.lit(None).cast("double") for k in ("c1", "c2")} | {k: F.lit(None).cast("boolean") for k in ("one", "two")}
    rows = counts.select("t", F.lit(3).alias("kind"), "_g", "_0", "_1", "_2").withColumns(none)
    marks = cuts.select("t", F.lit(2).alias("kind"), F.lit(0).alias("_g"), *[F.lit(0).cast("long").alias(f"_{i}") for i in range(3)], "one", "two", "c1", "c2")
    names = ["t", "kind", "_g", "_0", "_1", "_2", "one", "two", "c1", "c2"]
    marks = _placed(rows.select(names).unionByName(marks.select(names)), "t")
    # What lies below each range, and the totals of all groups, come as rows before the first of the range.
    own = marks.where("kind = 3").groupBy("_range", "_g").agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(3)])
    totals = stable(counts.select("_g", *[F.col(f"_a{i}").alias(f"_{i}") for i in range(3)]).distinct())
    heads = marks.select("_range").distinct().crossJoin(totals)  # ranges by groups, as many as tasks need
    ahead = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    lower = heads.select("_range", "_g").join(own, ["_range", "_g"], "left").select("_range", "_g", F.lit(1).alias("kind"), *[F.coalesce(F.sum(f"_{i}").over(ahead), F.lit(0)).alias(f"_{i}") for i in range(3)])
    heads = heads.withColumn("kind", F.lit(0)).unionByName(lower).withColumns(none | {"t": F.lit(None).cast("double")})
    return stable(_curves(marks.select(*names, "_range").unionByName(heads.select(*names, "_range")), totals.count()))


def _sides(found: DataFrame, side: str) -> tuple[DataFrame, int]:
    """Candidates of one side by position, as blocks of one."""
    own = {"one": ("c1", "p0"), "two": ("c2", "p2")}[side]
    x = global_prefix(found.where(side), [F.col("t")], F.lit(1).cast("long"), "k").withColumn("k", F.col("k") - 1)
    cols = [F.col("t").alias("t_lo"), F.col("t").alias("t_hi"), F.col(own[0]).alias("c_lo"), F.col(own[0]).alias("c_hi"), F.col(own[1]).alias("p"), F.col(own[1]).alias("p_end")]
    x = stable(x.select("k", *cols, F.col("n").alias("n_lo"), F.col("n").alias("n_hi"), F.col("b").alias("b_lo"), F.col("b").alias("b_hi")))
    return x, x.count()


def _coarser(blocks: DataFrame, side: str) -> DataFrame:
    """Blocks of FAN blocks; p_end is the value of the cut that stands for the block: the lowest t1, the highest t2."""
    low, high, end = (lambda c: F.min_by(c, "k")), (lambda c: F.max_by(c, "k")), (F.min_by if side == "one" else F.max_by)
    ends = [f(f"{c}_{e}").alias(f"{c}_{e}") for c in ("t", "c", "n", "b") for e, f in (("lo", low), ("hi", high))]
    return stable(blocks.groupBy(F.floor(F.col("k") / FAN).alias("_up")).agg(*ends, F.max("p").alias("p"), end("p_end", "k").alias("p_end")).withColumnRenamed("_up", "k"))


def _middle(low_b: str, high_b: str, low_n: str, high_n: str) -> Column:
    """Most that the mean F1 of the second class can be, from most hits and fewest calls; exact for single cuts."""
    zipped = F.arrays_zip(F.col(high_b).alias("hb"), F.col(low_b).alias("lb"), F.col(low_n).alias("ln"), F.col(high_n).alias("hn"), F.col("a").alias("a"))

    def one(z: Column) -> Column:
        hits = F.least(F.greatest(z["hb"] - z["lb"], F.lit(0.0)), z["a"])
        return F.coalesce(F.try_divide(2.0 * hits, F.greatest(z["ln"] - z["hn"], hits) + z["a"]), F.lit(0.0))

    return F.aggregate(F.transform(zipped, one), F.lit(0.0), lambda s, v: s + v) / F.size("a")


def best_f1(counts: DataFrame, x: DataFrame, top: float) -> DataFrame:
    """(t1, t2, f1): of the pairs of the best accuracy that of the best mean macro-F1, then the lowest t1 and t2.

    Branch and bound: blocks of t1 meet blocks of t2, and pairs of blocks whose upper bound is below the value of a pair
    already known go; what stays is opened, FAN blocks a side, down to single cuts. Only that best value is on the driver.
    """
    found = _candidates(counts, x, top)
    seconds = counts.select("_g", F.col("_a1").cast("double").alias("v")).distinct().agg(F.transform(F.sort_array(F.collect_list(F.struct("_g", "v"))), lambda z: z["v"]).alias("a"))
    seconds = stable(seconds)  # one row, a number a group
    levels = [tuple(_sides(found, s) for s in ("one", "two"))]
    while max(n for _, n in levels[-1]) > START:
        levels.append(tuple((_coarser(b, s), -(-n // FAN)) for (b, n), s in zip(levels[-1], ("one", "two"), strict=True)))
    pairs = levels[-1][0][0].select(F.col("k").alias("k1")).crossJoin(levels[-1][1][0].select(F.col("k").alias("k2")))  # START blocks a side
    best = float("-inf")
    for depth, ((ones, _), (twos, _)) in enumerate(reversed(levels)):
        if depth:
            spread = lambda k: F.explode(F.sequence(F.col(k) * FAN, F.col(k) * FAN + FAN - 1)).alias(k)
            pairs = pairs.select(spread("k1"), "k2").select("k1", spread("k2"))
        left, right = (b.select(*[F.col(c).alias(f"{c}{i}") for c in b.columns]) for i, b in ((1, ones), (2, twos)))
        y = pairs.join(left, "k1").join(right, "k2").where("t_lo1 < t_hi2 and c_lo1 <= c_hi2 and c_lo2 <= c_hi1").crossJoin(F.broadcast(seconds))
        bound = (F.col("p1") + F.col("p2") + _middle("b_lo1", "b_hi2", "n_lo2", "n_hi1")) / 3.0
        # The pair of the lowest t1 and the highest t2 of the blocks is one of those asked for where its classes agree.
        known = F.when(F.col("c_lo1") == F.col("c_hi2"), (F.col("p_end1") + F.col("p_end2") + _middle("b_lo1", "b_hi2", "n_hi2", "n_lo1")) / 3.0)
        y = stable(y.select("k1", "k2", "t_lo1", "t_hi2", bound.alias("bound"), known.alias("known")).where(F.col("bound") >= F.lit(best - SPARE)))
        best = max(best, y.agg(F.max("known")).first()[0] or 0.0)
        pairs = y.where(F.col("bound") >= F.lit(best - SPARE)).select("k1", "k2")
    order = F.struct(F.round("known", PLACES).alias("v"), (-F.col("t_lo1")).alias("a"), (-F.col("t_hi2")).alias("b"))
    return y.where("known is not null").agg(F.max(order).alias("_b")).select((-F.col("_b.a")).alias("t1"), (-F.col("_b.b")).alias("t2"), F.col("_b.v").alias("macro_f1"))


def fit(df: DataFrame, score: str, truth: str, classes: Sequence[str], by: Sequence[str], ends: bool, macro_f1: bool) -> DataFrame:
    """(t1, t2, balanced_accuracy) and, if asked, macro_f1; nulls where there are no two cuts."""
    counts = _counts(df, score, truth, classes, by)
    x = stable(_with_best(_objective(counts, ends)))
    best = x.where("best is not null").agg(F.max(F.struct("o", F.col("best.m").alias("m1"), (-F.col("t")).alias("m2"))).alias("_b"))
    best = best.select((-F.col("_b.m1")).alias("t1"), (-F.col("_b.m2")).alias("t2"), F.col("_b.o").alias("balanced_accuracy"))
    if not macro_f1:
        return best
    top = best.first()["balanced_accuracy"]
    if top is None:
        return best.withColumn("macro_f1", F.lit(None).cast("double"))
    return best_f1(counts, x, top).select("t1", "t2", F.lit(top).alias("balanced_accuracy"), "macro_f1")
