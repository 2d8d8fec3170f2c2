"""Reproducible samples, quotas, splits and folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_integer, hash_uniform
from ..functions.prefix import global_prefix
from .metrics import ratio


def band_sample(df: DataFrame, band: str, rates: Mapping[str, float], key: Sequence[str], seed: str | int = 42) -> DataFrame:
    """G1: a hash sample at each band's rate, with inclusion_probability and weight; bands without a rate are left out."""
    p = F.lit(None).cast("double")
    for name, rate in rates.items():
        p = F.when(F.col(band) == name, F.lit(float(rate))).otherwise(p)
    out = df.withColumn("inclusion_probability", p).where(hash_uniform(*key, seed=seed) < F.col("inclusion_probability"))
    return out.withColumn("weight", F.lit(1.0) / F.col("inclusion_probability"))


def population_counts(df: DataFrame, band: str) -> DataFrame:
    """G1: the exact size of each band."""
    return df.groupBy(band).agg(F.count(F.lit(1)).alias("population"))


def water_fill(counts: DataFrame, key: str, n: str, cap: int) -> DataFrame:
    """Integer ``quota`` per group under a total cap: the largest level L with sum(min(n, L)) <= cap, and what is
    left one by one to the first groups, in key order, that have more. One row a group."""
    order = Window.orderBy(n, key)
    before = F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.count(F.lit(1)).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.row_number().over(order) + 1
    x = counts.withColumn("_x", F.floor(F.greatest(F.lit(cap) - before, F.lit(0)) / rest))
    level = F.coalesce(F.max(F.when(F.col(n) > F.col("_x"), F.col("_x"))).over(Window.partitionBy()), F.max(n).over(Window.partitionBy()))
    x = x.withColumn("_l", level).withColumn("_q", F.least(F.col(n), F.col("_l")))
    left = F.lit(cap) - F.sum("_q").over(Window.partitionBy())
    place = F.sum((F.col(n) > F.col("_l")).cast("int")).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumns({"_left": left, "_place": place})
    return x.withColumn("quota", (F.col("_q") + F.when((F.col(n) > F.col("_l")) & (F.col("_place") <= F.col("_left")), 1).otherwise(0)).cast("long")).drop("_x", "_l", "_q", "_left", "_place")


def spread_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], quota: str) -> DataFrame:
    """``quota`` rows of each group at evenly spaced ordinals: (i * (n - 1)) div (q - 1), i < q; the first if q is 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    x = x.withColumn("_k", F.least(F.col(quota), F.col("_n")))
    # Ordinal i is taken if some j < q has (j * (n - 1)) div (q - 1) = i; the least j reaching i is the candidate.
    j = F.expr("cast((_i * (_k - 1) + _n - 2) div greatest(_n - 1, 1) as long)")
    hit = F.expr("(_j * (_n - 1)) div greatest(_k - 1, 1)") == F.col("_i")
    x = x.withColumn("_j", j)
    return x.where(((F.col("_k") == 1) & (F.col("_i") == 0)) | ((F.col("_k") > 1) & (F.col("_j") < F.col("_k")) & hit)).drop("_i", "_n", "_k", "_j")


def percentile_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], pcts: Sequence[int]) -> DataFrame:
    """The rows at floor(p / 100 * (n - 1)) of each group; a row hit by several percentiles has them all in ``percentiles``."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    hit = F.array(*[F.when(F.expr(f"({int(p)} * (_n - 1)) div 100") == F.col("_i"), F.lit(int(p))) for p in pcts])
    return x.withColumn("percentiles", F.filter(hit, lambda p: p.isNotNull())).where(F.size("percentiles") > 0).drop("_i", "_n")


def choose_grid(counts: DataFrame, n: str, cap: int, grids: Sequence[int] = (10, 5, 2, 1)) -> DataFrame:
    """The largest grid whose total rows, sum(min(n, grid)), fit the cap: (grid, total_rows); null if none does."""
    one = counts.agg(*[F.sum(F.least(F.col(n), F.lit(g))).alias(f"_{g}") for g in grids])
    pick = F.coalesce(*[F.when(F.col(f"_{g}") <= cap, F.struct(F.lit(g).alias("grid"), F.col(f"_{g}").alias("total_rows"))) for g in sorted(grids, reverse=True)])
    return one.select(pick.alias("_p")).select("_p.*")


def sample_per_cell(df: DataFrame, cells: Sequence[str], k: int, key: Sequence[str], seed: str | int = 42) -> DataFrame:
    """The same number of rows of each cell in hash order: k, or what the smallest cell has. ``available`` is the cell's size."""
    w = Window.partitionBy(*cells)
    x = df.withColumns({"available": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(hash_integer(*key, seed=seed), *key))})
    least = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("_c")).agg(F.min("_c").alias("_least"))
    return x.crossJoin(F.broadcast(least)).where(F.col("_r") <= F.least(F.lit(k), F.col("_least"))).drop("_r", "_least")  # one row


def one_per_group(df: DataFrame, cells: Sequence[str], group: str, k: int, key: Sequence[str], seed: str | int = 42) -> DataFrame:
    """Per cell, in hash order, the first row of each group and of these the first k."""
    x = df.withColumn("_h", hash_integer(*key, seed=seed))
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy(*cells, group).orderBy("_h", *key))).where("_r = 1")
    return x.withColumn("_r", F.row_number().over(Window.partitionBy(*cells).orderBy("_h", *key))).where(F.col("_r") <= k).drop("_r", "_h")


def group_split(df: DataFrame, group: str, fraction: float, seed: str | int = 42) -> DataFrame:
    """``part`` test for the first ceil(fraction * groups) groups in hash order, else train; groups stay whole."""
    g = df.select(group).distinct().withColumn("_h", hash_integer(group, seed=seed))
    n = g.agg(F.ceil(F.count(F.lit(1)) * F.lit(float(fraction))).alias("_k"))
    # Groups are ranked within hash ranges and the ranges' counts, so that no task sees all of them.
    ranked = global_prefix(g, [F.col("_h"), F.col(group)], F.lit(1).cast("long"), "_r").crossJoin(F.broadcast(n))
    return df.join(ranked.select(group, F.when(F.col("_r") <= F.col("_k"), "test").otherwise("train").alias("part")), group)


def equipment_split(df: DataFrame, equipment: str, seq: str, min_n: int = 4, seed: str | int = 42) -> DataFrame:
    """(equipment, seq, part): with ``min_n`` sequences or more, max(1, round(0.2 n)) are test; of the others, per
    equipment, max(1, round(0.1 n)) are validation if there are ``min_n``; else all train. Rounding is half even."""
    s = df.select(equipment, seq).distinct().withColumn("_h", hash_integer(equipment, seq, seed=seed))
    w = Window.partitionBy(equipment)
    s = s.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy("_h", seq))})
    share = lambda n, p: F.when(n >= min_n, F.greatest(F.lit(1), F.bround(n * F.lit(p), 0).cast("int"))).otherwise(F.lit(0))
    s = s.withColumn("_t", share(F.col("_n"), 0.2))
    s = s.withColumn("_v", share(F.col("_n") - F.col("_t"), 0.1))
    part = F.when(F.col("_r") <= F.col("_t"), "test").when(F.col("_r") <= F.col("_t") + F.col("_v"), "validation").otherwise("train")
    return s.select(equipment, seq, part.alias("part"))


def group_folds(df: DataFrame, group: str, k: int, strata: str | None = None, seed: str | int = 42) -> DataFrame:
    """(group, fold 1 to k): whole groups, dealt to and fro by falling size so that folds are of like size.

    With ``strata`` the groups of each dominant stratum are dealt alike.
    """
    size = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    if strata:
        each = df.groupBy(group, strata).agg(F.count(F.lit(1)).alias("_c"))
        top = each.groupBy(group).agg(F.max_by(strata, F.struct("_c", strata)).alias("_s"))
        size = size.join(top, group)
    else:
        size = size.withColumn("_s", F.lit(0))
    r = F.row_number().over(Window.partitionBy("_s").orderBy(F.desc("_n"), hash_integer(group, seed=seed), group)) - 1
    x = size.withColumn("_r", r)
    at, back = F.pmod("_r", F.lit(k)), F.pmod(F.floor(F.col("_r") / k), F.lit(2)) == 1
    return x.select(group, F.when(back, k - at).otherwise(at + 1).cast("int").alias("fold"))


def largest_k(df: DataFrame, group: str, cell: Sequence[str], options: Sequence[int] = (5, 4, 3, 2)) -> int | None:
    """The largest k for which every cell has k groups or more, hence can be on both sides of each fold."""
    least = df.groupBy(*cell).agg(F.countDistinct(group).alias("g")).agg(F.min("g")).first()[0] or 0
    return next((k for k in sorted(options, reverse=True) if least >= k), None)


def leak_check(df: DataFrame, group: str, part: str, key: Sequence[str]) -> DataFrame:
    """One row of faults: groups in two parts, repeated physical keys, rows without a part. All 0 for a sound split."""
    groups = df.groupBy(group).agg(F.countDistinct(part).alias("p")).agg(F.count_if(F.col("p") > 1).alias("split_groups"))
    keys = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("repeated_keys"))
    rows = df.agg(F.count_if(F.col(part).isNull()).alias("rows_without_part"))
    return groups.crossJoin(keys).crossJoin(rows)  # one row each


def sample_audit(df: DataFrame, cells: Sequence[str], group: str, label: str, min_pos: int = 30, min_neg: int = 30, min_groups: int = 10) -> DataFrame:
    """Per cell: samples, groups, rows of the largest group and its share, positives, negatives, and feasible."""
    g = df.groupBy(*cells, group).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label).cast("boolean")).alias("_p"))
    out = g.groupBy(*cells).agg(F.sum("_n").alias("n_samples"), F.count(F.lit(1)).alias("n_groups"), F.max("_n").alias("max_per_group"), F.sum("_p").alias("n_pos"))
    out = out.withColumns({"largest_share": ratio(F.col("max_per_group"), F.col("n_samples")), "n_neg": F.col("n_samples") - F.col("n_pos")})
    return out.withColumn("feasible", (F.col("n_pos") >= min_pos) & (F.col("n_neg") >= min_neg) & (F.col("n_groups") >= min_groups))


def group_use(available: DataFrame, used: DataFrame, cells: Sequence[str], group: str) -> DataFrame:
    """Per cell: the groups available, those used, and their share; used groups are those of ``used`` that are available."""
    all_ = available.select(*cells, group).distinct()
    marked = all_.join(used.select(*cells, group).distinct().withColumn("_used", F.lit(1)), [*cells, group], "left")
    out = marked.groupBy(*cells).agg(F.count(F.lit(1)).alias("available_groups"), F.count("_used").alias("used_groups"))
    return out.withColumn("used_share", ratio(F.col("used_groups"), F.col("available_groups")))


def class_weights(df: DataFrame, label: str, name: str = "class_weight") -> DataFrame:
    """Rows with weights that give the classes equal sums and sum to the number of rows."""
    c = df.groupBy(F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    t = c.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    w = c.crossJoin(t).select("_y", (F.col("_t") / (F.col("_k") * F.col("_n"))).alias(name))  # one row
    return df.join(w, F.col(label).eqNullSafe(F.col("_y"))).drop("_y")
