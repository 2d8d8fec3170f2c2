"""Cluster bootstrap and influence (H1 to H4, K4).

A replicate draws as many groups as there are, with replacement; a group drawn m times counts with weight m.
A group's multiplicities in all replicates travel as one vector of half a byte each. Statistics of sums weigh each group's
sums by it; AUC and the review of a frozen order go through sorted rows once, with all replicates side by side. Any other
statistic is a Column expression of a weight column, computed in one grouped aggregation over replicates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_integer
from ..functions.prefix import global_prefixes
from ..session import stable
from .metrics import average_precision, by_score, ratio, running_sums

#: A statistic as aggregate expression of the weight column's name.
Statistic = Callable[[str], Column]


@dataclass(frozen=True)
class OfSums:
    """A statistic of sums: ``parts`` are row values, whose weighted sums (nulls count as 0) ``of`` makes the statistic of.

    Of such a statistic rows are summed once by group, whatever the number of replicates.
    """

    parts: Mapping[str, Column]
    of: Callable[[Mapping[str, Column]], Column]

    def __call__(self, w: str) -> Column:
        return self.of({n: F.coalesce(F.sum(c.cast("double") * F.col(w)), F.lit(0.0)) for n, c in self.parts.items()})


def numbered_groups(df: DataFrame, group: str, strata: str | None = None) -> DataFrame:
    """(group, _stratum, _g from 0, _n, _start): number and size within the stratum, and the groups of all strata before."""
    s = F.col(strata) if strata else F.lit(0)
    g = df.select(F.col(group), s.alias("_stratum")).distinct()
    g = global_prefixes(g, [F.col("_stratum"), F.col(group)], {"_at": F.lit(1)})
    each = g.groupBy(F.col("_stratum").alias("_same")).agg(F.count(F.lit(1)).alias("_n"), (F.min("_at") - 1).alias("_start"))
    g = g.join(each, F.col("_stratum").eqNullSafe(F.col("_same")))
    return g.select(group, "_stratum", (F.col("_at") - F.col("_start") - 1).alias("_g"), "_n", "_start")


def _picks(g: DataFrame, reps: int, seed: str | int) -> DataFrame:
    """(rep, _at): the groups that replicates draw, by their number over all strata; tasks of about ``HELD`` draws."""
    tasks = max(1, math.ceil(g.count() * reps / HELD))
    x = g.repartition(tasks, "_start", "_g").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return x.select("rep", (F.col("_start") + F.pmod(hash_integer("rep", "_stratum", "_g", seed=seed), F.col("_n"))).alias("_at"))


def draws(df: DataFrame, group: str, reps: int, seed: str | int = 42, strata: str | None = None, identity: bool = False) -> DataFrame:
    """(rep, group, multiplicity) of all replicates, by hash of (rep, draw): the same on every run.

    ``identity`` draws each group once, so every statistic must equal its point estimate.
    """
    g = stable(numbered_groups(df, group, strata))
    if identity:
        return g.select(F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), group, F.lit(1).cast("long").alias("multiplicity"))
    picked = _picks(g, reps, seed).groupBy("rep", "_at").agg(F.count(F.lit(1)).alias("multiplicity"))
    return picked.join(g.select(group, (F.col("_start") + F.col("_g")).alias("_at")), "_at").select("rep", group, "multiplicity")


# --- draws of a group as one vector -------------------------------------------------------------------------------

#: Draws that a task deals to blocks of groups at once, numbers of a block, and rows that are weighed at once.
HELD, BLOCK_DRAWS, STEP = 1 << 21, 1 << 19, 256


def _pack(m: np.ndarray) -> pa.Array:
    """Rows of numbers up to 15, two to a byte: the first half of the replicates in the low bits, the other in the high ones."""
    half = (m.shape[1] + 1) // 2
    m = np.pad(m.astype("u1"), ((0, 0), (0, 2 * half - m.shape[1])))
    packed = np.ascontiguousarray(m[:, :half] | m[:, half:] << 4)
    offsets = np.arange(len(m) + 1, dtype="i4") * half
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])


def _unpack(packed: pa.Array, reps: int) -> np.ndarray:
    """The numbers of ``_pack``, a row for each."""
    half = (reps + 1) // 2
    first = np.frombuffer(packed.buffers()[1], "i4", 1, packed.offset * 4)[0]
    x = np.frombuffer(packed.buffers()[2], "u1", len(packed) * half, first).reshape(-1, half)
    return np.concatenate([x & 15, x >> 4], axis=1)[:, :reps]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), STEP):
            yield batch.slice(k, STEP)


def _dealt(reps: int, size: int):
    """(rep, _at) rows to (block, codes): what a block of ``size`` groups was drawn, each draw as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def emit() -> pa.RecordBatch:
            rep, at = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            block = at // size
            order = np.argsort(block, kind="stable")
            codes = (at % size * reps + rep).astype("i4")[order]
            blocks, starts = np.unique(block[order], return_index=True)
            offsets = np.append(starts, len(codes)).astype("i4") * 4
            blobs = pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(offsets), pa.py_buffer(codes)])
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), blobs], names=["block", "codes"])

        for batch in batches:
            held.append((batch.column(0).to_numpy().astype("i8"), batch.column(1).to_numpy()))
            n += len(batch)
            if n >= HELD:
                yield emit()
                held, n = [], 0
        if n:
            yield emit()

    return run


def _vectors(reps: int, size: int):
    """The draws of one block to (_at, _m): how often each replicate drew a group. What is beyond 15 comes in further rows."""

    def run(block: pa.Table) -> pa.Table:
        codes = np.concatenate([np.frombuffer(c.as_buffer(), "i4") for c in block.column("codes")])
        m = np.bincount(codes, minlength=size * reps).reshape(size, reps)
        ats, packed = [], []
        while m.any():
            some = np.flatnonzero(m.any(1))
            ats.append(some + block.column("block")[0].as_py() * size)
            packed.append(_pack(np.minimum(m[some], 15)))
            m = np.maximum(m - 15, 0)
        return pa.table({"_at": pa.array(np.concatenate(ats), pa.int64()), "_m": pa.concat_arrays(packed)})

    return run


def drawn_vectors(df: DataFrame, group: str, reps: int, seed: str | int = 42, strata: str | None = None, identity: bool = False) -> DataFrame:
    """(group, _m): the draws of ``draws``, a group's multiplicities in all replicates as one vector of half a byte each.

    A group that was drawn over 15 times has further rows, whose vectors add up.
    """
    g = stable(numbered_groups(df, group, strata))
    if identity:
        return g.select(group, F.lit(_pack(np.ones((1, reps)))[0].as_py()).alias("_m"))
    size = max(1, BLOCK_DRAWS // reps)
    blocks = _picks(g, reps, seed).mapInArrow(_dealt(reps, size), "block long, codes binary")
    vectors = blocks.groupBy("block").applyInArrow(_vectors(reps, size), "_at long, _m binary")
    return vectors.join(g.select(group, (F.col("_start") + F.col("_g")).alias("_at")), "_at").select(group, "_m")


def _weighed(reps: int, n: int):
    """Rows of ``n`` sums of a group and its vector to the sums of each replicate that drew one of these groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((n, reps)), np.zeros(reps, bool)
        for rows in _steps(batches):
            m = _unpack(rows.column(n), reps)
            met |= m.any(0)
            m = m.astype("f8")
            sums = np.stack([c.to_numpy() for c in rows.columns[:n]])
            with np.errstate(invalid="ignore"):
                for k in np.flatnonzero(~np.isfinite(sums).all(0)):  # infinity times 0 is nothing here
                    total += np.where(m[k] > 0, sums[:, k, None] * m[k], 0.0)
                    sums[:, k] = 0.0
            total += sums @ m
        which = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *[pa.array(t[which]) for t in total]], names=["rep", *[f"_p{k}" for k in range(n)]])

    return run


def bootstrap_of_sums(df: DataFrame, group: str, vectors: DataFrame, reps: int, stats: Mapping[str, OfSums]) -> DataFrame:
    """(rep, a column for each of ``stats``) over resampled groups; rows are summed once by group."""
    parts = [c for s in stats.values() for c in s.parts.values()]
    names = [f"_p{k}" for k in range(len(parts))]
    sums = df.groupBy(group).agg(*[F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(n) for n, c in zip(names, parts, strict=True)])
    met = sums.join(vectors, group).select(*names, "_m")
    totals = met.mapInArrow(_weighed(reps, len(names)), ", ".join(["rep int", *[f"{n} double" for n in names]]))
    at = iter(names)
    values = {name: s.of({p: F.sum(next(at)) for p in s.parts}) for name, s in stats.items()}
    return totals.groupBy("rep").agg(*[v.alias(n) for n, v in values.items()])


def resampled(df: DataFrame, drawn: DataFrame, group: str) -> DataFrame:
    """Rows with the replicate and multiplicity of each draw of their group."""
    return df.join(drawn, group)


def interval(values: DataFrame, col: str, level: float = 0.95) -> DataFrame:
    """One row: valid and invalid (null) replicates, mean, lower and upper percentile."""
    a = (1 - level) / 2
    return values.agg(F.count(col).alias("valid"), F.count_if(F.col(col).isNull()).alias("invalid"), F.avg(col).alias("mean"), F.percentile(col, F.lit(a)).alias("lower"), F.percentile(col, F.lit(1 - a)).alias("upper"))


def cluster_bootstrap(df: DataFrame, group: str, stat: Statistic, reps: int, seed: str | int = 42, strata: str | None = None, identity: bool = False, compact: Sequence[str] = ()) -> DataFrame:
    """H1: (rep, value) of a statistic over resampled groups. For a statistic that is no ``OfSums``, ``compact`` columns
    are what it reads: rows are first counted by (group, these), so that replicates multiply counts and not rows."""
    if isinstance(stat, OfSums):
        return bootstrap_of_sums(df, group, drawn_vectors(df, group, reps, seed, strata, identity), reps, {"value": stat})
    drawn = draws(df, group, reps, seed, strata, identity)
    if compact:
        df = df.groupBy(group, *compact).agg(F.count(F.lit(1)).alias("_c"))
    else:
        df = df.withColumn("_c", F.lit(1))
    x = resampled(df, drawn, group).withColumn("weight", F.col("_c") * F.col("multiplicity"))
    return x.groupBy("rep").agg(stat("weight").alias("value"))


def weighted_mean(col: str) -> Statistic:
    """K4: the mean of a column as a statistic of a weight column."""
    return OfSums({"sum": F.col(col), "n": F.when(F.col(col).isNotNull(), 1)}, lambda s: ratio(s["sum"], s["n"]))


def separation(label: str) -> Callable[[str], Statistic]:
    """H2, H4: mean score of rows with the label minus that of rows without; null when one of them is absent."""

    def of(score: str) -> Statistic:
        y, s = F.col(label).cast("boolean"), F.col(score)
        parts = {"p": F.when(y, s), "np": F.when(y & s.isNotNull(), 1), "n": F.when(~y, s), "nn": F.when(~y & s.isNotNull(), 1)}
        return OfSums(parts, lambda t: ratio(t["p"], t["np"]) - ratio(t["n"], t["nn"]))

    return of


def balanced_accuracy(label: str, cut: float) -> Callable[[str], Statistic]:
    """H2, H4: mean of the two classes' recalls where a score of ``cut`` or more means the label."""

    def of(score: str) -> Statistic:
        y, s = F.col(label).cast("boolean"), F.col(score)
        hit = s >= F.lit(float(cut))
        parts = {"p": F.when(y & hit, 1), "np": F.when(y & s.isNotNull(), 1), "n": F.when(~y & ~hit, 1), "nn": F.when(~y & s.isNotNull(), 1)}
        return OfSums(parts, lambda t: (ratio(t["p"], t["np"]) + ratio(t["n"], t["nn"])) / 2)

    return of


#: Rows of a range of scores, on average.
RANGE_ROWS = 100_000


def _areas(reps: int):
    """Rows of ranges of scores, in order, to what replicates' areas have in them: (_k, _s, tied, rep, area, pos, neg).

    A row has the number of its score's name, its range, score, positives, negatives and vector. The first and the last
    score of a range, which others may have too, come by themselves (tied, with the area left to the sum of all), what lies
    between under its least score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ties, inner = None, [], None  # ties: the first and the last so far, each [score, positives, negatives]

        def close() -> Iterator[pa.RecordBatch]:
            found = [(t[0], True, np.zeros(reps), t[1], t[2]) for t in ties] + ([(inner[0], False, *inner[1:])] if inner else [])
            for score, tied, area, pos, neg in found:
                r = np.flatnonzero((pos > 0) | (neg > 0))
                columns = [pa.array([at[0]] * len(r), pa.int32()), pa.array([score] * len(r), pa.float64()), pa.array([tied] * len(r), pa.bool_()), pa.array(r, pa.int32()), *[pa.array(x[r]) for x in (area, pos, neg)]]
                yield pa.RecordBatch.from_arrays(columns, names=["_k", "_s", "tied", "rep", "area", "pos", "neg"])

        for batch in _steps(batches):
            k, place = (batch.column(c).to_numpy() for c in range(2))
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (k[1:] != k[:-1])) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if at != (k[a], place[a]):
                    yield from close()
                    at, ties, inner = (k[a], place[a]), [], None
                m = _unpack(batch.column(5).slice(a, b - a), reps).astype("f8")
                raw = batch.column(2).to_numpy()[a:b]
                same = (raw[1:] == raw[:-1]) | (np.isnan(raw[1:]) & np.isnan(raw[:-1]))  # NaN is one score
                starts = np.append(0, np.flatnonzero(~same) + 1)
                pos, neg = m * batch.column(3).to_numpy()[a:b, None], m * batch.column(4).to_numpy()[a:b, None]
                if len(starts) < b - a:
                    pos, neg = np.add.reduceat(pos, starts), np.add.reduceat(neg, starts)
                scores = raw[starts]
                if ties and (ties[-1][0] == scores[0] or np.isnan(ties[-1][0]) and np.isnan(scores[0])):
                    ties[-1][1] += pos[0]
                    ties[-1][2] += neg[0]
                    scores, pos, neg = scores[1:], pos[1:], neg[1:]
                if not ties and len(scores):
                    ties = [[scores[0], pos[0].copy(), neg[0].copy()]]
                    scores, pos, neg = scores[1:], pos[1:], neg[1:]
                if not len(scores):
                    continue
                if len(ties) == 2:  # what was last so far is so no more
                    scores = np.append(ties[1][0], scores)
                    pos, neg = np.vstack([ties[1][1], pos]), np.vstack([ties[1][2], neg])
                ties = [ties[0], [scores[-1], pos[-1].copy(), neg[-1].copy()]]
                pos, neg = pos[:-1], neg[:-1]
                if len(pos):
                    inner = inner or [scores[0], np.zeros(reps), np.zeros(reps), np.zeros(reps)]
                    upto = np.cumsum(neg, 0)
                    inner[1] += (pos * (upto - neg / 2)).sum(0) + pos.sum(0) * inner[3]
                    inner[2] += pos.sum(0)
                    inner[3] += upto[-1]
        yield from close()

    return run


def auc_bootstraps(df: DataFrame, vectors: DataFrame, group: str, label: str, scores: Sequence[str], reps: int) -> DataFrame:
    """(rep, value_0, value_1 and so on): AUC by each of ``scores`` of ``reps`` resamples; null where a class is absent.

    Rows are counted by (group, score) and cut by score into ranges of about ``RANGE_ROWS``, a score of very many rows into
    several. Each takes its group's vector along, so what travels is half a byte a row and replicate. A range tells its area
    and classes by replicate, and these add up in order.
    """
    counted = [by_score(df, label, s, None, [group]).select(F.lit(k).alias("_k"), F.col(group).alias("_g"), F.col("_s").cast("double").alias("_s"), "_p", "_n") for k, s in enumerate(scores)]
    rows = stable(reduce(DataFrame.unionByName, counted))
    ranges = max(1, math.ceil(rows.count() / RANGE_ROWS))
    placed = rows.repartitionByRange(ranges, "_k", "_s", "_g").withColumn("_range", F.spark_partition_id())
    met = placed.join(vectors.withColumnRenamed(group, "_g"), "_g").select("_k", "_range", "_s", "_p", "_n", "_m")
    met = met.repartition(ranges, "_range").sortWithinPartitions("_range", "_k", "_s")
    parts = met.mapInArrow(_areas(reps), "_k int, _s double, tied boolean, rep int, area double, pos double, neg double")
    # One row a range, replicate and end: few beside rows.
    parts = parts.groupBy("_k", "rep", "_s").agg(F.sum("area").alias("area"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.bool_or("tied").alias("tied"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("_k", "rep").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    area = F.when(F.col("tied"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("area")) + F.col("pos") * below
    out = parts.withColumn("area", area).groupBy("_k", "rep").agg(ratio(F.sum("area"), F.sum("pos") * F.sum("neg")).alias("value"))
    out = out.groupBy("rep").agg(*[F.max(F.when(F.col("_k") == k, F.col("value"))).alias(f"value_{k}") for k in range(len(scores))])
    every = df.sparkSession.range(reps).select(F.col("id").cast("int").alias("rep"))
    return every.join(out, "rep", "left")


def paired_bootstrap(df: DataFrame, group: str, label: str, a: str, b: str, reps: int, metric: str | Callable[[str], Statistic] = "auc", seed: str | int = 42, identity: bool = False) -> DataFrame:
    """H2: (rep, value_a, value_b, difference) of a metric of two scores on the same draws: AUC, average precision, or
    a statistic of a score that reads group, label and score only, as ``separation(label)`` or ``balanced_accuracy``.

    AUC costs one sorted pass for both scores (``auc_bootstraps``), an ``OfSums`` one sum by group; the others join counts
    with the draws of their groups.
    """
    if metric == "auc":
        out = auc_bootstraps(df, drawn_vectors(df, group, reps, seed, None, identity), group, label, [a, b], reps).toDF("rep", "value_a", "value_b")
        return out.withColumn("difference", F.col("value_b") - F.col("value_a"))
    if not isinstance(metric, str) and all(isinstance(metric(c), OfSums) for c in (a, b)):
        out = bootstrap_of_sums(df, group, drawn_vectors(df, group, reps, seed, None, identity), reps, {"value_a": metric(a), "value_b": metric(b)})
        return out.withColumn("difference", F.col("value_b") - F.col("value_a"))
    drawn = draws(df, group, reps, seed, None, identity)
    compact = df.groupBy(group, label, a, b).agg(F.count(F.lit(1)).alias("_c"))
    x = resampled(compact, drawn, group).withColumn("_w", F.col("_c") * F.col("multiplicity"))
    if not isinstance(metric, str):
        out = x.groupBy("rep").agg(metric(a)("_w").alias("value_a"), metric(b)("_w").alias("value_b"))
        return out.withColumn("difference", F.col("value_b") - F.col("value_a"))
    f = {"average_precision": average_precision}[metric]
    out = f(x, label, a, "_w", ["rep"]).withColumnRenamed(metric, "value_a").join(f(x, label, b, "_w", ["rep"]).withColumnRenamed(metric, "value_b"), "rep")
    return out.withColumn("difference", F.col("value_b") - F.col("value_a"))


#: Least rows of a block of the frozen order, and about how many blocks there are at most; blocks that a task adds up at once.
BLOCK, BLOCKS, BLOCKS_HELD = 1024, 256, 4096


def _block_sums(reps: int):
    """(_stratum, _block, y, _m) rows to weight and hits by block and replicate, as far as a task has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for (stratum, block), t in total.items():
                columns = [pa.array([stratum]), pa.array([block], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in t]]
                yield pa.RecordBatch.from_arrays(columns, names=["_stratum", "_block", "w", "h"])
            total.clear()

        for rows in batches:
            keys = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
            number = {key: n for n, key in enumerate(dict.fromkeys(keys))}
            of = np.array([number[key] for key in keys])
            order = np.argsort(of, kind="stable")
            names, packed, y = list(number), rows.column(3), rows.column(2).to_numpy()
            for k in range(0, len(order), 4 * STEP):
                some = order[k : k + 4 * STEP]
                m = _unpack(packed.take(pa.array(some)), reps).astype("i4")
                starts = np.append(0, np.flatnonzero(np.diff(of[some])) + 1)
                for n, w, h in zip(of[some][starts], np.add.reduceat(m, starts), np.add.reduceat(m * y[some, None], starts), strict=True):
                    t = total.setdefault(names[n], np.zeros((2, reps), "i8"))
                    t[0] += w
                    t[1] += h
            if len(total) > BLOCKS_HELD:
                yield from emit()
        yield from emit()

    return run


def _added(reps: int):
    """What tasks have of one block, added up: a row for each replicate that has any of it."""

    def run(block: pa.Table) -> pa.Table:
        total = np.zeros((2, reps), "i8")
        for k, c in enumerate(("w", "h")):
            for x in block.column(c):
                total[k] += np.frombuffer(x.as_buffer(), "i8")
        has = np.flatnonzero(total[0])
        repeated = lambda c: pa.repeat(block.column(c)[0], len(has))
        return pa.table({"_stratum": repeated("_stratum"), "_block": repeated("_block"), "rep": pa.array(has, pa.int32()), "w": total[0, has], "h": total[1, has]})

    return run


def _opened(reps: int):
    """The rows of one block and the replicates whose budget ends in it, to what these take of it."""

    def run(rows: pa.Table, edges: pa.Table) -> pa.Table:
        rest, taken = np.zeros(reps, "i8"), np.zeros((2, reps), "i8")
        which = edges.column("rep").to_numpy()
        rest[which] = edges.column("rest").to_numpy()
        for some in _steps(rows.sort_by("rank").to_batches()):
            m = _unpack(some.column(some.schema.get_field_index("_m")), reps).astype("i8")
            y = some.column(some.schema.get_field_index("y")).to_numpy()
            take = np.clip(rest - (np.cumsum(m, 0) - m), 0, m)
            got = take.sum(0)
            rest -= got
            taken[0] += got
            taken[1] += y @ take
        return pa.table({"rep": pa.array(which, pa.int32()), "w": taken[0, which], "h": taken[1, which]})

    return run


def rank_bootstrap(df: DataFrame, group: str, strata: str, rank: str, label: str, fraction: float, reps: int, seed: str | int = 42, identity: bool = False) -> DataFrame:
    """H3: (rep, reviewed, hits, precision) of the first share of each stratum in a frozen order.

    A row counts as often as its group was drawn; the budget of a stratum is rounded half up anew in each replicate,
    and the row at its edge counts in part. ``rank`` is the row's number in its stratum.

    Rows are added up once in blocks of the order, with their groups' vectors. In each replicate, block sums tell which
    blocks are taken whole and in which one the budget ends; only those are opened. Rows are never multiplied by replicates.
    """
    vectors = stable(drawn_vectors(df, group, reps, seed, None, identity).withColumnRenamed(group, "_g"))
    stratum = F.coalesce(F.concat(F.lit("="), F.col(strata).cast("string")), F.lit("null"))
    rows = df.select(F.col(group).alias("_g"), stratum.alias("_stratum"), F.col(rank).cast("long").alias("rank"), F.coalesce(F.col(label).cast("boolean").cast("int"), F.lit(0)).alias("y"))
    rows = stable(rows)
    size = BLOCK * max(1, math.ceil(rows.count() / (BLOCK * BLOCKS)))
    rows = rows.withColumn("_block", F.floor(F.col("rank") / size).cast("long"))
    sums = rows.join(vectors, "_g").select("_stratum", "_block", "y", "_m").mapInArrow(_block_sums(reps), "_stratum string, _block long, w binary, h binary")
    sums = sums.groupBy("_stratum", "_block").applyInArrow(_added(reps), "_stratum string, _block long, rep int, w long, h long")
    w = Window.partitionBy("_stratum", "rep")
    before = F.coalesce(F.sum("w").over(w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rest = F.floor(F.sum("w").over(w) * F.lit(float(fraction)) + F.lit(0.5)) - before
    sums = stable(sums.withColumn("rest", rest.cast("long")).where("rest > 0"))
    edges = sums.where("w > rest").select("_stratum", "_block", "rep", "rest")
    inside = rows.join(edges.select("_stratum", "_block").distinct(), ["_stratum", "_block"], "left_semi")
    inside = inside.join(vectors, "_g").select("_stratum", "_block", "rank", "y", "_m")
    at = ["_stratum", "_block"]
    opened = inside.groupBy(*at).cogroup(edges.groupBy(*at)).applyInArrow(_opened(reps), "rep int, w long, h long")
    out = sums.where("w <= rest").select("rep", "w", "h").unionByName(opened).groupBy("rep").agg(F.sum("w").alias("reviewed"), F.sum("h").alias("hits"))
    every = df.sparkSession.range(reps).select(F.col("id").cast("int").alias("rep"))
    out = every.join(out, "rep", "left").select("rep", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("reviewed", "hits")])
    return out.withColumn("precision", ratio(F.col("hits"), F.col("reviewed")))


def leave_one_group_out(df: DataFrame, group: str, col: str) -> DataFrame:
    """H4: per group, the mean of all other rows and its difference to the mean of all. Sums are subtracted, rows are not re-read."""
    g = df.groupBy(group).agg(F.sum(F.col(col).cast("double")).alias("_s"), F.count(col).alias("_n"))
    t = g.agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    x = g.crossJoin(F.broadcast(t))  # one row
    x = x.withColumn("without", ratio(F.col("_ts") - F.col("_s"), F.col("_tn") - F.col("_n")))
    return x.withColumn("influence", F.col("without") - ratio(F.col("_ts"), F.col("_tn"))).select(group, "without", "influence")


def leave_one_group_out_stat(df: DataFrame, group: str, parts: Mapping[str, Column], stat: Callable[[Mapping[str, Column]], Column]) -> DataFrame:
    """H4: as ``leave_one_group_out`` for any statistic of sums.

    ``parts`` are row values whose sums the statistic needs (nulls count as 0), ``stat`` makes it of them: rates, class
    metrics, differences of means. Rows are summed once by group; a group's sums are taken from the totals.
    """
    g = df.groupBy(group).agg(*[F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(f"_p_{n}") for n, c in parts.items()], F.count(F.lit(1)).alias("rows_removed"))
    t = g.agg(*[F.sum(f"_p_{n}").alias(f"_t_{n}") for n in parts])
    x = g.crossJoin(F.broadcast(t))  # one row
    without = stat({n: F.col(f"_t_{n}") - F.col(f"_p_{n}") for n in parts})
    whole = stat({n: F.col(f"_t_{n}") for n in parts})
    return x.select(group, "rows_removed", without.alias("without"), (without - whole).alias("influence"))


def leave_one_group_out_auc(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """H4: AUC without each group, and its difference to the AUC of all; null where a class is absent.

    The pairs that go with a group are those of its positives with all negatives and of all positives with its negatives,
    less those inside it, so two running sums replace a pass over the rows for each group.
    """
    inside = running_sums(by_score(df, label, score, None, [group]), [group], "_s", {"_upto": F.col("_n")})
    own = inside.groupBy(group).agg(F.sum(F.col("_p") * (F.col("_upto") - F.col("_n") * F.lit(0.5))).alias("_gg"), F.sum("_p").alias("_gp"), F.sum("_n").alias("_gn"))
    places = running_sums(by_score(df, label, score, None, []), [], "_s", {"_below": F.col("_n"), "_to": F.col("_p")})
    places = places.select("_s", (F.col("_below") - F.col("_n") * F.lit(0.5)).alias("_below"), (F.col("_to") - F.col("_p") * F.lit(0.5)).alias("_to"))
    met = by_score(df, label, score, None, [group]).join(places, "_s")
    # Of each group: area of its positives over all negatives, and what its negatives have below all positives.
    sides = met.groupBy(group).agg(F.sum(F.col("_p") * F.col("_below")).alias("_pa"), F.sum(F.col("_n") * F.col("_to")).alias("_na"))
    x = own.join(sides, group)
    t = x.agg(F.sum("_pa").alias("_ta"), F.sum("_gp").alias("_tp"), F.sum("_gn").alias("_tn"))
    x = x.crossJoin(F.broadcast(t))  # one row
    gone = F.col("_pa") + (F.col("_gn") * F.col("_tp") - F.col("_na")) - F.col("_gg")
    without = ratio(F.col("_ta") - gone, (F.col("_tp") - F.col("_gp")) * (F.col("_tn") - F.col("_gn")))
    return x.select(group, without.alias("without"), (without - ratio(F.col("_ta"), F.col("_tp") * F.col("_tn"))).alias("influence"))
