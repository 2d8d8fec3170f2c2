"""Sums over the complete pairs of many columns: cross products of blocks of rows with null masks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a tile; a task holds the sums of all tiles, five numbers for each pair.
TILE = 256
SUMS = ("n", "odd", "sa", "sb", "saa", "sbb", "sab")


def _products(shifts: list[float]):
    """Blocks of rows to the sums of each pair a < b of columns, one row for each pair and task."""
    f = len(shifts)
    tiles = [(i, j) for i in range(0, f, TILE) for j in range(i, f, TILE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {t: None for t in tiles}
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype("f8") for c in batch.columns], 1)
            known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            odd = known & ~np.isfinite(x)  # such a value spoils the pairs that it is in, and no other
            x = np.where(known & ~odd, x - shifts, 0.0)
            known, odd, squares = known.astype("f8"), odd.astype("f8"), x * x
            for i, j in tiles:
                a, b = slice(i, i + TILE), slice(j, j + TILE)
                got = np.stack([
                    known[:, a].T @ known[:, b], odd[:, a].T @ known[:, b] + known[:, a].T @ odd[:, b], x[:, a].T @ known[:, b], known[:, a].T @ x[:, b],
                    squares[:, a].T @ known[:, b], known[:, a].T @ squares[:, b], x[:, a].T @ x[:, b],
                ])
                total[i, j] = got if total[i, j] is None else total[i, j] + got
        for (i, j), sums in total.items():
            if sums is not None:
                a, b = np.meshgrid(np.arange(i, i + sums.shape[1]), np.arange(j, j + sums.shape[2]), indexing="ij")
                upper = a < b
                columns = [pa.array(a[upper], pa.int32()), pa.array(b[upper], pa.int32()), *[pa.array(s[upper]) for s in sums]]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", *SUMS])

    return run


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, odd, mean_a, mean_b, var_a, var_b, cov) of all pairs of columns over the rows that have both.

    ``a`` and ``b`` are places in ``columns``. ``odd`` counts pairs with a value that is not finite, which the moments
    leave out. Values are taken from their column's median first, so that large means cost no digits; a variance below
    1e-13 of the mean square around it is 0.
    """
    x = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    finite = [F.when(F.abs(f"c{i}") < float("inf"), F.col(f"c{i}")) for i in range(len(columns))]  # NaN is above all
    middle = x.agg(F.array(*[F.percentile_approx(c, 0.5, 100) for c in finite])).first()[0]
    sums = x.mapInArrow(_products([m or 0.0 for m in middle]), "a int, b int, " + ", ".join(f"{s} double" for s in SUMS))
    t = sums.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])
    n = F.col("n") - F.col("odd")
    mean = lambda s: F.try_divide(F.col(s), n)
    var = lambda s, ss: F.when(mean(ss) - mean(s) * mean(s) > mean(ss) * 1e-13, mean(ss) - mean(s) * mean(s)).otherwise(F.lit(0.0))
    shift = lambda c: F.element_at(F.array(*[F.lit(float(m or 0.0)) for m in middle]), F.col(c) + 1)
    return t.select(
        "a", "b", F.col("n").cast("long").alias("n"), F.col("odd").cast("long").alias("odd"), (mean("sa") + shift("a")).alias("mean_a"), (mean("sb") + shift("b")).alias("mean_b"),
        var("sa", "saa").alias("var_a"), var("sb", "sbb").alias("var_b"), (mean("sab") - mean("sa") * mean("sb")).alias("cov"),
    )
