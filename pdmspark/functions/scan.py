"""Running values of ordered groups, where one group may have most of the rows.

A group of over ``PIECE_ROWS`` rows is cut, by approximate quantiles of its first order column, into pieces that follow
each other. Windows run within (group, piece), so pieces of one group are tasks of their own. What an associative
running value (sum, last value, last that is not null) brings into a piece comes from one summary row for each piece.
Groups below that size, and tables without a larger one, are windows as usual.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable

#: A group of more rows is cut, into at most MOST_PIECES.
PIECE_ROWS, MOST_PIECES = 250_000, 1024
#: Summaries are broadcast up to this many rows (some 100 bytes each), else joined by shuffle.
BROADCAST_ROWS = 200_000


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``left`` with the columns of ``right`` of the same keys, null equal to null; nulls where there are none."""
    right = right.withColumnsRenamed({c: f"_key{i}" for i, c in enumerate(keys)})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_key{i}"]) for i, c in enumerate(keys)])
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, same, "left").drop(*[f"_key{i}" for i in range(len(keys))])


class Series:
    """The rows of ``df``, in groups ``by``, in the order of columns ``order``; from the last to the first if ``reverse``.

    ``rows`` are those of ``df`` with what ``scan`` needs; ``done`` takes that off again. The first order column is a
    number, a date or a timestamp where groups are to be cut; rows equal in it stay together. Nulls come first.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], reverse: bool = False):
        self.by, self.order, self.reverse = list(by), list(order), reverse
        kind = df.schema[order[0]].dataType.typeName()
        large = None
        if kind in ("byte", "short", "integer", "long", "float", "double", "date", "timestamp", "timestamp_ntz") or kind.startswith("decimal"):
            large = stable(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > PIECE_ROWS))
        self.large = large.count() if large is not None else 0
        if not self.large:
            self.keys, self.rows = self.by, df
            return
        self.keys = [*self.by, "_piece"]
        at = F.col(order[0])
        cuts = F.percentile_approx(order[0], [k / MOST_PIECES for k in range(1, MOST_PIECES)], 20_000)
        held = _joined(df.select(*by, order[0]), large, by, self.large).where("_size is not null")
        cuts = held.groupBy(*by, "_size").agg(cuts.alias("_cuts"))
        # Every so many of the cuts, so that a piece has about PIECE_ROWS rows.
        stride = F.greatest(F.lit(1), F.floor(F.lit(MOST_PIECES * PIECE_ROWS) / F.col("_size"))).cast("int")
        cuts = cuts.withColumn("_cuts", F.filter("_cuts", lambda _, i: (i + 1) % stride == 0))
        self.cuts = stable(cuts)
        piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c < at)), F.lit(0))
        self.rows = _joined(df, self.cuts, by, self.large * MOST_PIECES // 10).withColumn("_piece", F.when(at.isNull() | F.col("_cuts").isNull(), 0).otherwise(piece)).drop("_cuts")

    def _sorted(self, keys: Sequence[str], order: Sequence[str]):
        return Window.partitionBy(*keys).orderBy(*[F.col(c).desc() if self.reverse else F.col(c).asc() for c in order])

    def sizes(self, x: DataFrame, name: str) -> DataFrame:
        """Adds the number of rows of the group."""
        here = F.count(F.lit(1)).over(Window.partitionBy(*self.keys))
        return x.withColumn(name, F.coalesce("_size", here) if self.large else here)

    def scan(
        self, x: DataFrame, sums: Mapping[str, Column] | None = None, lags: Mapping[str, Column] | None = None,
        lasts: Mapping[str, Column] | None = None, before: Mapping[str, Column] | None = None, totals: Mapping[str, Column] | None = None,
    ) -> DataFrame:
        """Adds running sums (this row included), values of the row before, last values that are not null (this row
        included, or only rows ``before`` it), and sums of the whole group (0 without a value). ``x`` has the rows of ``rows``."""
        sums, lags, lasts, before, totals = (dict(m or {}) for m in (sums, lags, lasts, before, totals))
        w = self._sorted(self.keys, self.order)
        upto, past, all_ = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*self.keys)
        boxed = lambda v: F.when(v.isNotNull(), F.struct(v.alias("v")))
        inside = {
            **{n: F.sum(v).over(upto) for n, v in sums.items()}, **{n: F.lag(F.struct(v.alias("v"))).over(w) for n, v in lags.items()},
            **{n: F.last(boxed(v), ignorenulls=True).over(upto) for n, v in lasts.items()}, **{n: F.last(boxed(v), ignorenulls=True).over(past) for n, v in before.items()},
            **{n: F.coalesce(F.sum(v).over(all_), F.lit(0)) for n, v in totals.items()},
        }
        unboxed = [*lags, *lasts, *before]
        if not self.large:
            return x.withColumns(inside).withColumns({n: F.col(n)["v"] for n in unboxed})
        place = F.struct(*self.order)
        end = F.min_by if self.reverse else F.max_by
        known = lambda v: end(boxed(v), F.when(v.isNotNull(), place))
        parts = {
            **{n: F.sum(v) for n, v in sums.items()}, **{n: end(F.struct(v.alias("v")), place) for n, v in lags.items()},
            **{n: known(v) for n, v in {**lasts, **before}.items()}, **{n: F.sum(v) for n, v in totals.items()},
        }
        summary = x.where("_size is not null").groupBy(*self.keys).agg(*[v.alias(f"_in_{n}") for n, v in parts.items()])
        over = self._sorted(self.by, ["_piece"])
        ahead, whole = over.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*self.by)
        brought = {
            **{n: F.sum(f"_in_{n}").over(ahead) for n in sums}, **{n: F.lag(f"_in_{n}").over(over) for n in lags},
            **{n: F.last(f"_in_{n}", ignorenulls=True).over(ahead) for n in [*lasts, *before]}, **{n: F.sum(f"_in_{n}").over(whole) for n in totals},
        }
        summary = stable(summary.select(*self.keys, *[v.alias(f"_in_{n}") for n, v in brought.items()]))
        out = _joined(x, summary, self.keys, summary.count()).withColumns(inside)
        came = {
            **{n: F.when(F.col(f"_in_{n}").isNull(), F.col(n)).otherwise(F.coalesce(n, F.lit(0)) + F.col(f"_in_{n}")) for n in sums},
            **{n: F.coalesce(F.col(n), F.col(f"_in_{n}"))["v"] for n in unboxed},
            **{n: F.coalesce(f"_in_{n}", n) for n in totals},
        }
        return out.withColumns(came).drop(*[f"_in_{n}" for n in came])

    def done(self, x: DataFrame) -> DataFrame:
        return x.drop("_piece", "_size") if self.large else x
