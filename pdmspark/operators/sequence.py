"""Segments, windows and causal features of ordered series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import global_prefix
from ..functions.quantiles import with_percentiles
from ..functions.scan import Series, _joined
from ..session import stable


def _w(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def segment_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], key: Sequence[str], name: str = "segment") -> DataFrame:
    """Runs of equal keys, numbered from 0; a key that comes back later is a new run; null is a value of its own."""
    series = Series(df, by, order)
    x = series.scan(series.rows, lags={"_k": F.struct(*key)})
    # The first row of a group has nothing before it, not even a struct of nulls.
    x = x.withColumn("_c", F.when(F.col("_k").isNull() | F.struct(*key).eqNullSafe(F.col("_k")), 0).otherwise(1))
    return series.done(series.scan(x, sums={name: F.col("_c")}).drop("_k", "_c"))


def gap_profile(df: DataFrame, by: Sequence[str], order: Sequence[str], time: str, nominal: float, thresholds: Sequence[float]) -> DataFrame:
    """Per group: time steps that are negative, zero, nominal, and above each threshold; monotone."""
    d = df.withColumn("_d", F.col(time) - F.lag(time).over(_w(by, order)))
    aggs = [F.count("_d").alias("n_steps"), F.count_if(F.col("_d") < 0).alias("negative"), F.count_if(F.col("_d") == 0).alias("zero"), F.count_if(F.col("_d") == nominal).alias("nominal")]
    aggs += [F.count_if(F.col("_d") > t).alias(f"above_{t}") for t in thresholds]
    return d.groupBy(*by).agg(*aggs).withColumn("monotone", F.col("negative") == 0)


def split_on_gap(df: DataFrame, by: Sequence[str], order: Sequence[str], time: str, gap: float, last_only: bool = False, name: str = "part") -> DataFrame:
    """D3: parts separated by steps above ``gap``, numbered from 0; or the rows after the last such step."""
    series = Series(df, by, order)
    x = series.scan(series.rows, lags={"_before": F.col(time)})
    x = x.withColumn("_g", F.coalesce((F.col(time) - F.col("_before") > gap).cast("int"), F.lit(0)))
    x = series.scan(x, sums={name: F.col("_g")}, totals={"_m": F.col("_g")} if last_only else None)
    if last_only:
        x = x.where(F.col(name) == F.col("_m")).drop("_m")
    return series.done(x.drop("_g", "_before"))


def run_to_event(df: DataFrame, is_event: Column, by: Sequence[str], order: Sequence[str], time: str, gaps: Sequence[float], min_len: int) -> DataFrame:
    """Per event: its row, the row after the previous event of the group, and for each gap threshold the start
    after the last longer step before the event, the length, and whether it is longer than ``min_len``. Long by gap.

    A step ends at the row behind it; only steps before the event's row count.
    """
    series = Series(df, by, order)
    x = series.scan(series.rows.withColumn("_e", is_event), sums={"_row": F.lit(1).cast("long")}, lags={"_before": F.col(time)})
    x = x.withColumns({"_row": F.col("_row") - 1, "_d": F.col(time) - F.col("_before")})
    # A step found at row r starts a stretch there; the event's own step ends at the event and is not before it.
    marks = {f"_g{k}": F.when(F.col("_d") > g, F.col("_row")) for k, g in enumerate(gaps)}
    x = series.scan(x, before={"_prev": F.when(F.col("_e"), F.col("_row") + 1), **marks}).where("_e")
    x = x.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("_prev", *marks)})
    per_gap = F.array(*[F.struct(F.lit(float(g)).alias("gap_seconds"), F.greatest(F.col("_prev"), F.col(f"_g{k}")).alias("start_row")) for k, g in enumerate(gaps)])
    out = x.select(*by, F.col(time), F.col("_row").alias("event_row"), F.inline(per_gap))
    return out.withColumn("length", F.col("event_row") - F.col("start_row") + 1).withColumn("candidate", F.col("length") > min_len)


def segment_lengths(df: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """One row: the segments, those too short for a window of ``size`` rows, and the rows in these."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    short = F.col("_n") < size
    return n.agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(short).alias("n_short"), F.coalesce(F.sum(F.when(short, F.col("_n"))), F.lit(0)).alias("rows_in_short"))


def window_ends(windows: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per window of ``count_windows`` the metadata of its last row."""
    return windows.groupBy(*keys).agg(*[F.max_by(c, "row_in_window").alias(f"last_{c}") for c in cols])


def count_windows(df: DataFrame, by: Sequence[str], order: Sequence[str], size: int, step: int, name: str = "window_index") -> DataFrame:
    """Every row once for each window of ``size`` rows, every ``step`` rows, that it is in; cut-off windows are left out."""
    series = Series(df, by, order)
    x = series.scan(series.sizes(series.rows, "_n"), sums={"_i": F.lit(1).cast("long")}).withColumn("_i", F.col("_i") - 1).where(F.col("_n") >= size)
    x = series.done(x)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_i") - (size - 1)) / F.lit(step))).cast("long")
    last = F.least(F.floor(F.col("_i") / F.lit(step)), F.floor((F.col("_n") - size) / F.lit(step))).cast("long")
    return x.where(first <= last).withColumn(name, F.explode(F.sequence(first, last))).withColumn("_at", F.col("_i") - F.col(name) * step).drop("_i", "_n").withColumnRenamed("_at", "row_in_window")


def window_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str], size: int, min_valid: float = 0.8) -> DataFrame:
    """Eight statistics of each column per window; null below ``min_valid`` of ``size`` values or over a zero.

    mean, std (population), peak_abs, rms, kurtosis (excess), skewness (population), crest = peak / rms, shape = rms / mean abs.
    """
    aggs, shown = [], []
    for c in cols:
        x, enough = F.col(c).cast("double"), F.count(c) >= min_valid * size
        rms, mean_abs, peak = F.sqrt(F.avg(x * x)), F.avg(F.abs(x)), F.max(F.abs(x))
        stats = {"mean": F.avg(x), "std": F.stddev_pop(x), "peak_abs": peak, "rms": rms, "kurtosis": F.kurtosis(x), "skewness": F.skewness(x), "crest": F.try_divide(peak, rms), "shape": F.try_divide(rms, mean_abs)}
        for n, v in stats.items():
            aggs.append(F.when(enough, v).alias(f"{c}__{n}"))
            shown.append(f"{c}__{n}")
    return df.groupBy(*keys).agg(*aggs).select(*keys, *shown)


def trailing_stats(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, cols: Sequence[str]) -> DataFrame:
    """Rms, peak_abs and shape factor of the last ``n`` rows, this one included; null until there are n values."""
    w = _w(by, order).rowsBetween(-(n - 1), 0)
    out = {}
    for c in cols:
        x = F.col(c).cast("double")
        full, rms = F.count(c).over(w) == n, F.sqrt(F.avg(x * x).over(w))
        out |= {f"{c}__rms": F.when(full, rms), f"{c}__peak_abs": F.when(full, F.max(F.abs(x)).over(w)), f"{c}__shape": F.when(full, F.try_divide(rms, F.avg(F.abs(x)).over(w)))}
    return df.withColumns(out)


def trailing_delta(df: DataFrame, by: Sequence[str], order: Sequence[str], col: str, k: int, strict: bool = True) -> DataFrame:
    """This value less the oldest of the last ``k``, their population std and history_count; null below k if strict."""
    w = _w(by, order).rowsBetween(-(k - 1), 0)
    count = F.count(col).over(w)
    ok = count == k if strict else F.lit(True)
    return df.withColumns({f"{col}__delta": F.when(ok, F.col(col) - F.first(col).over(w)), f"{col}__std": F.when(ok, F.stddev_pop(col).over(w)), "history_count": count})


#: Slabs of D9 are this many times as long as its longest horizon.
SLAB_HORIZONS = 16


def _from_start(df: DataFrame, by: Sequence[str], time: str, cols: Sequence[str], baseline: float) -> DataFrame:
    """Adds _s, the group's first time, and _m_ and _d_ of each column, mean and population std of its first ``baseline`` units."""
    first = stable(df.groupBy(*by).agg(F.min(time).alias("_s")))
    groups = first.count()
    early = _joined(df.select(*by, time, *cols), first, by, groups).where(F.col(time) - F.col("_s") <= baseline)
    early = early.groupBy(*by).agg(*[f(F.col(c).cast("double")).alias(f"_{k}_{c}") for c in cols for k, f in (("m", F.avg), ("d", F.stddev_pop))])
    return _joined(df, stable(_joined(first, early, by, groups)), by, groups)


def elapsed_stats(df: DataFrame, by: Sequence[str], time: str, cols: Sequence[str], horizons: Sequence[int], baseline: int, min_elapsed: int) -> DataFrame:
    """Per horizon h, over the rows of the last h time units (rows at the same time included): mean z-score,
    slope per 1000 units over the baseline std, and std ratio, against the group's first ``baseline`` units.

    ``sufficient`` is false, and all features are null, before ``min_elapsed`` units, where a baseline has no spread,
    and where a horizon has fewer than 2 rows; nothing is imputed. Rows without a value count for none of its features.

    A frame is the difference of two running sums, of which the earlier is looked up at t - h, so the work does not
    grow with the horizon. Series are cut in slabs of time that overlap by the longest horizon: tasks of their own, in
    which values are taken from the slab's first value, so that the differences keep their digits and see no later row.
    """
    wide = SLAB_HORIZONS * max(horizons)
    t = F.col(time)
    at = F.floor(t / wide)
    out = _from_start(df, by, time, cols, baseline)
    out = out.withColumn("_slab", F.explode(F.coalesce(F.sequence(at, F.floor((t + max(horizons)) / wide)), F.array(F.lit(None).cast("bigint")))))
    slab = [*by, "_slab"]
    whole = Window.partitionBy(*slab)
    out = out.withColumns({"_t": (t - F.col("_slab") * wide).cast("double"), **{f"_r_{c}": F.min(F.when(F.col(c).isNotNull(), F.struct(t.alias("t"), F.col(c).cast("double").alias("v")))).over(whole)["v"] for c in cols}})
    out = out.withColumns({f"_x_{c}": F.col(c).cast("double") - F.col(f"_r_{c}") for c in cols})
    sums = {"rows": F.lit(1)}
    for c in cols:
        x, u = F.col(f"_x_{c}"), F.when(F.col(f"_x_{c}").isNotNull(), F.col("_t"))
        sums |= {f"n_{c}": F.when(x.isNotNull(), 1).otherwise(0), f"x_{c}": x, f"xx_{c}": x * x, f"t_{c}": u, f"tx_{c}": u * x, f"tt_{c}": u * u}
    upto, peers = Window.partitionBy(*slab).orderBy(time), Window.partitionBy(*slab, time)
    total = lambda w: F.struct(*[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(k) for k, v in sums.items()])
    out = out.withColumns({"_upto": total(upto.rangeBetween(Window.unboundedPreceding, 0)), "_here": total(peers)})
    mark = F.struct(t.alias("at"), "_upto", "_here")
    out = out.withColumns({f"_old_{h}": F.last(mark).over(upto.rangeBetween(Window.unboundedPreceding, -h)) for h in horizons})

    def frame(h: int, k: str) -> Column:
        # What is exactly h units old is in the frame.
        old = F.col(f"_old_{h}")
        came = F.when(old["at"] == t - h, old["_here"][k]).otherwise(F.lit(0))
        return F.col("_upto")[k] - F.coalesce(old["_upto"][k] - came, F.lit(0))

    enough = [t - F.col("_s") >= min_elapsed, *[F.col(f"_d_{c}") > 0 for c in cols], *[frame(h, "rows") >= 2 for h in horizons]]
    out = out.where(F.col("_slab").eqNullSafe(at)).withColumn("sufficient", F.coalesce(reduce(Column.__and__, enough), F.lit(False)))
    feats = {}
    for h in horizons:
        for c in cols:
            n, x, xx, u, ux, uu = (frame(h, f"{k}_{c}") for k in ("n", "x", "xx", "t", "tx", "tt"))
            mean, d = F.try_divide(x, n), F.col(f"_d_{c}")
            spread = F.greatest(F.try_divide(xx, n) - mean * mean, F.lit(0.0))
            # At one time alone there is no slope.
            several = frame(h, "rows") > F.col("_here")["rows"]
            base = F.col(f"_m_{c}") - F.col(f"_r_{c}")
            feats |= {
                f"{c}__z_{h}": F.try_divide(mean - base, d),
                f"{c}__slope_{h}": F.when(several, F.try_divide(F.try_divide(n * ux - x * u, n * uu - u * u) * 1000, d)),
                f"{c}__std_ratio_{h}": F.try_divide(F.sqrt(spread), d),
            }
    out = out.withColumns({k: F.when(F.col("sufficient"), v) for k, v in feats.items()})
    return out.drop("_s", "_slab", "_t", "_upto", "_here", *[f"_{k}_{c}" for k in "mdrx" for c in cols], *[f"_old_{h}" for h in horizons])


def endpoints(df: DataFrame, by: Sequence[str], order: Sequence[str], stride: int) -> DataFrame:
    """Every ``stride``-th row from the first, and the last."""
    series = Series(df, by, order)
    x = series.scan(series.sizes(series.rows, "_n"), sums={"_i": F.lit(1).cast("long")}).withColumn("_i", F.col("_i") - 1)
    return series.done(x.where((F.pmod("_i", F.lit(stride)) == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n"))


def backward_sample(df: DataFrame, ends: DataFrame, by: Sequence[str], ordinal: str, max_len: int, rate: int, offsets: Sequence[int] = (0,)) -> DataFrame:
    """D11, long: for each endpoint (by, ordinal) and offset the rows at ordinal - offset - rate * j, j < max_len.

    Adds endpoint, offset and slot (0 to max_len - 1 in ascending order; a short history leaves the first slots out).
    """
    want = ends.select(*by, F.col(ordinal).alias("endpoint")).withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    want = want.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(max_len - 1)))).withColumn(ordinal, F.col("endpoint") - F.col("offset") - F.col("_j") * rate).where(F.col(ordinal) >= 0)
    return want.withColumn("slot", F.lit(max_len - 1) - F.col("_j")).drop("_j").join(df, [*by, ordinal])


def padded_arrays(samples: DataFrame, by: Sequence[str], value: str, max_len: int) -> DataFrame:
    """D11, arrays: ``values`` and ``mask`` of max_len slots per (by, endpoint, offset), padded on the left with nulls."""
    got = samples.groupBy(*by, "endpoint", "offset").agg(F.array_sort(F.collect_list(F.struct("slot", value))).alias("_v"))
    pad = F.lit(max_len) - F.size("_v")
    values = F.concat(F.array_repeat(F.lit(None).cast("double"), pad), F.transform("_v", lambda s: s[value].cast("double")))
    mask = F.concat(F.array_repeat(F.lit(False), pad), F.array_repeat(F.lit(True), F.size("_v")))
    return got.select(*by, "endpoint", "offset", values.alias("values"), mask.alias("mask"))


def rows_to_end(df: DataFrame, by: Sequence[str], order: Sequence[str], seconds_per_row: float = 4.0) -> DataFrame:
    """Remaining rows of the group, and the same in seconds."""
    left = F.count(F.lit(1)).over(Window.partitionBy(*by)) - F.row_number().over(_w(by, order))
    return df.withColumn("rows_to_end", left).withColumn("sample_rul_seconds", F.col("rows_to_end") * F.lit(float(seconds_per_row)))


def interval_audit(df: DataFrame, by: Sequence[str], time: str, nominal: float, end_time: Column | None = None) -> DataFrame:
    """Per group: rows, median and p90 step, share of nominal steps, and the time from the last row to the end."""
    d = df.withColumn("_d", (F.col(time) - F.lag(time).over(_w(by, [time]))).cast("double"))
    lag = (F.max(end_time) - F.max(time)) if end_time is not None else F.lit(None).cast("double")
    share = F.try_divide(F.count_if(F.col("_d") == nominal).cast("double"), F.count("_d").cast("double"))
    out = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), share.alias("nominal_share"), lag.alias("end_lag"))
    return with_percentiles(out, d, by, F.col("_d"), {"median_step": 0.5, "p90_step": 0.9})


def first_alarm(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """The first row of each group whose flag is true."""
    return df.where(F.col(flag)).withColumn("_n", F.row_number().over(_w(by, order))).where("_n = 1").drop("_n")


def lead_time(df: DataFrame, by: Sequence[str], ttf: str, flag: str, horizon: float | None = None) -> DataFrame:
    """The longest time to failure among the flagged rows of each group, within the horizon; null without any."""
    hit = F.col(flag) if horizon is None else F.col(flag) & (F.col(ttf) <= horizon)
    return df.groupBy(*by).agg(F.max(F.when(hit, F.col(ttf))).alias("lead"))


def event_detection(df: DataFrame, by: Sequence[str], label: str, ttf: str, flags: Sequence[str]) -> DataFrame:
    """Per group with a positive row: for each method detected and lead; then missed-by-the-first, caught-by-each."""
    hit = lambda f: F.col(label) & F.col(f)
    aggs = [x for f in flags for x in (F.coalesce(F.bool_or(hit(f)), F.lit(False)).alias(f"{f}_detected"), F.max(F.when(hit(f), F.col(ttf))).alias(f"{f}_lead"))]
    out = df.groupBy(*by).agg(F.bool_or(label).alias("_p"), *aggs).where("_p").drop("_p")
    return out.withColumns({f"{f}_only": ~F.col(f"{flags[0]}_detected") & F.col(f"{f}_detected") for f in flags[1:]})


def detection_summary(events: DataFrame, flags: Sequence[str]) -> DataFrame:
    """(method, n_events, detected, lead_q1, lead_median, lead_q3)."""
    parts = [
        events.agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col(f"{f}_detected")).alias("detected"), *[F.percentile(f"{f}_lead", F.lit(q)).alias(f"lead_{n}") for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]).withColumn("method", F.lit(f))
        for f in flags
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def position_leakage(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Positive rate by relative position in the group: what a label owes to position alone."""
    n, i = F.count(F.lit(1)).over(Window.partitionBy(*by)), F.row_number().over(_w(by, order)) - 1
    x = df.withColumn("position_bin", F.floor(i * bins / n).cast("int"))
    return x.groupBy("position_bin").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def position_error(df: DataFrame, by: Sequence[str], order: Sequence[str], target: str, per_row: float) -> DataFrame:
    """Largest error of the target rebuilt from the position alone; 0 means the target is position."""
    x = rows_to_end(df, by, order, per_row)
    return x.agg(F.max(F.abs(F.col(target) - F.col("sample_rul_seconds"))).alias("max_error"))


def budget_guard(df: DataFrame, order: Sequence[str], cost: str, unit: float, cap: float, by: Sequence[str] = ()) -> DataFrame:
    """``spent`` (running cost, unit where unknown) and ``accepted`` while it stays within the cap.

    ``order`` must be total. Without groups the running sum is a two-pass sum over ranges.
    """
    price = F.coalesce(F.col(cost).cast("double"), F.lit(float(unit)))
    if by:
        out = df.withColumn("spent", F.sum(price).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        out = global_prefix(df, [F.col(c) for c in order], price, "spent")
    return out.withColumn("accepted", F.col("spent") <= F.lit(float(cap)))


def with_slabs(df: DataFrame, by: Sequence[str], ordinal: str, slab: int, overlap: int, name: str = "slab") -> DataFrame:
    """A long series cut into slabs of ordinals that share ``overlap`` rows with the slab before, so that frames of up
    to overlap + 1 rows can be computed per (by, slab) on many tasks. ``own`` marks the rows to keep afterwards."""
    k = F.floor(F.col(ordinal) / slab)
    more = F.floor((F.col(ordinal) + overlap) / slab)
    out = df.withColumn(name, F.explode(F.sequence(k, more)))
    return out.withColumn("own", F.col(name) == k)


def slab_stats(df: DataFrame, by: Sequence[str], ordinal: str, n: int, cols: Sequence[str], slab: int = 1 << 20) -> DataFrame:
    """D7 for series of millions of rows: trailing_stats over slabs, with the same result."""
    out = trailing_stats(with_slabs(df, by, ordinal, slab, n - 1), [*by, "slab"], [ordinal], n, cols)
    return out.where("own").drop("slab", "own")
