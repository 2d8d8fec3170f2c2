"""D9 against frames taken row by row."""

from __future__ import annotations

import math
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from pdmspark.operators import sequence as q


def brute(rows, horizons, baseline, min_elapsed):
    """{(id): (sufficient, feature, ...)} of rows (id, group, time, value)."""
    out = {}
    for i, g, t, _ in rows:
        group = [r for r in rows if r[1] == g]
        start = min((r[2] for r in group if r[2] is not None), default=None)
        base = [r[3] for r in group if r[2] is not None and r[3] is not None and r[2] - start <= baseline]
        m, d = (statistics.fmean(base), statistics.pstdev(base)) if base else (None, 0.0)
        frames = {h: [r for r in group if t is not None and r[2] is not None and t - h <= r[2] <= t] for h in horizons}
        ok = t is not None and t - start >= min_elapsed and d > 0 and all(len(f) >= 2 for f in frames.values())
        feats = []
        for h in horizons:
            known = [r for r in frames[h] if r[3] is not None]
            x, u = [r[3] for r in known], [r[2] for r in known]
            if not ok or not x:
                feats += [None] * 3
                continue
            mx, mu = statistics.fmean(x), statistics.fmean(u)
            suu = sum((k - mu) ** 2 for k in u)
            slope = sum((k - mu) * (v - mx) for k, v in zip(u, x, strict=True)) / suu * 1000 / d if suu > 0 else None
            feats += [(mx - m) / d, slope, statistics.pstdev(x) / d]
        out[i] = (ok, *feats)
    return out


@pytest.mark.parametrize("step", [1, 0.5])
def test_frames_are_those_of_each_row(spark, step):
    rng = random.Random(7)
    rows = []
    for g, n in (("a", 400), ("b", 150), (None, 60), ("still", 30), ("one", 1)):
        for k in range(n):
            # Equal times, gaps, a drift of a million spreads, missing values and times.
            t = None if rng.random() < 0.02 else (rng.randrange(n) * 3 + (5000 if k % 50 == 0 else -700)) * step
            v = None if rng.random() < 0.1 else 4.0 if g == "still" else rng.gauss(0, 1) + (1e4 if g == "b" and (t or 0) > 3000 else 0.0)
            rows.append((len(rows), g, t, v))
    kind = "long" if step == 1 else "double"
    df = spark.createDataFrame(rows, f"id long, g string, t {kind}, v double").repartition(5)
    got = q.elapsed_stats(df, ["g"], "t", ["v"], [40, 13], 200, 250).collect()
    want = brute(rows, [40, 13], 200, 250)
    assert len(got) == len(rows)
    for r in got:
        have = (r["sufficient"], *[r[f"v__{k}_{h}"] for h in (40, 13) for k in ("z", "slope", "std_ratio")])
        for a, b in zip(have, want[r["id"]], strict=True):
            assert a == b if a is None or b is None or isinstance(a, bool) else math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    assert got[0].asDict().keys() == {"id", "g", "t", "v", "sufficient", *[f"v__{k}_{h}" for h in (40, 13) for k in ("z", "slope", "std_ratio")]}


def test_nothing_of_nothing(spark):
    assert q.elapsed_stats(spark.createDataFrame([], "g string, t long, v double"), ["g"], "t", ["v"], [10], 20, 30).count() == 0


def test_time_grows_with_rows_alone(spark):
    """A frame of 10,000 rows for each row: 200,000 rows would be two billion values read frame by frame."""
    x = spark.range(200_000).select(F.lit("a").alias("g"), F.col("id").alias("t"), F.sin(F.col("id") / 100).alias("v"))
    start = time.monotonic()
    r = q.elapsed_stats(x, ["g"], "t", ["v"], [10_000], 20_000, 20_000).agg(F.count_if("sufficient"), F.max(F.abs("v__z_10000"))).first()
    assert r[0] == 180_000 and r[1] < 3 and time.monotonic() - start < 60
