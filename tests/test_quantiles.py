"""Quantiles equal NumPy's on every group."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from pdmspark.functions import quantiles
from pdmspark.functions.quantiles import percentiles, with_percentiles

PROBS = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}


def test_groups(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([None, *range(-9, 10), rng.random(), 1e12])) for g in ("x", "y", None) for _ in range(rng.randint(40, 90))]
    rows += [("one", 2.5), ("none", None), ("same", -0.0), ("same", 0.0), ("ends", -math.inf), ("ends", math.inf)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double").repartition(3)
    got = {r["g"]: r for r in percentiles(df, ["g"], F.col("v"), PROBS, {"up": 0.95}).collect()}
    groups = {g: [float(v) for h, v in rows if h == g and v is not None] for g, _ in rows}
    assert set(got) == {g for g, vs in groups.items() if vs}
    for g, r in got.items():
        if g != "ends":
            assert np.allclose([r[n] for n in PROBS], np.quantile(groups[g], list(PROBS.values())), rtol=1e-12, atol=1e-12)
        assert r["up"] == np.quantile(groups[g], 0.95, method="higher")
    assert (got["ends"]["a"], got["ends"]["e"]) == (-math.inf, math.inf)


def test_every_group_stays(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 4.0), (None, 3.0), ("none", None)], "g string, v double")
    out = with_percentiles(df.groupBy("g").agg(F.count("v").alias("n")), df, ["g"], F.col("v"), {"m": 0.5})
    assert {r["g"]: (r["n"], r["m"]) for r in out.collect()} == {"x": (2, 2.5), None: (1, 3.0), "none": (0, None)}


def test_without_groups(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert percentiles(df, [], F.col("v"), {"m": 0.25}).collect() == [(25.0,)]
    assert percentiles(df.where("v < 0"), [], F.col("v"), {"m": 0.25}).collect() == [(None,)]
    nan = spark.createDataFrame([(1.0,), (2.0,), (math.nan,)], "v double")
    r = percentiles(nan, [], F.col("v"), {"m": 0.5, "top": 1.0}).first()
    assert r["m"] == 2.0 and math.isnan(r["top"])


def test_brackets_of_large_groups(spark, monkeypatch):
    """Groups well beyond what is sorted whole, with heavy ties, infinities and NaN, and a sketch of few places."""
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    monkeypatch.setattr(quantiles, "SMALL", 66)
    rng = np.random.default_rng(2)
    groups = {
        "gauss": rng.normal(size=5000), "ties": rng.choice([0.0, 1.0, 2.0, 2.5], 5000, p=[0.05, 0.45, 0.45, 0.05]), "skew": rng.exponential(size=3000) ** 4,
        "few": rng.normal(size=60), "just": rng.normal(size=67), "ends": np.concatenate([[-np.inf] * 200, rng.normal(size=700), [np.inf] * 100]),
    }
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in rng.permutation(vs)], "g string, v double").repartition(5)
    probs = {"a": 0.0, "b": 0.01, "c": 0.05, "d": 0.25, "e": 0.5, "f": 0.95, "g_": 0.999, "h": 1.0}
    got = {r["g"]: r for r in percentiles(df, ["g"], F.col("v"), probs, {"up": 0.95, "top": 0.5}).collect()}
    for g, vs in groups.items():
        for n, p in probs.items():
            place = p * (len(vs) - 1)
            low, high = np.sort(vs)[[math.floor(place), math.ceil(place)]]
            assert got[g][n] == low if low == high else math.isclose(got[g][n], low + (high - low) * (place - math.floor(place)), rel_tol=1e-12, abs_tol=1e-12), (g, n)
        assert got[g]["up"] == np.quantile(vs, 0.95, method="higher") and got[g]["top"] == np.quantile(vs, 0.5, method="higher")
    nan = df.withColumn("v", F.when(F.col("v") > 1, F.lit(float("nan"))).otherwise(F.col("v")))
    r = percentiles(nan.where("g = 'gauss'"), [], F.col("v"), {"m": 0.5, "top": 0.99}).first()
    assert r["m"] == got["gauss"]["e"] and math.isnan(r["top"])


def test_rows_of_large_groups_are_not_moved(spark, monkeypatch):
    """Rows meet their brackets where they are: of all groups where these are few, of large ones where there are many."""
    rows = [(k % 2, float(k * 7 % 1009)) for k in range(6000)] + [(None, float(k)) for k in range(4001)] + [(g, 1.0 * g) for g in range(10, 60)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(4)
    want = {g: np.median([v for h, v in rows if h == g]) for g, _ in rows}
    monkeypatch.setattr(quantiles, "LARGE", 2000)
    x = df.where("v is not null").select("g", F.col("v").alias("_q_v"))
    sketch = df.groupBy("g").agg(F.count("v").alias("_q_n"), F.array(F.lit(1)).alias("_q_b"))
    for most in (100, 10):
        monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", most)
        assert {r["g"]: r["m"] for r in percentiles(df, ["g"], F.col("v"), {"m": 0.5}).collect()} == want
        y = quantiles._bracketed(x, sketch, ["g"])
        sizes = y.groupBy(F.spark_partition_id()).agg(F.count(F.when(F.col("g").isNull(), 1)).alias("n")).where("n > 0").collect()
        assert y.count() == len(rows) and len(sizes) == 4 and max(r["n"] for r in sizes) < 2000
