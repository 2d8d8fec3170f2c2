"""Permutation importance against the same moves made row by row."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from pdmspark.operators import models as i

NAMES = ["a", "b", "c"]


def rows_of(n):
    return [(k, math.sin(k), math.cos(3 * k) if k % 11 else None, float(k % 5), 3 * math.sin(k) + 0.2 * (k % 5) + 0.1 * math.sin(k * k)) for k in range(n)]


def drawn(k, f, r):
    return int(hashlib.sha256(f"42|{f}|{r}|{k}".encode()).hexdigest()[:15], 16)


def slow(model, rows, buckets, reps):
    """Each column moved one place along the hash order of each bucket."""
    rows = [x for x in rows if None not in x]
    x, y = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    weights, constant = np.array(model.coefficients), model.intercept
    r2 = lambda m: 1 - ((y - m @ weights - constant) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    out = {}
    for f, name in enumerate(NAMES):
        drops = []
        for r in range(reps):
            moved = x.copy()
            draws = [drawn(row[0], f, r) for row in rows]
            for b in range(buckets):
                order = sorted((n for n in range(len(rows)) if draws[n] % buckets == b), key=lambda n: draws[n])
                for at, n in enumerate(order):
                    moved[n, f] = x[order[(at + 1) % len(order)], f]
            drops.append(r2(x) - r2(moved))
        out[name] = (np.mean(drops), np.std(drops))
    return out


@pytest.mark.parametrize("bucket_rows", [1000, 60])
def test_importance(spark, monkeypatch, bucket_rows):
    rows = rows_of(400)
    df = spark.createDataFrame(rows, "_y long, a double, b double, c double, y double").repartition(3)  # a key with a clashing name
    train = VectorAssembler(inputCols=NAMES, outputCol="_features").transform(df.where(F.col("b").isNotNull()))
    model = LinearRegression(featuresCol="_features", labelCol="y").fit(train)
    monkeypatch.setattr(i, "BUCKET_ROWS", bucket_rows)
    known = sum(None not in r for r in rows)
    want = slow(model, rows, max(1, round(known / bucket_rows)), 4)
    for table in (df, df.repartition(7)):
        got = {r["feature"]: (r["mean_drop"], r["std_drop"]) for r in i.permutation_importance(model, table, NAMES, "y", ["_y"], 4).collect()}
        assert set(got) == set(NAMES)
        for name in NAMES:
            assert got[name] == pytest.approx(want[name], abs=1e-9)
    assert want["a"][0] > 1 > want["c"][0] > 0


def test_importance_of_no_rows(spark):
    df = spark.createDataFrame([(0, 1.0, None, 2.0, 1.0)], "id long, a double, b double, c double, y double")
    train = VectorAssembler(inputCols=NAMES, outputCol="_features").transform(spark.createDataFrame(rows_of(9)[1:], df.schema))
    model = LinearRegression(featuresCol="_features", labelCol="y").fit(train)
    assert i.permutation_importance(model, df, NAMES, "y", ["id"]).collect() == []
