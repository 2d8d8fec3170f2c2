"""Hard negatives against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pdmspark.llm import hard_negatives


def slow(rows, asked, positives=5, negatives=3):
    fine = [(k, i, y, [math.floor(256 * x) for x in v]) for k, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for k, i, y, v in fine:
        if not asked(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, z) for m, j, z, w in fine if m != k]
        for p, j, _ in sorted((x for x in scored if x[2] == y), key=first)[:positives]:
            hard = sorted((x for x in scored if x[2] != y and 50 * p <= 100 * x[0] <= 95 * p), key=first)[:negatives]
            out += [(i, j, r, n, p, s) for r, (s, n, _) in enumerate(hard, 1)]
    return Counter(out)


def spread(kind):
    rng = random.Random(kind)
    if kind == "ties":  # few different vectors, so that most scores tie, and upper limits coincide
        return [(k, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], rng.randrange(3)) for k in range(300)]
    if kind == "repeats":  # one vector is a third of all rows; ids and whole rows repeat
        rows = [(k % 90, [0.5, 0.5, 0.25], k % 4) for k in range(150)] + [(k % 40, [rng.random() for _ in range(3)], rng.randrange(4)) for k in range(150)]
        return rows + rows[:60]
    if kind == "odd":
        rows = [(k, [rng.gauss(0, 0.4) for _ in range(rng.choice([0, 2, 5]))], rng.randrange(2)) for k in range(100)]
        return rows + [(None, [1.0, 1.0], 1), (None, [1.0, 1.0], 0), (10, None, 1), (20, [1.0, None], 1), (30, [float("inf")], 1), (40, [float("nan")], 0), (50, [1.0], None), (60, [3e4, -2e4], 0), (61, [3e4, -1e4], 1)]
    return [(k, [rng.gauss(0, 0.2) for _ in range(16)], rng.randrange(5)) for k in range(600)]


@pytest.mark.parametrize("kind", ["ties", "repeats", "odd", "gauss"])
def test_negatives_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "CELL_BLOCKS", 2)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "TILE", 500)
    rows = spread(kind)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    df = spark.createDataFrame([(*r, "own") for r in rows], "vec_id long, embedding array<float>, label int, score string").repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = slow(rows, lambda i: i is not None and i % 10 == 0)
    assert want and Counter(map(tuple, got.collect())) == want


def test_no_anchor_gives_nothing(spark):
    df = spark.createDataFrame(spread("ties")[:20], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(df, F.col("vec_id") < 0).collect() == []
