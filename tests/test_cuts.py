"""F13 against all pairs of cuts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pdmspark.operators import cuts, routing


def all_pairs(data, ends):
    """(accuracy, macro-F1, t1, t2) of the best pair of rows (group, class 0 to 2, score)."""
    v = np.unique([d[2] for d in data])
    at = np.unique(np.concatenate([(v[1:] + v[:-1]) / 2, [0.0, 1.0] if ends else []]))
    groups = sorted({d[0] for d in data})
    accuracy, f1 = np.zeros((len(at), len(at))), np.zeros((len(at), len(at)))
    for g in groups:
        below = np.array([[sum(d[0] == g and d[1] == k and d[2] < t for d in data) for t in at] for k in range(3)], float)
        own = [sum(d[0] == g and d[1] == k for d in data) for k in range(3)]
        n = below.sum(axis=0)
        hits = [np.repeat(below[0][:, None], len(at), 1), below[1][None, :] - below[1][:, None], np.repeat(own[2] - below[2][None, :], len(at), 0)]
        called = [np.repeat(n[:, None], len(at), 1), n[None, :] - n[:, None], np.repeat(sum(own) - n[None, :], len(at), 0)]
        for k in range(3):
            accuracy += (hits[k] / own[k] if own[k] else 0) / 3 / len(groups)
            whole = called[k] + own[k]
            f1 += np.divide(2 * hits[k], whole, out=np.zeros_like(whole), where=whole > 0) / 3 / len(groups)
    pairs = [(round(accuracy[i, j], 10), round(f1[i, j], 10), -at[i], -at[j]) for i in range(len(at)) for j in range(i + 1, len(at))]
    return max(pairs), max((a, c, d) for a, _, c, d in pairs)


@pytest.mark.parametrize("case", ["mixed", "ties", "one group", "class missing"])
def test_best_of_all_pairs(spark, monkeypatch, case):
    monkeypatch.setattr(cuts, "START", 4)
    monkeypatch.setattr(cuts, "FAN", 3)
    monkeypatch.setattr(cuts, "VALUES", 50)
    rng = random.Random(case)
    if case == "mixed":
        data = [("ab"[k % 2], k // 2 % 3, k / 240) for k in range(240)]
    elif case == "ties":
        data = [(rng.choice("abc"), rng.randrange(3), rng.randrange(25) / 24) for _ in range(300)]
    elif case == "one group":
        data = [("a", k % 3, k / 150 - 0.2) for k in range(150)]
    else:
        data = [("ab"[k % 2], k % 3 if k % 2 else k % 2, rng.random()) for k in range(90)]
    x = spark.createDataFrame([(g, str(k), s) for g, k, s in data] + [(None, "0", 0.5), ("a", "other", 0.1), ("a", "1", None)], "g string, k string, s double").repartition(6)
    for ends in (True, False):
        best, plain = all_pairs(data, ends)
        r = routing.fit_two_cuts(x, "s", "k", ["0", "1", "2"], ["g"], ends=ends, macro_f1=True).first()
        assert (round(r["balanced_accuracy"], 10), round(r["macro_f1"], 10), -r["t1"], -r["t2"]) == pytest.approx(best, abs=2e-10)
        r = routing.fit_two_cuts(x, "s", "k", ["0", "1", "2"], ["g"], ends=ends).first()
        assert (round(r["balanced_accuracy"], 10), -r["t1"], -r["t2"]) == pytest.approx(plain, abs=2e-10)


def test_no_two_cuts(spark):
    for rows in ([], [("0", 0.5)], [("0", 0.5), ("1", 0.6)]):
        x = spark.createDataFrame(rows, "k string, s double")
        for f1 in (True, False):
            got = routing.fit_two_cuts(x, "s", "k", ["0", "1", "2"], macro_f1=f1).collect()
            assert len(got) == 1 and got[0]["t1"] is None and got[0]["balanced_accuracy"] is None


def test_very_many_equal_pairs(spark):
    """Evenly mixed classes: some 10,000 cuts a side are equally good, a hundred million pairs."""
    n = 30_000
    x = spark.range(n).select(F.pmod("id", F.lit(3)).cast("string").alias("k"), (F.col("id") / n).alias("s"))
    r = routing.fit_two_cuts(x, "s", "k", ["0", "1", "2"], macro_f1=True).first()
    assert abs(r["t1"] - 1 / 3) < 0.01 and abs(r["t2"] - 2 / 3) < 0.01 and abs(r["macro_f1"] - 1 / 3) < 1e-3
