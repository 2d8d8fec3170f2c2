"""H4 against recomputing the statistic without each group."""

from __future__ import annotations

import os
import random
import tempfile

import numpy as np
import pytest

from pdmspark.operators import influence
from pdmspark.operators.influence import leave_one_group_out_merged, leave_one_group_out_quantile


def data(seed, ties):
    rng = random.Random(seed)
    out = [(rng.choice([1, 2, 3, 3, 3, 3, 3, 4, None]), None if rng.random() < 0.1 else float(rng.randrange(6)) if ties else rng.gauss(0, 1)) for _ in range(rng.randrange(3, 120))]
    return [*out, (9, None)]


def close(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) < 1e-12


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_without_a_group(spark, seed):
    rows = data(seed, seed % 2 == 0)
    p = (0.5, 0.5, 0.9, 0.0)[seed]
    quantile = lambda v: float(np.quantile(v, p)) if v else None
    got = {r["g"]: r for r in leave_one_group_out_quantile(spark.createDataFrame(rows, "g long, v double").repartition(5), "g", "v", p).collect()}
    whole = quantile([v for _, v in rows if v is not None])
    assert got.keys() == {g for g, _ in rows}
    for g, r in got.items():
        want = quantile([v for h, v in rows if h != g and v is not None])
        assert close(r["without"], want) and close(r["influence"], want - whole)


def test_quantiles_of_one_group_and_of_none(spark):
    one = leave_one_group_out_quantile(spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double"), "g", "v").collect()
    assert [tuple(r) for r in one] == [("a", None, None)]
    assert leave_one_group_out_quantile(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


def largest(rows):
    return sorted(rows["v"].dropna())[-3:]


def test_any_mergeable_statistic(spark, monkeypatch):
    """The mean of the three largest values: no sum, and not to be taken back."""
    monkeypatch.setattr(influence, "HELD", 2)
    rows = data(11, False)
    mean = lambda v: sum(v) / len(v) if v else None
    x = spark.createDataFrame(rows, "g long, v double").repartition(5)
    got = {r["g"]: r for r in leave_one_group_out_merged(x, "g", ["v"], largest, lambda a, b: sorted(a + b)[-3:], mean).collect()}
    top = lambda gone: mean(sorted(v for g, v in rows if v is not None and (g,) != gone)[-3:])
    assert got.keys() == {g for g, _ in rows}
    for g, r in got.items():
        assert close(r["without"], top((g,))) and close(r["influence"], top((g,)) - top(()))
    one = leave_one_group_out_merged(x.where("g = 3"), "g", ["v"], largest, lambda a, b: sorted(a + b)[-3:], mean).collect()
    assert [tuple(r) for r in one] == [(3, None, None)]
    assert leave_one_group_out_merged(x.where("false"), "g", ["v"], largest, lambda a, b: sorted(a + b)[-3:], mean).count() == 0


def test_states_are_made_once_a_group(spark, tmp_path, monkeypatch):
    """Groups whose rows lie in all tasks are brought together first; only a large one has more states."""
    monkeypatch.setattr(influence, "HELD", 100)
    monkeypatch.setattr(influence, "RANGE_GROUPS", 20)
    folder = str(tmp_path)

    def counted(rows):
        os.close(tempfile.mkstemp(dir=folder)[0])
        return largest(rows)

    rows = [(k % 60, float(k * 7919 % 601)) for k in range(600)] + [(60, float(k)) for k in range(500)]
    x = spark.createDataFrame(rows, "g long, v double").repartition(8)
    mean = lambda v: sum(v) / len(v) if v else None
    got = {r["g"]: r["without"] for r in leave_one_group_out_merged(x, "g", ["v"], counted, lambda a, b: sorted(a + b)[-3:], mean).collect()}
    assert got == {g: mean(sorted(v for h, v in rows if h != g)[-3:]) for g in range(61)}
    assert len(os.listdir(folder)) <= 60 + influence.SALTS + 12  # a group may lie across two runs of HELD rows
