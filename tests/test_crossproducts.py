"""Correlations of many columns, and bootstraps with all replicates side by side, against brute force."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pdmspark.functions import crossproducts
from pdmspark.operators import inference, metrics


def frame(rng, n, columns):
    x = rng.normal(size=(n, columns)) + 1e6
    x[:, 1] = 2 * x[:, 0] + rng.normal(size=n)
    x[:, 2] = 7.5
    return pd.DataFrame(x, columns=[f"f{k}" for k in range(columns)]).mask(pd.DataFrame(rng.random((n, columns)) < 0.2, columns=[f"f{k}" for k in range(columns)]))


@pytest.mark.parametrize("tile", [256, 3])
def test_correlations_of_complete_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(crossproducts, "TILE", tile)
    rng = np.random.default_rng(3)
    pdf = frame(rng, 500, 8)
    pdf.loc[:, "f7"] = np.nan
    rows = [[None if math.isnan(v) else float(v) for v in r] for r in pdf.to_numpy()]
    for k, bad in ((3, float("nan")), (9, float("inf"))):
        rows[k][6] = bad
        rows[k][5] = None
    rows[11][6], rows[11][4] = float("nan"), 1.0
    df = spark.createDataFrame(rows, ", ".join(f"f{k} double" for k in range(8))).repartition(3)
    got = {(r["a"], r["b"]): (r["n_pairs"], r["r"]) for r in metrics.correlation_pairs(df, [f"f{k}" for k in range(8)]).collect()}
    assert len(got) == 28
    for (a, b), (n, r) in got.items():
        both = [(x[int(a[1])], x[int(b[1])]) for x in rows if x[int(a[1])] is not None and x[int(b[1])] is not None]
        assert n == len(both)
        if "f7" in (a, b):
            assert n == 0 and r is None
        elif not np.isfinite(both).all():
            assert math.isnan(r)
        elif "f2" in (a, b):
            assert r is None
        else:
            assert abs(r - np.corrcoef(np.array(both).T)[0, 1]) < 1e-9
    assert any(r is not None and math.isnan(r) for _, r in got.values())
    assert metrics.correlation_pairs(df.limit(0), ["f0", "f1"]).collect() == [("f0", "f1", 0, None)]


def test_two_hundred_columns(spark):
    pdf = frame(np.random.default_rng(5), 2000, 200)
    df = spark.createDataFrame(pdf).repartition(4)
    df = df.select([F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in df.columns]).cache()
    df.count()
    began = time.time()
    got = {(r["a"], r["b"]): r["r"] for r in metrics.correlation_pairs(df, df.columns).collect()}
    assert len(got) == 19_900 and time.time() - began < 60
    want = pdf.corr()
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-9 for a, b in [("f0", "f1"), ("f3", "f199"), ("f150", "f151")])


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(25), rng.choice(["p", "q", None]), k, rng.random() < 0.3, rng.choice([None, 0.1, 0.2, 0.2, 0.5, rng.random()]), rng.choice([float("nan"), rng.random(), 0.5])) for k in range(900)]
    return rows, spark.createDataFrame(rows, "g int, s string, k int, y boolean, a double, b double").repartition(3)


def times(df, reps):
    return {(r["rep"], r["g"]): r["multiplicity"] for r in inference.draws(df, "g", reps).collect()}


def test_areas_of_all_replicates(spark, scored):
    rows, df = scored
    got = {r["rep"]: r for r in inference.paired_bootstrap(df, "g", "y", "a", "b", 30).collect()}
    m = times(df, 30)
    assert sorted(got) == list(range(30))
    for rep in range(30):
        for name, at in (("value_a", 4), ("value_b", 5)):
            rank = lambda v: math.inf if math.isnan(v) else v
            pos = [(rank(r[at]), m.get((rep, r[0]), 0)) for r in rows if r[3] and r[at] is not None]
            neg = [(rank(r[at]), m.get((rep, r[0]), 0)) for r in rows if not r[3] and r[at] is not None]
            wins = sum(wp * wn * ((x > z) + (x == z) / 2) for x, wp in pos for z, wn in neg if wp and wn)
            assert abs(got[rep][name] - wins / (sum(w for _, w in pos) * sum(w for _, w in neg))) < 1e-9


@pytest.mark.parametrize("block", [7, 1024])
def test_budgets_of_all_replicates(spark, scored, block, monkeypatch):
    monkeypatch.setattr(inference, "BLOCK", block)
    rows, _ = scored
    rng = random.Random(1)
    order = {s: rng.sample([r for r in rows if r[1] == s], sum(r[1] == s for r in rows)) for s in ("p", "q", None)}
    ranked = [(*r[:4], i) for rs in order.values() for i, r in enumerate(rs)]
    df = spark.createDataFrame(ranked, "g int, s string, k int, y boolean, rank long")
    got = {r["rep"]: (r["reviewed"], r["hits"]) for r in inference.rank_bootstrap(df, "g", "s", "rank", "y", 0.21, 40).collect()}
    m = times(df, 40)
    for rep in range(40):
        reviewed = hits = 0
        for rs in order.values():
            budget = math.floor(sum(m.get((rep, r[0]), 0) for r in rs) * 0.21 + 0.5)
            for r in rs:
                take = min(budget, m.get((rep, r[0]), 0))
                budget, reviewed, hits = budget - take, reviewed + take, hits + take * r[3]
        assert got[rep] == (reviewed, hits)
    assert [tuple(r)[1:] for r in inference.rank_bootstrap(df.limit(0), "g", "s", "rank", "y", 0.2, 2).collect()] == [(0, 0, None)] * 2


def test_vectors_are_the_draws(spark, scored, monkeypatch):
    """Draws are dealt in many tasks and blocks; a group's vectors say how often each replicate drew it."""
    monkeypatch.setattr(inference, "HELD", 64)
    monkeypatch.setattr(inference, "BLOCK_DRAWS", 120)
    _, df = scored
    for strata in (None, "s"):
        x = df.where("s is null or g % 3 > 0").withColumn("s", F.when(F.col("g") < 9, F.lit("p")).when(F.col("g") < 20, F.lit("q")))
        got = {}
        for g, m in inference.drawn_vectors(x, "g", 31, strata=strata).collect():
            for rep, n in enumerate(inference._unpack(pa.array([bytes(m)], pa.binary()), 31)[0].tolist()):
                got[rep, g] = got.get((rep, g), 0) + n
        assert {k: n for k, n in got.items() if n} == {(r["rep"], r["g"]): r["multiplicity"] for r in inference.draws(x, "g", 31, strata=strata).collect()}
        # Each replicate draws as many groups as there are, null among them.
        g = inference.numbered_groups(x, "g", strata)
        assert inference._picks(g, 31, 42).rdd.getNumPartitions() == math.ceil(g.count() * 31 / 64)


def test_multiplicities_beyond_a_half_byte():
    codes = np.array([0] * 40 + [3] * 15 + [5], "i4")  # two groups of three replicates
    out = inference._vectors(3, 2)(pa.table({"block": pa.array([4], pa.int64()), "codes": pa.array([codes.tobytes()], pa.binary())}))
    total = np.zeros((2, 3), int)
    for at, m in zip(out.column("_at").to_pylist(), inference._unpack(out.column("_m").combine_chunks(), 3), strict=True):
        total[at - 8] += m
    assert total.tolist() == [[40, 0, 0], [15, 0, 1]]


def test_areas_where_a_score_lies_in_several_ranges(spark, scored, monkeypatch):
    rows, df = scored
    want = {r["rep"]: tuple(r) for r in inference.paired_bootstrap(df, "g", "y", "a", "b", 12).collect()}
    monkeypatch.setattr(inference, "RANGE_ROWS", 9)
    got = {r["rep"]: tuple(r) for r in inference.paired_bootstrap(df, "g", "y", "a", "b", 12).collect()}
    assert got.keys() == want.keys() and all(abs(p - q) < 1e-12 for k in want for p, q in zip(got[k], want[k], strict=True))


def test_sums_of_infinite_values_and_of_groups_not_drawn(spark):
    rows = [(g, math.inf if g == 3 else float(g)) for g in range(6)] + [(None, 5.0), (2, None)]
    x = spark.createDataFrame(rows, "g int, v double")
    got = {r["rep"]: r["value"] for r in inference.cluster_bootstrap(x, "g", inference.weighted_mean("v"), 40).collect()}
    m = times(x, 40)
    for rep in range(40):
        known = [(v, m.get((rep, g), 0)) for g, v in rows if g is not None and v is not None and (rep, g) in m]
        assert abs(got[rep] - sum(v * n for v, n in known) / sum(n for _, n in known)) < 1e-12 or got[rep] == math.inf == sum(v * n for v, n in known)
