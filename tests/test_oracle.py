"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import decimal
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import SF

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
#: Queries of the training-data operators have tests of their own.
NAMES = sorted(n for n in ORACLE if not n.startswith("op") and n != "pipeline")
NO_SQL = sorted(n for n in QUERIES if n not in ORACLE and not n.startswith("op") and n != "pipeline")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(x[i]) for i in at) for x in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", NO_SQL)
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns and (rows or name.startswith("J"))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 2
    assert df.columns == entry.entry(spark).columns


def test_bootstraps_have_the_replicates_of_the_reference(spark, monkeypatch):
    from pdmspark.operators import models

    assert all(f"range({1000})" in ORACLE[f"{n}_1000"] for n in ("H1_bootstrap_interval", "H2_paired_bootstrap", "H3_rank_bootstrap", "K4_user_statistic"))
    assert QUERIES["H1_cluster_bootstrap_1000"](spark, SF).count() == 1000
    assert QUERIES["H1_bootstrap_interval_1000"](spark, SF).first()["valid"] == 1000
    seen = []
    monkeypatch.setattr(models, "feature_set_screen", lambda df, *rest: seen.append(rest[-1]) or df.select("event_id"))
    QUERIES["I9_feature_set_screen"](spark, SF)
    assert seen == [1000]


def test_models_have_the_folds_of_the_reference(spark, monkeypatch):
    from pdmspark.operators import models

    seen = {}
    monkeypatch.setattr(models, "feature_set_screen", lambda df, *rest: seen.update(I9=df) or df.select("event_id"))
    monkeypatch.setattr(models, "logistic_oof", lambda df, *rest: seen.update(I6=df) or df.selectExpr("*", "prob as oof_probability"))
    monkeypatch.setattr(models, "forest_oof", lambda df, *rest: seen.update(I7=df) or df.selectExpr("*", "prob as oof_probability"))
    for name in ("I6_logistic_oof", "I7_forest_oof", "I9_feature_set_screen"):
        QUERIES[name](spark, SF)
    rows = spark.read.parquet(f"{SF}/events.parquet").count()
    for name, folds in (("I6", 6), ("I7", 6), ("I9", 5)):
        found = {r["fold"]: r["count"] for r in seen[name].groupBy("fold").count().collect()}
        assert set(found) == set(range(1, folds + 1)) and sum(found.values()) == rows


def test_scale_has_quantiles_of_all_rows(spark):
    rows = QUERIES["E6_fit_scale_whole"](spark, SF).where("feature = 'value'").collect()
    values = spark.read.parquet(f"{SF}/events.parquet").select("event_type", "value").toPandas().groupby("event_type")["value"]
    assert len(rows) == len(values)
    for r in rows:
        assert abs(r["p01"] - values.get_group(r["event_type"]).quantile(0.01)) < 1e-5 and abs(r["p99"] - values.get_group(r["event_type"]).quantile(0.99)) < 1e-5
