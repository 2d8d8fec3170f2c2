"""Operators on series give the same rows whether groups are cut into pieces or not."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pdmspark.functions import scan
from pdmspark.operators import joins, metrics, sequence


@pytest.fixture(scope="module")
def series(spark):
    """A group with most rows, small ones, a null group; null and equal times, told apart by ``no``."""
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, 1, 1, 2, None]), rng.choice([None, *range(0, 400)]), k, rng.choice("aab"), rng.choice([None, 0.5, 1.0, 2.0]), rng.random() < 0.1) for k in range(700)]
    rows += [(7, 5, 1000 + k, "a", 1.0, False) for k in range(60)]  # all at one time
    rows += [(k, 1, 2000 + k, "a", 1.0, True) for k in range(20, 40)]
    return spark.createDataFrame(rows, "m long, t long, no long, kind string, x double, e boolean").repartition(3)


OPERATORS = {
    "segment_runs": lambda d: sequence.segment_runs(d, ["m"], ["t", "no"], ["kind", "x"]),
    "split_on_gap": lambda d: sequence.split_on_gap(d, ["m"], ["t", "no"], "t", 1),
    "after_last_gap": lambda d: sequence.split_on_gap(d, ["m"], ["t", "no"], "t", 1, last_only=True),
    "run_to_event": lambda d: sequence.run_to_event(d, F.col("e"), ["m"], ["t", "no"], "t", [0, 1, 3], 4),
    "count_windows": lambda d: sequence.count_windows(d, ["m"], ["t", "no"], 7, 3),
    "endpoints": lambda d: sequence.endpoints(d, ["m"], ["t", "no"], 9),
    "asof_next": lambda d: joins.asof_next(d.where("e"), d, ["m"], "t", ["no", "x"]),
    "asof_prev": lambda d: joins.asof_prev(d, d.where("e"), ["m"], "t", ["no", "x"]),
    "roc_auc": lambda d: metrics.roc_auc(d.withColumn("s", F.col("t") % 97), "e", "s", by=["m"]),
    "average_precision": lambda d: metrics.average_precision(d.withColumn("s", F.col("t") % 97), "e", "s", by=["m"]),
    "spearman": lambda d: metrics.correlation(d, "t", "no", "spearman", by=["m"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_cut_groups(spark, series, name, monkeypatch):
    rounded = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)
    whole = OPERATORS[name](series)
    want = rounded(whole)
    monkeypatch.setattr(scan, "PIECE_ROWS", 40)
    monkeypatch.setattr(scan, "MOST_PIECES", 64)
    cut = OPERATORS[name](series)
    assert cut.columns == whole.columns and rounded(cut) == want and want
    monkeypatch.setattr(scan, "BROADCAST_ROWS", 0)
    assert rounded(OPERATORS[name](series)) == want


def test_a_group_becomes_many_tasks(spark, monkeypatch):
    """The pieces of one group are of similar size."""
    monkeypatch.setattr(scan, "PIECE_ROWS", 1000)
    df = spark.range(50_000).select(F.lit(1).alias("m"), F.col("id").alias("t"))
    s = scan.Series(df, ["m"], ["t"])
    sizes = [r["count"] for r in s.rows.groupBy("_piece").count().collect()]
    assert 40 <= len(sizes) <= 70 and max(sizes) < 2500
    x = s.done(s.scan(s.rows, sums={"n": F.lit(1)}))
    assert x.where(F.col("n") != F.col("t") + 1).count() == 0
