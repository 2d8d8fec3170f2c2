"""Queries of models (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as i
from ..operators import sampling as g
from ..operators.sequence import rows_to_end, trailing_stats
from .base import endpoints, query
from .resampled import REPS

X = ["prob", "hour", "day"]


def features(spark, d, folds=5):
    """Endpoints with a few numeric features and group folds."""
    x = endpoints(spark, d).withColumns({"hour": (F.col("t") % 86400 / 3600.0).cast("double"), "day": F.floor(F.col("t") / 86400) % 7.0, "y": F.col("label").cast("int")})
    x = x.withColumn("day", F.col("day").cast("double"))
    return x.join(g.group_folds(x, "user_id", folds), "user_id")


@query("I1_fit_gate")
def _(spark, d):
    x = g.class_weights(features(spark, d).withColumn("near", F.when(F.col("band") == "near", 1).when(F.col("band") == "normal", 0)), "near")
    model = i.fit_gate(x, X, "near", "class_weight", trees=16, depth=6)
    return i.score_gate(model, x, X).select("event_id", "probability_1")


@query("I2_residual_feature")
def _(spark, d):
    return i.residual_feature(features(spark, d).withColumn("normal", F.col("band") == "normal"), X, "value", "normal", 8, 5).select("event_id", "value_residual")


@query("I3_fit_regressors")
def _(spark, d):
    x = features(spark, d)
    return i.fit_regressors(x.where("fold <> 1"), x.where("fold = 1"), X, ["value"], 8, 5)[0]


@query("I4_permutation_importance")
def _(spark, d):
    x = features(spark, d)
    _, _, models = i.fit_regressors(x.where("fold <> 1"), x.where("fold = 1"), X, ["value"], 8, 5)
    return i.permutation_importance(models["value"], x.where("fold = 1"), X, "value", ["event_id"], 2)


@query("I5_two_stage_ttf")
def _(spark, d):
    x = features(spark, d)
    return i.two_stage_ttf(x.where("fold <> 1"), x.where("fold = 1"), X, "value", 0.25, 8, 5).select("event_id", "near_probability", "predicted_ttf")


@query("I6_logistic_oof")
def _(spark, d):
    return i.logistic_oof(features(spark, d, 6), X, "y", "fold").select("event_id", "fold", "oof_probability")


@query("I7_forest_oof")
def _(spark, d):
    x = features(spark, d, 6).select("event_id", "fold", "y", "value", (F.col("band") == "normal").alias("normal"), *X)
    return i.forest_oof(x, ["prob", "hour"], "y", "fold", (X, "value"), "normal", 6, 5).select("event_id", "fold", "oof_probability")


@query("I8_calibrate")
def _(spark, d):
    x = features(spark, d)
    return i.calibrate(x.where("fold <> 1"), x.select("event_id", "prob"), "prob", "y")


@query("I9_feature_set_screen")
def _(spark, d):
    x = features(spark, d).select("event_id", "user_id", "y", "fold", "prob", "hour", "day")
    return i.feature_set_screen(x, {"base": ["prob"], "extra": ["hour", "day"], "both": X}, "y", "fold", "user_id", "base", REPS)


@query("I9_screen_exclusions", "SELECT event_type, count(DISTINCT user_id) FILTER (value <= 1) AS positive_groups, count(DISTINCT user_id) FILTER (NOT value <= 1) AS negative_groups, count(DISTINCT user_id) FILTER (value <= 1) < 5 OR count(DISTINCT user_id) FILTER (NOT value <= 1) < 5 AS excluded FROM ep GROUP BY event_type")
def _(spark, d):
    return i.screen_exclusions(endpoints(spark, d).withColumn("y", F.col("value") <= 1), ["event_type"], "y", "user_id")


SCREEN = """, r AS (SELECT event_type, avg(prob) - avg(value) / 100 AS gain, avg(prob) - avg(value) / 100 - {width} AS lower, avg(prob) AS extra, avg(value) / 100 AS base FROM ep GROUP BY event_type),
 a AS (SELECT event_type, 'gain above 0' AS reason FROM r WHERE lower > 0 ORDER BY gain DESC, event_type LIMIT 1), b AS (SELECT event_type, 'new features strong where the base is weak' AS reason FROM r WHERE extra > 0.3 AND base < 0.75 ORDER BY extra DESC, event_type LIMIT 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a) UNION ALL SELECT NULL, 'nothing confirmed' WHERE NOT EXISTS (SELECT 1 FROM a) AND NOT EXISTS (SELECT 1 FROM b)"""


def _select(spark, d, width):
    """The rule over means of the events, which stand for the measures of a screen."""
    base, extra = F.avg("value") / 100, F.avg("prob")
    r = endpoints(spark, d).groupBy("event_type").agg((extra - base).alias("gain"), (extra - base - width).alias("lower"), extra.alias("extra"), base.alias("base"))
    return i.select_task(r, "event_type", "gain", "lower", "extra", "extra", "base", 0.3)


@query("I9_select_by_gain", SCREEN.format(width="-1"))
def _(spark, d):
    return _select(spark, d, -1)


@query("I9_select_by_strength", SCREEN.format(width="2"))
def _(spark, d):
    return _select(spark, d, 2)


@query("I10_impute_median", ", m AS (SELECT median(value) AS m FROM ep WHERE event_id % 3 <> 0) SELECT event_id, CASE WHEN event_id % 3 = 0 THEN m ELSE value END AS value FROM ep, m")
def _(spark, d):
    x = endpoints(spark, d).select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    m = x.agg(F.percentile("value", F.lit(0.5)).alias("value"))
    return i.impute_median(m, x, ["value"])


@query("I11_fit_rul")
def _(spark, d):
    x = rows_to_end(trailing_stats(features(spark, d), ["user_id"], ["t", "event_id"], 5, ["value"]), ["user_id"], ["t", "event_id"])
    names = ["value__rms", "value__peak_abs", "prob"]
    return i.fit_rul(x.where("fold <> 1"), x.where("fold = 1"), names, "rows_to_end", rounds=5, depth=4).select("event_id", "rul_seconds")


@query("I12_score_sequences", "SELECT user_id, round(list_aggregate(v, 'avg') / list_aggregate(v, 'max'), 6) AS score FROM (SELECT user_id, list(value) AS v FROM ep GROUP BY user_id)")
def _(spark, d):
    x = endpoints(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", "value"))), lambda s: s["value"]).alias("values"))
    return i.score_sequences(x, lambda b: b["values"].map(lambda v: v.mean() / v.max()), ["values"]).select("user_id", "score")
