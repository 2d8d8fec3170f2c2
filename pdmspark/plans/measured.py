"""Queries of aggregations and metrics (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import perturb_arms
from ..operators import metrics as m
from .base import GATED, endpoints, gated, query, table


@query("E1_target_stats", "SELECT target, count(v) AS n, count(*) - count(v) AS n_null, count(*) FILTER (v < 0) AS n_negative, min(v) AS min_value, max(v) AS max_value, count(*) FILTER (v <= 20) AS n_near, round(count(*) FILTER (v <= 20)::DOUBLE / count(v), 6) AS near_ratio, count(*) FILTER (v > 20 AND v <= 60) AS n_boundary, round(count(*) FILTER (v > 20 AND v <= 60)::DOUBLE / count(v), 6) AS boundary_ratio, count(*) FILTER (v > 60) AS n_normal, round(count(*) FILTER (v > 60)::DOUBLE / count(v), 6) AS normal_ratio FROM (SELECT 'value' AS target, value AS v FROM ep UNION ALL SELECT 'prob', CASE WHEN prob >= 0.1 THEN prob END FROM ep) GROUP BY target")
def _(spark, d):
    return m.target_stats(endpoints(spark, d).withColumn("prob", F.when(F.col("prob") >= 0.1, F.col("prob"))), ["value", "prob"], (20, 60))


@query("E2_quantiles", "SELECT event_type, 'value' AS column_name, p AS prob, round(CASE p WHEN 0.1 THEN quantile_cont(value, 0.1) WHEN 0.5 THEN quantile_cont(value, 0.5) ELSE quantile_cont(value, 0.99) END, 6) AS q FROM ep, (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.99::DOUBLE]) AS p) GROUP BY event_type, p")
def _(spark, d):
    return m.quantiles(endpoints(spark, d), ["value"], [0.1, 0.5, 0.99], ["event_type"])


@query("E2_quantiles_approx")
def _(spark, d):
    return m.quantiles(table(spark, d, "lineitem"), ["l_extendedprice"], [0.5, 0.99], ["l_returnflag"], approx=True)


@query("E3_distribution", "SELECT event_type, band, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, min(value) AS min_value, max(value) AS max_value FROM ep GROUP BY event_type, band")
def _(spark, d):
    return m.distribution(endpoints(spark, d), ["event_type", "band"], "value")


@query("E4_equal_group_mean", ", x AS (SELECT event_type, user_id, avg(value) AS g, sum(value) AS s, count(value) AS n FROM ep GROUP BY ALL) SELECT event_type, round(sum(s) / sum(n), 6) AS row_mean, round(avg(g), 6) AS group_mean, count(g) AS n_groups FROM x GROUP BY event_type")
def _(spark, d):
    return m.equal_group_mean(endpoints(spark, d), ["event_type"], "user_id", "value")


@query("E5_group_inventory", "SELECT user_id, count(*) AS n_rows, count(CASE WHEN prob > 0.5 THEN value END) AS n_target, arg_min(event_type, t * 1000000 + event_id) AS first_tool FROM ep GROUP BY user_id")
def _(spark, d):
    x = endpoints(spark, d).withColumn("target", F.when(F.col("prob") > 0.5, F.col("value")))
    return m.group_inventory(x, ["user_id"], ["target"], "event_type", ["t", "event_id"])


@query("E5_part_inventory", "SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_user_id, count(DISTINCT band) AS n_band FROM ep GROUP BY event_type")
def _(spark, d):
    return m.part_inventory(endpoints(spark, d), "event_type", ["user_id", "band"])


SCALE = """, x AS (SELECT event_type, event_id % 20 = 0 AS k, 'value' AS feature, value AS v FROM ep UNION ALL SELECT event_type, event_id % 20 = 0, 'prob', prob FROM ep)
SELECT event_type, feature, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min_value, max(v) AS max_value, round(quantile_cont(v, 0.01) FILTER (k), 6) AS p01, round(quantile_cont(v, 0.25) FILTER (k), 6) AS q25, round(quantile_cont(v, 0.5) FILTER (k), 6) AS median, round(quantile_cont(v, 0.75) FILTER (k), 6) AS q75, round(quantile_cont(v, 0.99) FILTER (k), 6) AS p99, round(quantile_cont(v, 0.75) FILTER (k) - quantile_cont(v, 0.25) FILTER (k), 6) AS iqr, count(v) = 0 AS all_missing FROM x GROUP BY ALL"""


@query("E6_fit_scale", SCALE)
def _(spark, d):
    return m.fit_scale(endpoints(spark, d), ["event_type"], ["value", "prob"], F.col("event_id") % 20 == 0)


@query("E6_fit_scale_whole", SCALE.replace(" FILTER (k)", ""))
def _(spark, d):
    return m.fit_scale(endpoints(spark, d), ["event_type"], ["value", "prob"])


@query("E7_confusion", GATED + ", c AS (SELECT event_type, count(*) FILTER (f IS NULL) AS u, count(*) FILTER (y AND f) AS tp, count(*) FILTER (NOT y AND f) AS fp, count(*) FILTER (y AND NOT f) AS fn, count(*) FILTER (NOT y AND NOT f) AS tn FROM (SELECT event_type, event_id % 2 = 0 AS y, CASE WHEN event_type = 'view' AND event_id % 9 = 0 THEN NULL ELSE gated_alarm END AS f FROM g) GROUP BY event_type) SELECT event_type, u AS unresolved_rows, CASE WHEN u = 0 THEN tp END AS tp, CASE WHEN u = 0 THEN fp END AS fp, CASE WHEN u = 0 THEN fn END AS fn, CASE WHEN u = 0 THEN tn END AS tn, CASE WHEN u = 0 THEN round(tp::DOUBLE / (tp + fn), 6) END AS recall, CASE WHEN u = 0 THEN round(tp::DOUBLE / (tp + fp), 6) END AS precision FROM c")
def _(spark, d):
    x = gated(spark, d).withColumns({"y": F.col("event_id") % 2 == 0, "f": F.when((F.col("event_type") == "view") & (F.col("event_id") % 9 == 0), F.lit(None)).otherwise(F.col("gated_alarm"))})
    return m.confusion(x, "y", "f", ["event_type"])


@query("E8_weighted_confusion", GATED + ", c AS (SELECT sum(CASE WHEN label AND gated_alarm THEN w ELSE 0 END) AS tp, sum(CASE WHEN NOT label AND gated_alarm THEN w ELSE 0 END) AS fp, sum(CASE WHEN label AND NOT gated_alarm THEN w ELSE 0 END) AS fn, sum(CASE WHEN NOT label AND NOT gated_alarm THEN w ELSE 0 END) AS tn FROM (SELECT *, CASE WHEN label THEN 20.0::DOUBLE ELSE 2000.0::DOUBLE END AS w FROM g)) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def _(spark, d):
    return m.weighted_confusion(gated(spark, d).withColumn("w", F.when(F.col("label"), 20.0).otherwise(2000.0)), "label", "gated_alarm", "w")


CALLED = ", b AS (SELECT event_type, band AS truth, CASE WHEN prob BETWEEN 0.4 AND 0.5 THEN 'review' WHEN prob < 0.4 THEN 'near' WHEN prob < 0.7 THEN 'boundary' ELSE 'normal' END AS pred FROM ep) "


def called(spark, d):
    p = F.col("prob")
    return endpoints(spark, d).select("event_type", F.col("band").alias("truth"), F.when(p.between(0.4, 0.5), "review").when(p < 0.4, "near").when(p < 0.7, "boundary").otherwise("normal").alias("pred"))


CLASSES = ["near", "boundary", "normal"]


@query("E9_band_confusion", CALLED + "SELECT e.event_type, c.x AS truth, p.x AS prediction, (SELECT count(*) FROM b WHERE b.event_type = e.event_type AND b.truth = c.x AND b.pred = p.x) AS n FROM (SELECT DISTINCT event_type FROM b) e, (SELECT unnest(['near', 'boundary', 'normal']) AS x) c, (SELECT unnest(['near', 'boundary', 'normal', 'review']) AS x) p")
def _(spark, d):
    return m.band_confusion(called(spark, d), "truth", "pred", CLASSES, ["event_type"])


@query("E9_band_metrics", CALLED + ", x AS (SELECT event_type, count(*) AS n, count(*) FILTER (pred = 'review')::DOUBLE / count(*) AS review_fraction, count(*) FILTER (pred <> 'review' AND pred <> truth)::DOUBLE / count(*) FILTER (pred <> 'review') AS automatic_error_rate, "
    + ", ".join(f"count(*) FILTER (truth = '{c}' AND pred = '{c}')::DOUBLE AS tp_{c}, count(*) FILTER (truth = '{c}')::DOUBLE AS nt_{c}, count(*) FILTER (pred = '{c}')::DOUBLE AS np_{c}" for c in CLASSES)
    + ", count(*) FILTER (truth = 'near' AND pred = 'normal')::DOUBLE / count(*) FILTER (truth = 'near') AS first_as_last, count(*) FILTER (truth = 'normal' AND pred = 'near')::DOUBLE / count(*) FILTER (truth = 'normal') AS last_as_first FROM b GROUP BY event_type) SELECT event_type, n, round(review_fraction, 6) AS review_fraction, round(automatic_error_rate, 6) AS automatic_error_rate, "
    + ", ".join(f"round(tp_{c} / nt_{c}, 6) AS recall_{c}, round(tp_{c} / np_{c}, 6) AS precision_{c}, round(2 * tp_{c} / (nt_{c} + np_{c}), 6) AS f1_{c}" for c in CLASSES)
    + ", round(first_as_last, 6) AS first_as_last, round(last_as_first, 6) AS last_as_first, round((" + " + ".join(f"tp_{c} / nt_{c}" for c in CLASSES) + ") / 3, 6) AS balanced_accuracy, round((" + " + ".join(f"2 * tp_{c} / (nt_{c} + np_{c})" for c in CLASSES) + ") / 3, 6) AS macro_f1 FROM x")
def _(spark, d):
    return m.band_metrics(called(spark, d), "truth", "pred", CLASSES, ["event_type"])


AUC = "SELECT {by} round((sum(p * (b + 0.5 * n)) / (sum(p) * sum(n))), 6) AS auc FROM (SELECT *, coalesce(sum(n) OVER ({part} ORDER BY {s} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT {by} {s}, sum(CASE WHEN label THEN {w} ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN label THEN 0 ELSE {w} END)::DOUBLE AS n FROM {t} GROUP BY ALL)) {group}"


@query("E10_roc_auc", AUC.format(by="", part="", s="value", w="1.0::DOUBLE", t="ep", group=""))
def _(spark, d):
    return m.roc_auc(endpoints(spark, d), "label", "value")


@query("E10_roc_auc_weighted", AUC.format(by="band,", part="PARTITION BY band", s="prob", w="value", t="ep", group="GROUP BY band"))
def _(spark, d):
    return m.roc_auc(endpoints(spark, d), "label", "prob", "value", ["band"])


AP = "SELECT {by} round(sum(p * tp / al) / sum(p), 6) AS average_precision FROM (SELECT *, sum(p) OVER w AS tp, sum(p + n) OVER w AS al FROM (SELECT {by} {s}, sum(CASE WHEN label THEN 1 ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN label THEN 0 ELSE 1 END)::DOUBLE AS n FROM ep GROUP BY ALL) WINDOW w AS ({part} ORDER BY {s} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) {group}"


@query("E11_average_precision", AP.format(by="band,", part="PARTITION BY band", s="value", group="GROUP BY band"))
def _(spark, d):
    return m.average_precision(endpoints(spark, d), "label", "value", None, ["band"])


@query("E12_regression_metrics", "SELECT event_type, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / (var_pop(value) * count(*)), 6) AS r2, round(100 * avg(coalesce(abs(e) / nullif(abs(value) + abs(f), 0), 0)), 6) AS smape FROM (SELECT event_type, value, 100 * prob AS f, value - 100 * prob AS e FROM ep) GROUP BY event_type")
def _(spark, d):
    return m.regression_metrics(endpoints(spark, d).withColumn("f", 100 * F.col("prob")), "value", "f", ["event_type"])


@query("E13_correlation", "SELECT event_type, count(*) AS n_pairs, round(corr(value, prob), 6) AS r FROM ep GROUP BY event_type")
def _(spark, d):
    return m.correlation(endpoints(spark, d), "value", "prob", "pearson", ["event_type"])


@query("E13_spearman", ", k AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY event_type ORDER BY prob) + (count(*) OVER (PARTITION BY event_type, prob) - 1) / 2.0::DOUBLE AS b FROM ep) SELECT event_type, count(*) AS n_pairs, round(corr(a, b), 6) AS r FROM k GROUP BY event_type")
def _(spark, d):
    return m.correlation(endpoints(spark, d), "value", "prob", "spearman", ["event_type"])


@query("E13_correlation_pairs", "SELECT 'l_quantity' AS a, 'l_discount' AS b, count(*) AS n_pairs, round(corr(l_quantity, l_discount), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', count(*), round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', count(*), round(corr(l_discount, l_tax), 6) FROM lineitem")
def _(spark, d):
    return m.correlation_pairs(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


EFFECT = ", ".join(f"quantile_cont(v, {p}) FILTER (label = {k}) AS q{p * 100:.0f}_{k}" for p in (0.25, 0.5, 0.75) for k in ("true", "false"))


@query("E14_robust_effect", f"SELECT feature, prior_rank, round((q50_true - q50_false) / sqrt(((q75_true - q25_true) ** 2 + (q75_false - q25_false) ** 2) / 2), 6) AS effect FROM (SELECT feature, prior_rank, {EFFECT} FROM (SELECT label, 'value' AS feature, 1 AS prior_rank, value AS v FROM ep UNION ALL SELECT label, 'prob', 2, prob FROM ep) GROUP BY ALL)")
def _(spark, d):
    return m.robust_effect(endpoints(spark, d), "label", ["value", "prob"])


@query("E14_best_pair")
def _(spark, d):
    x = table(spark, d, "lineitem").withColumn("y", F.col("l_returnflag") == "R")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return m.best_pair(m.robust_effect(x, "y", names), m.correlation_pairs(x, names), 0.0, 0.9)


@query("E15_separation", """, x AS (SELECT event_type, band, prob, band = 'near' AS label FROM ep), a AS (""" + AUC.format(by="event_type,", part="PARTITION BY event_type", s="prob", w="1", t="(SELECT * FROM x WHERE band <> 'boundary')", group="GROUP BY event_type") + """),
 ap AS (SELECT event_type, round(sum(p * tp / al) / sum(p), 6) AS average_precision FROM (SELECT *, sum(p) OVER w AS tp, sum(p + n) OVER w AS al FROM (SELECT event_type, prob, sum(label::INT)::DOUBLE AS p, sum(1 - label::INT)::DOUBLE AS n FROM x WHERE band <> 'boundary' GROUP BY ALL) WINDOW w AS (PARTITION BY event_type ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY event_type),
 s AS (SELECT event_type, count(*) AS n, avg(prob) FILTER (band = 'normal') AS a, avg(prob) FILTER (band = 'boundary') AS b, avg(prob) FILTER (band = 'near') AS c, 1.0::DOUBLE AS parse_rate, count(*) FILTER (abs(prob - 0.5) <= 0.1)::DOUBLE / count(*) AS ms, count(*) FILTER (prob <= 0.1 OR prob >= 0.9)::DOUBLE / count(*) AS es, avg(abs(prob - 0.5) * 2) AS mc FROM x GROUP BY event_type)
SELECT event_type, n, round(a, 6) AS mean_normal, round(b, 6) AS mean_boundary, round(c, 6) AS mean_near, parse_rate, round(ms, 6) AS middle_share, round(es, 6) AS extreme_share, round(mc, 6) AS mean_confidence, round(c - a, 6) AS gap, a < b AND b < c AS ordered, auc, average_precision FROM s JOIN a USING (event_type) JOIN ap USING (event_type)""")
def _(spark, d):
    return m.separation(endpoints(spark, d), "band", "prob", ["event_type"])


@query("E16_macro_average", ", x AS (SELECT event_type, avg(value) AS mean, avg(prob) AS p FROM ep GROUP BY event_type) SELECT event_type, round(mean, 6) AS mean, round(p, 6) AS p FROM x UNION ALL SELECT 'macro', round(avg(mean), 6), round(avg(p), 6) FROM x")
def _(spark, d):
    x = endpoints(spark, d).groupBy("event_type").agg(F.avg("value").alias("mean"), F.avg("prob").alias("p"))
    return m.macro_average(x, "event_type", ["mean", "p"])


@query("E17_scoped", "SELECT scope, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT 'error' AS scope, value FROM ep WHERE event_type = 'error' UNION ALL SELECT 'error+view', value FROM ep WHERE event_type IN ('error', 'view')) GROUP BY scope")
def _(spark, d):
    return m.scoped(endpoints(spark, d), "event_type", {"error": ["error"], "error+view": ["error", "view"]}).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query("E18_usage_summary", ", x AS (SELECT event_type, value FROM ep UNION ALL SELECT 'all', value FROM ep) SELECT event_type, count(*) AS n, round(sum(value), 6) AS value_sum, round(quantile_cont(value, 0.5), 6) AS value_p50, round(quantile_cont(value, 0.95), 6) AS value_p95, round(list_sort(list(value))[ceil(0.95::DOUBLE * (count(value) - 1))::INT + 1], 6) AS value_p95_higher, max(value) AS value_max FROM x GROUP BY event_type")
def _(spark, d):
    return m.usage_summary(endpoints(spark, d), "event_type", ["value"])


@query("E19_attempt_accounting", """, a AS (SELECT event_type, user_id, count(*) FILTER (NOT hit) AS c, count(*) FILTER (hit) AS h, count(*) FILTER (prob >= 0.2) AS ok, sum(CASE WHEN NOT hit THEN cost END) AS r, count(*) FILTER (NOT hit AND cost IS NULL) AS u FROM (SELECT *, event_id % 3 = 0 AS hit, CASE WHEN event_id % 5 <> 0 THEN value END AS cost FROM ep) GROUP BY ALL)
SELECT event_type, count(*) AS requests, sum(c)::BIGINT AS calls, sum(h)::BIGINT AS cache_hits, sum(greatest(c - 1, 0))::BIGINT AS retries, count(*) FILTER (ok = 0) AS unavailable, round(coalesce(sum(r), 0), 6) AS reported_cost, round(sum(u) * 0.5::DOUBLE, 6) AS fallback_cost, round(100.0::DOUBLE * sum(h) / (sum(c) + sum(h)), 6) AS savings_percent FROM a GROUP BY event_type""")
def _(spark, d):
    x = endpoints(spark, d).withColumns({"hit": F.col("event_id") % 3 == 0, "cost": F.when(F.col("event_id") % 5 != 0, F.col("value")), "status": F.when(F.col("prob") >= 0.2, "READY").otherwise("MODEL_UNAVAILABLE")})
    return m.attempt_accounting(x, ["user_id"], "event_type", "hit", "status", "cost", 0.5)


def claims(spark, d):
    x = endpoints(spark, d)
    packet = F.create_map(F.lit("value"), F.col("value"), F.lit("prob"), F.col("prob"))
    cited = F.array(F.struct(F.lit("value").alias("field"), (F.col("value") + F.when(F.col("event_id") % 7 == 0, 1.0).otherwise(0.0)).alias("value")), F.struct(F.lit("none").alias("field"), F.col("prob").alias("value")))
    return m.verify_claims(x.select("event_id", packet.alias("packet"), cited.alias("claims")), "event_id", "packet", "claims")


@query("E20_verify_claims", "SELECT event_id, 0 AS claim_no, 'value' AS field, round(value + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, 6) AS cited, round(value, 6) AS found, event_id % 7 <> 0 AS agrees FROM ep UNION ALL SELECT event_id, 1, 'none', round(prob, 6), NULL, false FROM ep")
def _(spark, d):
    return claims(spark, d)


@query("E20_claim_agreement", "SELECT 2 * count(*) AS n_claims, count(*) FILTER (event_id % 7 <> 0) AS n_match, round(count(*) FILTER (event_id % 7 <> 0)::DOUBLE / (2 * count(*)), 6) AS agreement FROM ep")
def _(spark, d):
    return m.claim_agreement(claims(spark, d))


@query("E21_stability", "SELECT user_id, event_type, count(value) AS n, round(stddev_samp(value), 6) AS std, round(max(value) - min(value), 6) AS value_range, min(value) <= 20 AND max(value) > 20 AS crosses_0 FROM ep GROUP BY ALL")
def _(spark, d):
    return m.stability(endpoints(spark, d), ["user_id", "event_type"], "value", [20])


@query("E21_repeat_delta", """SELECT event_type, count(d) AS n, round(avg(d), 6) AS mean_delta, round(avg(abs(d)), 6) AS mean_abs_delta, round(max(abs(d)), 6) AS max_abs_delta, round(stddev_samp(d), 6) AS std_delta,
 count(*) FILTER (d IS NOT NULL AND (value >= 20)::INT + (value >= 60)::INT <> (r >= 20)::INT + (r >= 60)::INT) AS n_changed FROM (SELECT *, 100 * prob AS r, 100 * prob - value AS d FROM ep) GROUP BY event_type""")
def _(spark, d):
    return m.repeat_delta(endpoints(spark, d).withColumn("r", 100 * F.col("prob")), ["event_type"], "value", "r", [20, 60])


@query("E22_error_profile", """, x AS (SELECT user_id, 'event_type' AS dimension, event_type AS level, value - 100 * prob AS e, (value <= 20)::INT::DOUBLE AS a, label, prob AS s FROM ep UNION ALL SELECT user_id, 'band', band, value - 100 * prob, (value <= 20)::INT::DOUBLE, label, prob FROM ep),
 au AS (SELECT dimension, level, sum(p * (b + 0.5 * n)) / nullif(sum(p) * sum(n), 0) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY dimension, level ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT dimension, level, s, sum(label::INT)::DOUBLE AS p, sum(1 - label::INT)::DOUBLE AS n FROM x GROUP BY ALL)) GROUP BY ALL)
SELECT x.dimension, x.level, count(*) AS n, round(median(e), 6) AS median_error, round(quantile_cont(e, 0.25), 6) AS q1_error, round(quantile_cont(e, 0.75), 6) AS q3_error, round(count(*) FILTER (e < 0)::DOUBLE / count(e), 6) AS early_share, round(count(*) FILTER (e > 0)::DOUBLE / count(e), 6) AS late_share, round(avg(a), 6) AS alarm_rate, round(any_value(auc), 6) AS auc FROM x JOIN au ON x.dimension = au.dimension AND x.level = au.level GROUP BY ALL""")
def _(spark, d):
    x = endpoints(spark, d).withColumns({"e": F.col("value") - 100 * F.col("prob"), "a": F.col("value") <= 20})
    return m.error_profile(x.withColumn("a", F.col("a").cast("int")), ["event_type", "band"], "e", "a", "label", "prob")


@query("E23_cost_curve", GATED + ", c AS (SELECT event_type, count(*) FILTER (gated_alarm) AS reviews, count(*) FILTER (label AND NOT gated_alarm) AS missed FROM g GROUP BY event_type) SELECT event_type, r::INT AS ratio, reviews + missed * r AS total_cost FROM c, (SELECT unnest(range(1, 21)) AS r)")
def _(spark, d):
    x = gated(spark, d).groupBy("event_type").agg(F.count_if(F.col("gated_alarm")).alias("reviews"), F.count_if(F.col("label") & ~F.col("gated_alarm")).alias("missed"))
    return m.cost_curve(x, "reviews", "missed").select("event_type", "ratio", "total_cost")


@query("E24_rank_features", ", x AS (SELECT event_type AS target, user_id AS feature, avg(value) AS importance FROM ep GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY importance DESC) AS k FROM x), a AS (SELECT feature, count(*) FILTER (k <= 10) AS n_top, avg(k) AS mean_rank, avg(importance) AS mean_importance FROM r GROUP BY feature) SELECT feature, n_top, round(mean_rank, 6) AS mean_rank, round(mean_importance, 6) AS mean_importance, (row_number() OVER (ORDER BY n_top DESC, mean_rank, mean_importance DESC, feature))::INT AS aggregate_rank FROM a")
def _(spark, d):
    # Ranks tell apart means that differ in the last bit, so values are added up in the order of events, wherever they lie.
    keys = ["event_type", "user_id"]
    x = endpoints(spark, d).select(*keys, m.mean_so_far("value", keys, ["event_id", "value"]).alias("_m"))
    x = x.groupBy(F.col("event_type").alias("target"), F.col("user_id").alias("feature")).agg(F.max("_m")["mean"].alias("importance"))
    return m.rank_features(x, "target", "feature", "importance", 10)


@query("E25_redundant_pairs", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n_pairs, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem HAVING abs(corr(l_quantity, l_extendedprice)) >= 0.5 UNION ALL SELECT 'l_discount', 'l_tax', count(*), round(corr(l_discount, l_tax), 6) FROM lineitem HAVING abs(corr(l_discount, l_tax)) >= 0.5 UNION ALL SELECT 'l_quantity', 'l_discount', count(*), round(corr(l_quantity, l_discount), 6) FROM lineitem HAVING abs(corr(l_quantity, l_discount)) >= 0.5")
def _(spark, d):
    x = m.correlation_pairs(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return m.redundant_pairs(x, 0.5)


NET = "l_extendedprice * (1 - l_discount)"


@query("E25_redundant_net", f", l AS (SELECT l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p, ({NET})::DOUBLE AS n FROM lineitem), x AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n_pairs, corr({u}, {v}) AS r FROM l" for a, b, u, v in (("l_quantity", "l_extendedprice", "q", "p"), ("l_quantity", "net", "q", "n"), ("l_extendedprice", "net", "p", "n"))) + ") SELECT a, b, n_pairs, round(r, 6) AS r FROM x WHERE abs(r) >= 0.9")
def _(spark, d):
    x = table(spark, d, "lineitem").withColumn("net", F.expr(NET).cast("double"))
    return m.redundant_pairs(m.correlation_pairs(x, ["l_quantity", "l_extendedprice", "net"]), 0.9)


@query("E25_compact_features")
def _(spark, d):
    x = table(spark, d, "lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    ranked = x.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(n[:3]).alias("sensor"), F.col(n).cast("double").alias("v")) for n in names])))
    ranked = m.rank_features(ranked.groupBy("sensor", "feature").agg(F.stddev_pop("v").alias("importance")), "sensor", "feature", "importance", 2).withColumn("sensor", F.substring("feature", 1, 4))
    return spark.createDataFrame([(i, f) for i, f in enumerate(m.compact_features(ranked, m.correlation_pairs(x, names), 3, 0.5))], "place int, feature string")


@query("E26_paired_delta", """SELECT event_type, arm, count(d) AS n, round(avg(d), 6) AS mean_delta, round(avg(abs(d)), 6) AS mean_abs_delta, round(min(d), 6) AS min_delta, round(max(d), 6) AS max_delta, round(stddev_samp(d), 6) AS std_delta FROM (SELECT event_type, a AS arm, value * a - value AS d FROM ep, (SELECT unnest([0.5::DOUBLE, 2.0::DOUBLE]) AS a)) GROUP BY ALL""")
def _(spark, d):
    x = perturb_arms(endpoints(spark, d).select("event_id", "event_type", "value"), "value", [0.5, 1.0, 2.0])
    return m.paired_delta(x, ["event_id"], "arm", "value", [0.5, 1.0, 2.0], 1.0, ["event_type"])


@query("E26_unpaired_delta", """SELECT event_type, round(o, 6) AS old_separation, round(n, 6) AS new_separation, round(n - o, 6) AS unpaired_delta FROM
 (SELECT event_type, avg(prob) FILTER (band = 'near') - avg(prob) FILTER (band = 'normal') AS o FROM ep WHERE t < (SELECT avg(t) FROM ep) GROUP BY event_type) FULL JOIN
 (SELECT event_type, avg(prob) FILTER (band = 'near') - avg(prob) FILTER (band = 'normal') AS n FROM ep WHERE t >= (SELECT avg(t) FROM ep) GROUP BY event_type) USING (event_type)""")
def _(spark, d):
    x = endpoints(spark, d)
    x = x.crossJoin(F.broadcast(x.agg(F.avg("t").alias("half"))))  # one row
    return m.unpaired_delta(x.where(F.col("t") < F.col("half")), x.where(F.col("t") >= F.col("half")), ["event_type"], "band", "prob", "near", "normal")


@query("E27_constant_baselines", "SELECT c AS always, round(1 / 3.0::DOUBLE, 6) AS balanced_accuracy, round(2.0::DOUBLE * (SELECT count(*) FROM ep WHERE band = c) / ((SELECT count(*) FROM ep) + (SELECT count(*) FROM ep WHERE band = c)) / 3, 6) AS macro_f1 FROM (SELECT unnest(['near', 'boundary', 'normal']) AS c)")
def _(spark, d):
    return m.constant_baselines(endpoints(spark, d), "band", CLASSES)


@query("E28_pipeline_metrics", GATED + """SELECT round(count(*) FILTER (band = 'near' AND f)::DOUBLE / count(*) FILTER (band = 'near'), 6) AS detection_recall, round(count(*) FILTER (band = 'normal' AND f)::DOUBLE / count(*) FILTER (band = 'normal'), 6) AS false_alarm_rate,
  round(count(*) FILTER (band = 'boundary' AND f)::DOUBLE / count(*) FILTER (band = 'boundary'), 6) AS boundary_fraction, round(count(*) FILTER (f)::DOUBLE / count(*), 6) AS output_fraction,
  round(sqrt(avg((value - 100 * prob) ** 2) FILTER (f)), 6) AS rmse, round(100 * avg(abs(value - 100 * prob) / (abs(value) + abs(100 * prob))) FILTER (f), 6) AS smape,
  (SELECT round(median(l), 6) FROM (SELECT max(value) AS l FROM g WHERE prob >= 0.7 AND value <= 50 GROUP BY user_id)) AS median_lead FROM (SELECT *, prob >= 0.7 AS f FROM g)""")
def _(spark, d):
    x = gated(spark, d).withColumns({"f": F.col("prob") >= 0.7, "yhat": 100 * F.col("prob")})
    return m.pipeline_metrics(x, "band", "f", "value", "yhat", "value", 50, ["user_id"])
