"""Queries of ranking, routing and sampling (F, G), and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_integer
from ..operators import metrics as m
from ..operators import routing as r
from ..operators import sampling as g
from ..operators.sequence import event_detection
from .base import GATED, endpoints, gated, query, table

U = "('0x' || substr(sha256('42|' || {k}), 1, 15))::BIGINT"
UD = "(" + U + "::DOUBLE / 1152921504606846976.0::DOUBLE)"


def flagship(spark, d):
    """Which alarms does the gate throw away, and how many of them were real? By scope, with sequences detected."""
    scopes = {"mobile": ["click", "error"], "all": ["click", "error", "purchase", "view", "login"]}
    x = gated(spark, d).withColumn("scope_key", F.col("event_type"))
    lane = r.lane_effect(m.scoped(x, "scope_key", scopes), "label", "gated_alarm", "rescue", ["scope"])
    conf = m.confusion(m.scoped(x, "scope_key", scopes), "label", "gated_alarm", ["scope"])
    seen = event_detection(x, ["user_id"], "label", "value", ["gated_alarm", "forecast_alarm"])
    seen = seen.agg(F.count(F.lit(1)).alias("sequences"), F.count_if(F.col("gated_alarm_detected")).alias("gated_detected"), F.count_if(F.col("forecast_alarm_detected")).alias("forecast_detected"))
    return conf.join(lane, "scope").crossJoin(seen)  # one row


@query("flagship_rescue_lane", GATED + """, s AS (SELECT 'mobile' AS scope, * FROM g WHERE event_type IN ('click', 'error') UNION ALL SELECT 'all', * FROM g WHERE event_type IN ('click', 'error', 'purchase', 'view', 'login')),
 c AS (SELECT scope, count(*) FILTER (label AND gated_alarm) AS tp, count(*) FILTER (NOT label AND gated_alarm) AS fp, count(*) FILTER (label AND NOT gated_alarm) AS fn, count(*) FILTER (NOT label AND NOT gated_alarm) AS tn, count(*) FILTER (rescue) AS lane_rows, count(*) FILTER (label AND rescue) AS recovered, count(*) FILTER (label) AS positives FROM s GROUP BY scope),
 e AS (SELECT count(*) AS sequences, count(*) FILTER (a) AS gated_detected, count(*) FILTER (b) AS forecast_detected FROM (SELECT bool_or(label AND gated_alarm) AS a, bool_or(label AND forecast_alarm) AS b FROM g GROUP BY user_id HAVING bool_or(label)))
SELECT scope, 0::BIGINT AS unresolved_rows, tp, fp, fn, tn, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(tp::DOUBLE / (tp + fp), 6) AS precision, positives, tp AS baseline_tp, lane_rows, recovered, round(recovered::DOUBLE / nullif(positives - tp, 0), 6) AS recovery_rate, round(recovered::DOUBLE / nullif(lane_rows, 0), 6) AS lane_precision, round(tp::DOUBLE / positives, 6) AS baseline_recall, round((tp + recovered)::DOUBLE / positives, 6) AS lane_recall, round((tp + recovered)::DOUBLE / positives - tp::DOUBLE / positives, 6) AS recall_change, sequences, gated_detected, forecast_detected FROM c, e""")
def _(spark, d):
    return flagship(spark, d)


@query("F1_stable_rank", "SELECT event_id, row_number() OVER (ORDER BY s DESC NULLS LAST, event_id) AS rank FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN value END AS s FROM ep)")
def _(spark, d):
    x = endpoints(spark, d).withColumn("s", F.when(F.col("event_id") % 11 != 0, F.col("value")))
    return r.stable_rank(x.select("event_id", "s"), "s", ["event_id"]).select("event_id", "rank")


@query("F1_stable_rank_by_group", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM ep")
def _(spark, d):
    return r.stable_rank(endpoints(spark, d), "value", ["event_id"], ["event_type"]).select("event_id", "rank")


@query("F2_top_fraction", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ep) WHERE k <= floor(n * 0.2::DOUBLE + 0.5::DOUBLE)")
def _(spark, d):
    return r.top_fraction(r.stable_rank(endpoints(spark, d), "value", ["event_id"], ["user_id"]), "rank", 0.2, ["user_id"]).select("event_id")


@query("F3_precision_at", "SELECT count(*) AS reviewed, count(*) FILTER (label) AS hits, round(count(*) FILTER (label)::DOUBLE / count(*), 6) AS precision FROM (SELECT label, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ep) WHERE k <= floor(n * 0.2::DOUBLE + 0.5::DOUBLE)")
def _(spark, d):
    return r.precision_at(r.stable_rank(endpoints(spark, d), "value", ["event_id"], ["user_id"]), "rank", "label", 0.2, ["user_id"])


@query("F4_route", f"SELECT event_id, route, round(draw, 6) AS draw, route = 'LOW' AND draw < 0.1 AS audited, route = 'MID' OR (route = 'LOW' AND draw < 0.1) AS judge_called, true AS alarm_retained FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'DATA_REVIEW' WHEN 2 * prob >= 1.5 THEN 'HIGH' WHEN 2 * prob >= 0.5 THEN 'MID' ELSE 'LOW' END AS route, {UD.format(k='event_id')} AS draw FROM ep)")
def _(spark, d):
    x = endpoints(spark, d).withColumn("s", F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(2 * F.col("prob")))
    return r.route(x, "s", 0.5, 1.5, 0.1, ["event_id"]).select("event_id", "route", "draw", "audited", "judge_called", "alarm_retained")


QUEUE = """, x AS (SELECT event_id, event_type, CASE WHEN event_id % 11 <> 0 THEN prob END AS s, value FROM ep), y AS (SELECT *, row_number() OVER ({p} ORDER BY s DESC NULLS LAST, event_id) AS k, count(s) OVER ({p}) AS n FROM x),
 z AS (SELECT *, CASE WHEN s IS NULL THEN 3 WHEN k <= floor(n * 0.25::DOUBLE + 0.5) THEN 0 WHEN k <= floor(n * 0.25::DOUBLE + 0.5) + floor(n * 0.5::DOUBLE + 0.5) THEN 1 ELSE 2 END AS q FROM y)
 SELECT event_id, ['HIGH', 'MID', 'LOW', 'UNAVAILABLE'][q + 1] AS queue_tier, row_number() OVER ({p} ORDER BY q, CASE WHEN q = 1 THEN value END DESC NULLS LAST, k) AS queue_rank FROM z"""


@query("F5_tiered_queue", QUEUE.format(p=""))
def _(spark, d):
    x = endpoints(spark, d).select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("prob")).alias("s"), "value")
    return r.tiered_queue(x, "s", "value", ["event_id"]).select("event_id", "queue_tier", "queue_rank")


@query("F5_tiered_queue_by_group", QUEUE.format(p="PARTITION BY event_type"))
def _(spark, d):
    x = endpoints(spark, d).select("event_id", "event_type", F.when(F.col("event_id") % 11 != 0, F.col("prob")).alias("s"), "value")
    return r.tiered_queue(x, "s", "value", ["event_id"], ["event_type"]).select("event_id", "queue_tier", "queue_rank")


@query("F6_random_queues", f"SELECT rep::INT AS rep, user_id, event_id, k::INT AS queue_rank FROM (SELECT rep, user_id, event_id, row_number() OVER (PARTITION BY rep, user_id ORDER BY {U.format(k="rep || '|' || event_id")}, event_id) AS k FROM ep, (SELECT unnest(range(5)) AS rep)) WHERE k <= 3")
def _(spark, d):
    return r.random_queues(endpoints(spark, d).select("user_id", "event_id"), ["event_id"], 5, 3, ["user_id"]).select("rep", "user_id", "event_id", "queue_rank")


@query("F7_compose_queue", """SELECT event_id, CASE WHEN st <> 'READY' THEN NULL WHEN called THEN j ELSE prob END AS queue_score, CASE WHEN st = 'READY' AND called AND j IS NOT NULL THEN 'judge' WHEN st = 'READY' AND NOT called THEN 'router' ELSE 'none' END AS score_source,
 CASE WHEN st <> 'READY' THEN st WHEN called AND j IS NULL THEN 'MODEL_UNAVAILABLE' ELSE 'READY' END AS queue_status FROM (SELECT event_id, prob, event_id % 2 = 0 AS called, CASE WHEN event_id % 10 <> 0 THEN 1 - prob END AS j, CASE WHEN event_id % 9 = 0 THEN 'DATA_REVIEW' ELSE 'READY' END AS st FROM ep)""")
def _(spark, d):
    x = endpoints(spark, d).withColumns({"called": F.col("event_id") % 2 == 0, "j": F.when(F.col("event_id") % 10 != 0, 1 - F.col("prob")), "st": F.when(F.col("event_id") % 9 == 0, "DATA_REVIEW").otherwise("READY")})
    return r.compose_queue(x, "called", "j", "prob", "st").select("event_id", "queue_score", "score_source", "queue_status")


@query("F8_lane_effect", GATED + "SELECT user_id, p AS positives, b AS baseline_tp, l AS lane_rows, x AS recovered, round(x::DOUBLE / nullif(p - b, 0), 6) AS recovery_rate, round(x::DOUBLE / nullif(l, 0), 6) AS lane_precision, round(b::DOUBLE / nullif(p, 0), 6) AS baseline_recall, round((b + x)::DOUBLE / nullif(p, 0), 6) AS lane_recall, round((b + x)::DOUBLE / nullif(p, 0) - b::DOUBLE / nullif(p, 0), 6) AS recall_change FROM (SELECT user_id, count(*) FILTER (label) AS p, count(*) FILTER (label AND gated_alarm) AS b, count(*) FILTER (rescue) AS l, count(*) FILTER (label AND rescue) AS x FROM g GROUP BY user_id)")
def _(spark, d):
    return r.lane_effect(gated(spark, d), "label", "gated_alarm", "rescue", ["user_id"])


@query("F9_review_curve", GATED + ", c AS (SELECT count(*) FILTER (label) AS positives, count(*) FILTER (label AND gated_alarm) AS base_tp, count(*) FILTER (rescue) AS lane, count(*) FILTER (label AND rescue) AS lane_positives FROM g) SELECT positives, base_tp, lane, lane_positives, share, round_even(lane * share, 0)::BIGINT AS reviews, round(base_tp + round_even(lane * share, 0) * lane_positives / lane, 6) AS expected_tp, round((base_tp + round_even(lane * share, 0) * lane_positives / lane) / positives, 6) AS expected_recall FROM c, (SELECT unnest([0.0::DOUBLE, 0.2::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS share)")
def _(spark, d):
    return r.review_curve(gated(spark, d), "label", "gated_alarm", "rescue", [0, 0.2, 0.5, 1])


@query("F10_recall_threshold", "SELECT event_id % 3 AS part, max(prob) FILTER (tp / al >= 0.9 - 1e-12) AS threshold FROM (SELECT event_id, prob, sum(p) OVER (PARTITION BY event_id ORDER BY prob DESC) AS tp, sum(p) OVER (PARTITION BY event_id) AS al FROM (SELECT event_id % 3 AS event_id, prob, sum(label::INT)::DOUBLE AS p FROM ep GROUP BY ALL)) GROUP BY event_id")
def _(spark, d):
    return r.recall_threshold(endpoints(spark, d).withColumn("part", F.col("event_id") % 3), "label", "prob", 0.9, ["part"])


@query("F11_budgeted_threshold", ", s AS (SELECT band, prob, sum(label::INT)::DOUBLE AS p, sum(1 - label::INT)::DOUBLE AS n FROM ep GROUP BY ALL), c AS (SELECT band, prob, coalesce(sum(n) OVER w, 0) AS removed_fp, coalesce(sum(p) OVER w, 0) AS lost_tp, sum(p) OVER (PARTITION BY band) AS al FROM s WINDOW w AS (PARTITION BY band ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT band, prob AS threshold, removed_fp, lost_tp FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY removed_fp DESC, prob) AS k FROM c WHERE lost_tp <= greatest(1, floor(al * 0.1::DOUBLE))) WHERE k = 1")
def _(spark, d):
    return r.budgeted_threshold(endpoints(spark, d), "label", "prob", 0.1, ["band"])


FIELD = "SELECT '{f}' AS field, {k} AS pr, band, {f} AS threshold, removed_fp, lost_tp FROM (SELECT *, coalesce(sum(n) OVER w, 0) AS removed_fp, coalesce(sum(p) OVER w, 0) AS lost_tp, sum(p) OVER (PARTITION BY band) AS al FROM (SELECT band, {f}, sum(label::INT)::DOUBLE AS p, sum(1 - label::INT)::DOUBLE AS n FROM ep GROUP BY ALL) WINDOW w AS (PARTITION BY band ORDER BY {f} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE lost_tp <= greatest(1, floor(al * 0.1::DOUBLE)) QUALIFY row_number() OVER (PARTITION BY band ORDER BY removed_fp DESC, {f}) = 1"


@query("F11_choose_score", f", c AS ({FIELD.format(f='prob', k=0)} UNION ALL {FIELD.format(f='value', k=1)}) SELECT band, field, round(threshold, 6) AS threshold, removed_fp, lost_tp FROM c QUALIFY row_number() OVER (PARTITION BY band ORDER BY removed_fp DESC, lost_tp, pr) = 1")
def _(spark, d):
    return r.choose_score(endpoints(spark, d), "label", ["prob", "value"], 0.1, ["band"])


@query("F12_three_way", "SELECT event_id, CASE WHEN prob >= 0.7 THEN 'keep' WHEN prob < 0.3 THEN 'downgrade' ELSE 'review' END AS action FROM ep")
def _(spark, d):
    return r.three_way(endpoints(spark, d), "prob", 0.3, 0.7).select("event_id", "action")


@query("F12_three_way_counts", "SELECT band, count(*) FILTER (prob >= 0.7) AS n_keep, count(*) FILTER (prob >= 0.3 AND prob < 0.7) AS n_review, count(*) FILTER (prob < 0.3) AS n_downgrade, count(*) FILTER (prob < 0.3 AND label) AS lost_tp, count(*) FILTER (prob < 0.3 AND NOT label) AS removed_fp FROM ep GROUP BY band")
def _(spark, d):
    return r.three_way_counts(r.three_way(endpoints(spark, d), "prob", 0.3, 0.7), "label", ["band"])


@query("F13_fit_two_cuts", """, s AS (SELECT DISTINCT prob AS s FROM ep), c AS (SELECT (s + lead(s) OVER (ORDER BY s)) / 2 AS t FROM s), k AS (SELECT t AS cut FROM c WHERE t IS NOT NULL),
 b AS (SELECT event_type, cut AS t, count(*) FILTER (band = 'near' AND prob < cut)::DOUBLE / count(*) FILTER (band = 'near') AS a, count(*) FILTER (band = 'boundary' AND prob < cut)::DOUBLE / count(*) FILTER (band = 'boundary') AS m, count(*) FILTER (band = 'normal' AND prob < cut)::DOUBLE / count(*) FILTER (band = 'normal') AS z FROM ep, k GROUP BY ALL),
 f AS (SELECT x.t AS t1, y.t AS t2, round(avg((x.a + (y.m - x.m) + 1 - y.z) / 3), 10) AS o FROM b x JOIN b y ON x.event_type = y.event_type AND x.t < y.t GROUP BY ALL)
SELECT round(t1, 6) AS t1, round(t2, 6) AS t2, round(o, 6) AS balanced_accuracy FROM f ORDER BY o DESC, t1, t2 LIMIT 1""")
def _(spark, d):
    return r.fit_two_cuts(endpoints(spark, d), "prob", "band", ["near", "boundary", "normal"], ["event_type"])


@query("F13_fit_two_cuts_f1", """, s AS (SELECT DISTINCT prob AS s FROM ep), c AS (SELECT (s + lead(s) OVER (ORDER BY s)) / 2 AS t FROM s), k AS (SELECT t::DOUBLE AS cut FROM c WHERE t IS NOT NULL UNION SELECT 0::DOUBLE UNION SELECT 1::DOUBLE),
 b AS (SELECT event_type, cut AS t, count(*) FILTER (band = 'near' AND prob < cut)::DOUBLE AS a, count(*) FILTER (band = 'boundary' AND prob < cut)::DOUBLE AS m, count(*) FILTER (band = 'normal' AND prob < cut)::DOUBLE AS z, count(*) FILTER (band = 'near')::DOUBLE AS na, count(*) FILTER (band = 'boundary')::DOUBLE AS nm, count(*) FILTER (band = 'normal')::DOUBLE AS nz FROM ep, k WHERE prob IS NOT NULL GROUP BY ALL),
 f AS (SELECT x.t AS t1, y.t AS t2, round(avg((x.a / x.na + (y.m - x.m) / x.nm + 1 - y.z / x.nz) / 3), 10) AS o,
 round(avg((2 * x.a / (x.a + x.m + x.z + x.na) + 2 * (y.m - x.m) / (y.a + y.m + y.z - x.a - x.m - x.z + x.nm) + 2 * (x.nz - y.z) / (x.na + x.nm + x.nz - y.a - y.m - y.z + x.nz)) / 3), 10) AS f1
 FROM b x JOIN b y ON x.event_type = y.event_type AND x.t < y.t GROUP BY ALL)
SELECT round(t1, 6) AS t1, round(t2, 6) AS t2, round(o, 6) AS balanced_accuracy, round(f1, 6) AS macro_f1 FROM f ORDER BY o DESC, f.f1 DESC, f.t1, f.t2 LIMIT 1""")
def _(spark, d):
    return r.fit_two_cuts(endpoints(spark, d), "prob", "band", ["near", "boundary", "normal"], ["event_type"], ends=True, macro_f1=True)


@query("F14_abstaining_bands", "SELECT event_id, CASE WHEN prob < 0.4 THEN 'low' WHEN prob <= 0.6 THEN 'review' WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'middle' ELSE 'high' END AS band_call FROM ep")
def _(spark, d):
    return r.abstaining_bands(endpoints(spark, d), "value", "prob", (20, 60)).select("event_id", "band_call")


@query("F15_sensor_rules", "SELECT feature, round((median(v) FILTER (label) + median(v) FILTER (NOT label)) / 2, 6) AS midpoint, median(v) FILTER (NOT label) < median(v) FILTER (label) AS low_is_false FROM (SELECT label, 'value' AS feature, value AS v FROM ep UNION ALL SELECT label, 'prob', prob FROM ep) GROUP BY feature")
def _(spark, d):
    return r.sensor_rules(endpoints(spark, d), "label", ["value", "prob"])


@query("F15_sensor_rule", "SELECT event_id, value < 30 OR coalesce(CASE WHEN event_id % 5 <> 0 THEN prob END > 0.8, false) AS hold FROM ep")
def _(spark, d):
    x = endpoints(spark, d).withColumn("prob", F.when(F.col("event_id") % 5 != 0, F.col("prob")))
    return r.sensor_rule(x, {"value": (30, True), "prob": (0.8, False)}).select("event_id", "hold")


@query("F15_guarded_rule", ", h AS (SELECT event_id, label, value < 12 AS hold FROM ep), n AS (SELECT count(*) FILTER (label AND hold) <= greatest(1, 0.1::DOUBLE * count(*) FILTER (label)) AS active FROM h) SELECT event_id, hold AND active AS hold, active FROM h, n")
def _(spark, d):
    return r.guarded_rule(endpoints(spark, d), {"value": (12, True)}, "label").select("event_id", "hold", "active")


@query("F15_guarded_rule_off", ", h AS (SELECT event_id, label, value < 100 AS hold FROM ep), n AS (SELECT count(*) FILTER (label AND hold) <= greatest(1, 0.1::DOUBLE * count(*) FILTER (label)) AS active FROM h) SELECT event_id, hold AND active AS hold, active FROM h, n")
def _(spark, d):
    return r.guarded_rule(endpoints(spark, d), {"value": (100, True)}, "label").select("event_id", "hold", "active")


@query("G1_band_sample", f"SELECT event_id, p AS inclusion_probability, round(1 / p, 6) AS weight FROM (SELECT event_id, {UD.format(k='event_id')} AS u, CASE band WHEN 'near' THEN 0.5::DOUBLE WHEN 'normal' THEN 0.05::DOUBLE END AS p FROM ep) WHERE u < p")
def _(spark, d):
    return g.band_sample(endpoints(spark, d), "band", {"near": 0.5, "normal": 0.05}, ["event_id"]).select("event_id", "inclusion_probability", "weight")


@query("G1_population_counts", "SELECT band, count(*) AS population FROM ep GROUP BY band")
def _(spark, d):
    return g.population_counts(endpoints(spark, d), "band")


def counts(spark, d):
    return endpoints(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("G2_water_fill", """, c AS (SELECT user_id, count(*) AS n FROM ep GROUP BY user_id), l AS (SELECT max(x) AS l FROM (SELECT unnest(range(0, 2000)) AS x) WHERE (SELECT sum(least(n, x)) FROM c) <= (SELECT count(*) FROM ep) // 2),
 q AS (SELECT user_id, n, least(n, l) AS b, n > l AS more, (SELECT count(*) FROM ep) // 2 - sum(least(n, l)) OVER () AS rest, sum((n > l)::INT) OVER (ORDER BY user_id) AS place FROM c, l)
SELECT user_id, n, (b + (more AND place <= rest)::INT)::BIGINT AS quota FROM q""")
def _(spark, d):
    c = counts(spark, d)
    return g.water_fill(c, "user_id", "n", endpoints(spark, d).count() // 2)


@query("G3_spread_rows", """, x AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ep)
 SELECT event_id FROM x WHERE i IN (SELECT (j * (n - 1)) // (least(7, n) - 1) FROM (SELECT unnest(range(7)) AS j) WHERE j < least(7, n))""")
def _(spark, d):
    return g.spread_rows(endpoints(spark, d).withColumn("q", F.lit(7)), ["user_id"], ["t", "event_id"], "q").select("event_id")


@query("G4_percentile_rows", """, x AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ep)
 SELECT event_id, string_agg(p::VARCHAR, ',' ORDER BY p) AS percentiles FROM x, (SELECT unnest([0, 1, 50, 100]) AS p) WHERE i = (p * (n - 1)) // 100 GROUP BY event_id""")
def _(spark, d):
    return g.percentile_rows(endpoints(spark, d), ["user_id"], ["t", "event_id"], [0, 1, 50, 100]).select("event_id", F.array_join("percentiles", ",").alias("percentiles"))


@query("G5_choose_grid", ", c AS (SELECT user_id, count(*) AS n FROM ep GROUP BY user_id) SELECT max(k)::INT AS grid, (SELECT sum(least(n, 5))::BIGINT FROM c) AS total_rows FROM (SELECT unnest([10, 5, 2, 1]) AS k) WHERE (SELECT sum(least(n, k)) FROM c) <= (SELECT sum(least(n, 5)) FROM c)")
def _(spark, d):
    c = counts(spark, d)
    cap = c.agg(F.sum(F.least("n", F.lit(5)))).first()[0]
    return g.choose_grid(c, "n", cap)


@query("G6_sample_per_cell", f", x AS (SELECT event_id, band, event_type, count(*) OVER (PARTITION BY band, event_type) AS available, row_number() OVER (PARTITION BY band, event_type ORDER BY {U.format(k='event_id')}, event_id) AS k FROM ep) SELECT event_id, available FROM x WHERE k <= least(20, (SELECT min(available) FROM x))")
def _(spark, d):
    return g.sample_per_cell(endpoints(spark, d), ["band", "event_type"], 20, ["event_id"]).select("event_id", "available")


@query("G7_one_per_group", f", x AS (SELECT *, {U.format(k='event_id')} AS h FROM ep), y AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY h, event_id) AS a FROM x) SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) AS b FROM y WHERE a = 1) WHERE b <= 10")
def _(spark, d):
    return g.one_per_group(endpoints(spark, d), ["event_type"], "user_id", 10, ["event_id"]).select("event_id")


@query("G8_group_split", f", u AS (SELECT user_id, row_number() OVER (ORDER BY {U.format(k='user_id')}, user_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM ep)) SELECT event_id, CASE WHEN k <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM ep JOIN u USING (user_id)")
def _(spark, d):
    return g.group_split(endpoints(spark, d).select("event_id", "user_id"), "user_id", 0.2).select("event_id", "part")


@query("G9_equipment_split", f""", s AS (SELECT c_nationkey, c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY {U.format(k="c_nationkey || '|' || c_custkey")}, c_custkey) AS k FROM customer),
 a AS (SELECT *, CASE WHEN n >= 4 THEN greatest(1, round_even(n * 0.2::DOUBLE, 0)) ELSE 0 END AS te FROM s), b AS (SELECT *, CASE WHEN n - te >= 4 THEN greatest(1, round_even((n - te) * 0.1::DOUBLE, 0)) ELSE 0 END AS va FROM a)
SELECT c_nationkey, c_custkey, CASE WHEN k <= te THEN 'test' WHEN k <= te + va THEN 'validation' ELSE 'train' END AS part FROM b""")
def _(spark, d):
    return g.equipment_split(table(spark, d, "customer"), "c_nationkey", "c_custkey")


@query("G10_group_folds", f", s AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, {U.format(k='user_id')}, user_id) - 1 AS r FROM ep GROUP BY user_id) SELECT user_id, (CASE WHEN (r // 5) % 2 = 1 THEN 5 - r % 5 ELSE r % 5 + 1 END)::INT AS fold FROM s")
def _(spark, d):
    return g.group_folds(endpoints(spark, d), "user_id", 5)


@query("G10_stratified_folds", f""", c AS (SELECT user_id, event_type, count(*) AS c FROM ep GROUP BY ALL), t AS (SELECT user_id, event_type AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type DESC) AS k FROM c) WHERE k = 1),
 s AS (SELECT user_id, row_number() OVER (PARTITION BY s ORDER BY n DESC, {U.format(k='user_id')}, user_id) - 1 AS r FROM t JOIN (SELECT user_id, count(*) AS n FROM ep GROUP BY user_id) USING (user_id)) SELECT user_id, (CASE WHEN (r // 4) % 2 = 1 THEN 4 - r % 4 ELSE r % 4 + 1 END)::INT AS fold FROM s""")
def _(spark, d):
    return g.group_folds(endpoints(spark, d), "user_id", 4, "event_type")


@query("G11_leak_check", "SELECT count(*) FILTER (p > 1) AS split_groups, 0::BIGINT AS repeated_keys, 0::BIGINT AS rows_without_part FROM (SELECT user_id, count(DISTINCT CASE WHEN user_id % 10 = 0 THEN event_id % 2 ELSE 0 END) AS p FROM ep GROUP BY user_id)")
def _(spark, d):
    x = endpoints(spark, d).withColumn("part", F.when(F.col("user_id") % 10 == 0, F.col("event_id") % 2).otherwise(0))
    return g.leak_check(x, "user_id", "part", ["event_id"])


@query("G12_sample_audit", "SELECT event_type, sum(n)::BIGINT AS n_samples, count(*) AS n_groups, max(n) AS max_per_group, sum(p)::BIGINT AS n_pos, round(max(n)::DOUBLE / sum(n), 6) AS largest_share, (sum(n) - sum(p))::BIGINT AS n_neg, sum(p) >= 30 AND sum(n) - sum(p) >= 30 AND count(*) >= 10 AS feasible FROM (SELECT event_type, user_id, count(*) AS n, count(*) FILTER (value > 50) AS p FROM ep GROUP BY ALL) GROUP BY event_type")
def _(spark, d):
    return g.sample_audit(endpoints(spark, d).withColumn("y", F.col("value") > 50), ["event_type"], "user_id", "y")


@query("G12_group_use", "SELECT event_type, count(*) AS available_groups, count(*) FILTER (u) AS used_groups, round(count(*) FILTER (u)::DOUBLE / count(*), 6) AS used_share FROM (SELECT event_type, user_id, bool_or(value > 100) AS u FROM ep GROUP BY ALL) GROUP BY event_type")
def _(spark, d):
    x = endpoints(spark, d)
    return g.group_use(x, x.where("value > 100"), ["event_type"], "user_id")


@query("G13_class_weights", "SELECT event_id, round((SELECT count(*) FROM ep)::DOUBLE / (2 * (CASE WHEN label THEN (SELECT count(*) FROM ep WHERE label) ELSE (SELECT count(*) FROM ep WHERE NOT label) END)), 6) AS class_weight FROM ep")
def _(spark, d):
    return g.class_weights(endpoints(spark, d), "label").select("event_id", "class_weight")


@query("G_hash_uniform", f"SELECT event_id, {U.format(k='event_id')} AS h FROM ep")
def _(spark, d):
    return endpoints(spark, d).select("event_id", hash_integer("event_id").alias("h"))
