"""Queries of sources and row-wise operators (A, B)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as s
from ..session import shared_folder
from ..sources import tables as a
from .base import GATED, endpoints, gated, query, table


def scratch(spark, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("A1_read_tables", "SELECT source_file, count(*) AS n FROM (SELECT 'supplier.parquet' AS source_file FROM supplier) GROUP BY source_file")
def _(spark, d):
    x = a.read_tables(spark, f"{d}/supplier.parquet")
    return x.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


@query("A2_check_contract", """SELECT * FROM (
  SELECT 'value_present' AS rule_name, count(*) FILTER (NOT coalesce(value IS NOT NULL, false)) AS violations FROM ep
  UNION ALL SELECT 'value_range', count(*) FILTER (NOT coalesce(value BETWEEN 0 AND 400, false)) FROM ep
  UNION ALL SELECT 'known_type', count(*) FILTER (NOT coalesce(event_type IN ('click','view','error'), false)) FROM ep
  UNION ALL SELECT 'monotone', count(*) FILTER (NOT (value >= p OR (p IS NULL AND value IS NOT NULL))) FROM
    (SELECT value, lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM ep))""")
def _(spark, d):
    rules = {"value_present": F.col("value").isNotNull(), "value_range": F.col("value").between(0, 400), "known_type": F.col("event_type").isin("click", "view", "error")}
    return a.check_contract(endpoints(spark, d), rules, ["user_id"], ["t", "event_id"], "value")


@query("A3_aligned_join", """SELECT count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL AND a.t = b.t) AS matched, count(*) FILTER (b.t IS NULL) AS left_only,
  count(*) FILTER (a.t IS NULL) AS right_only, count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL AND a.t <> b.t) AS mismatched
  FROM (SELECT event_type, t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS r FROM ep) a
  FULL JOIN (SELECT event_type, t + CASE WHEN event_id % 100 = 0 THEN 1 ELSE 0 END AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS r FROM ep WHERE event_id % 500 <> 7) b
  ON a.event_type = b.event_type AND a.r = b.r""")
def _(spark, d):
    x = endpoints(spark, d).select("event_type", "event_id", "t")
    left = a.with_ordinal(x, "event_type", ["event_id"]).drop("event_id")
    y = x.where(F.col("event_id") % 500 != 7).withColumn("t", F.col("t") + F.when(F.col("event_id") % 100 == 0, 1).otherwise(0))
    return a.aligned_join(left, a.with_ordinal(y, "event_type", ["event_id"]).drop("event_id"), "event_type", "row_index", "t")[1]


@query("A4_write_table", "SELECT band, count(*) AS n, round(sum(value), 6) AS total FROM ep GROUP BY band")
def _(spark, d):
    path = scratch(spark, "a4")
    a.write_table(endpoints(spark, d), path, partition_by=["band"])
    return spark.read.parquet(path).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("A5_source_inventory", "SELECT event_type, count(*) AS n_rows, min(t) AS first_time, max(t) AS last_time, arg_min(user_id, t * 1000000000 + user_id) AS tool FROM ep GROUP BY event_type")
def _(spark, d):
    return a.source_inventory(endpoints(spark, d), "event_type", "t", "user_id")


@query("A6_content_fingerprint")
def _(spark, d):
    return a.content_fingerprint(table(spark, d, "events"))


PRINT = "SELECT count(*) AS n, sum(h)::VARCHAR AS s, bit_xor(h)::VARCHAR AS x FROM (SELECT ('0x' || substr(sha256({json}), 1, 15))::BIGINT AS h FROM {table})"
ORDER_JSON = """'{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}'"""
NATION_JSON = """'{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}'"""


@query("A6_key_fingerprint", f", f AS ({PRINT.format(json=ORDER_JSON, table='orders')}) SELECT n AS n_rows, s AS hash_sum, x AS hash_xor FROM f")
def _(spark, d):
    x = a.content_fingerprint(table(spark, d, "orders"), ["o_orderkey", "o_custkey"])
    return x.select("n_rows", F.col("hash_sum").cast("string").alias("hash_sum"), F.col("hash_xor").cast("string").alias("hash_xor"))


@query("A6_run_signature", f""", n AS ({PRINT.format(json=NATION_JSON, table='nation')}), o AS ({PRINT.format(json=ORDER_JSON, table='orders')})
SELECT sha256('{{"cut":0.5,"seed":42}}' || chr(10) || 'nation|' || n.n || '|' || n.s || '|' || n.x || chr(10) || 'orders|' || o.n || '|' || o.s || '|' || o.x) AS signature FROM n, o""")
def _(spark, d):
    inputs = {"orders": table(spark, d, "orders"), "nation": table(spark, d, "nation")}
    return a.run_signature(inputs, {"seed": 42, "cut": 0.5}, {"orders": ["o_orderkey", "o_custkey"], "nation": ["n_nationkey", "n_name"]})


@query("A7_coverage_check", """SELECT o_custkey, side FROM (
  SELECT c_custkey AS o_custkey, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT DISTINCT o_custkey, 'unexpected' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))""")
def _(spark, d):
    return a.coverage_check(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), table(spark, d, "orders"), ["o_custkey"])


@query("A7_coverage_gaps", """, e AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000)
 SELECT coalesce(e.k, o.k) AS o_custkey, CASE WHEN o.k IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM e FULL JOIN o ON e.k = o.k WHERE e.k IS NULL OR o.k IS NULL""")
def _(spark, d):
    """Customers in credit without a large order, and large orders of other customers."""
    expected = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return a.coverage_check(expected, table(spark, d, "orders").where("o_totalprice > 200000"), ["o_custkey"])


@query("A8_reconcile", """, m AS (SELECT user_id, count(*)::DOUBLE AS n, avg(value) AS mean FROM ep GROUP BY user_id)
SELECT user_id, metric, round(saved, 6) AS saved, round(recomputed, 6) AS recomputed, CASE WHEN abs(saved - recomputed) <= 1e-9 THEN 'PASS' ELSE 'FAIL' END AS result FROM (
  SELECT user_id, 'n' AS metric, n AS saved, n AS recomputed FROM m
  UNION ALL SELECT user_id, 'mean', mean, mean + CASE WHEN user_id % 10 = 0 THEN 0.5 ELSE 0 END FROM m)""")
def _(spark, d):
    m = endpoints(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    off = m.withColumn("mean", F.col("mean") + F.when(F.col("user_id") % 10 == 0, 0.5).otherwise(0.0))
    return a.reconcile(m, off, ["user_id"], ["n", "mean"])


@query("B1_to_numeric", "SELECT event_id, try_cast(x AS DOUBLE) AS x FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE regexp_extract(props, '[0-9]+') END AS x FROM events)")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.regexp_extract("props", "[0-9]+", 0)).alias("x"))
    return s.to_numeric(e, ["x"])


@query("B2_null_nonfinite", "SELECT event_id, CASE WHEN event_id % 5 < 2 THEN NULL ELSE value END AS value FROM ep")
def _(spark, d):
    odd = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return s.null_nonfinite(endpoints(spark, d).select("event_id", odd.alias("value")), ["value"])


@query("B3_complete_cases", "SELECT count(*) AS before, count(*) FILTER (NOT ok) AS removed, count(*) FILTER (ok) AS after FROM (SELECT event_id % 7 <> 0 AND event_type IN ('click', 'view', 'error') AS ok FROM ep)")
def _(spark, d):
    x = endpoints(spark, d).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return s.complete_cases(x, ["value"], {"event_type": ["click", "view", "error"]})[1]


@query("B4_missing_profile", "SELECT 'x' AS column_name, count(*) - count(x) AS missing, count(x) AS present FROM (SELECT CASE WHEN event_id % 4 <> 0 THEN value END AS x FROM ep) UNION ALL SELECT 'event_type', count(*) - count(event_type), count(event_type) FROM ep")
def _(spark, d):
    return s.missing_profile(endpoints(spark, d).select(F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("x"), "event_type"), ["x", "event_type"])


@query("B4_value_counts", "SELECT kind AS value, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 <> 0 THEN event_type END AS kind FROM ep) GROUP BY kind")
def _(spark, d):
    return s.value_counts(endpoints(spark, d).withColumn("kind", F.when(F.col("event_id") % 4 != 0, F.col("event_type"))), "kind")


@query("B5_one_hot", "SELECT event_id, event_type, (event_type = 'error')::INT AS event_type_error, (event_type = 'view')::INT AS event_type_view FROM ep")
def _(spark, d):
    return s.one_hot(endpoints(spark, d).select("event_id", "event_type"), "event_type", ["error", "view"], strict=False)


@query("B6_band", "SELECT band, count(*) AS n, min(value) AS low, max(value) AS high FROM ep GROUP BY band")
def _(spark, d):
    return endpoints(spark, d).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("B7_gate", GATED + "SELECT event_id, forecast_alarm, gated_alarm, rescue, CASE WHEN prob >= 0.5 THEN value END AS gated_value, CASE WHEN gated_alarm THEN 'tier1' WHEN rescue THEN 'rescue' END AS tier FROM g")
def _(spark, d):
    return gated(spark, d).select("event_id", "forecast_alarm", "gated_alarm", "rescue", "gated_value", "tier")


@query("B8_stable_id", "SELECT event_id, substr(sha256('salt|' || user_id || '|' || event_id), 1, 16) AS opaque FROM ep")
def _(spark, d):
    return endpoints(spark, d).select("event_id", s.stable_id("user_id", "event_id", salt="salt").alias("opaque"))


@query("B9_name_parts", "SELECT DISTINCT 'sensor ' || event_type AS sensor, 'rms' AS stat, '  Sensor   ' || upper(event_type) || '__rms ' AS raw FROM events")
def _(spark, d):
    x = table(spark, d, "events").select(F.concat(F.lit("  Sensor   "), F.upper("event_type"), F.lit("__rms ")).alias("raw")).distinct()
    return s.name_parts(x.withColumn("n", s.normal_name("raw")), "n").select("sensor", "stat", "raw")


@query("B10_canonical_json")
def _(spark, d):
    x = endpoints(spark, d).select("event_id", "user_id", "event_type", "value", "prob")
    return x.select("event_id", s.canonical_json(["value", "prob", "event_type"], x).alias("body"), s.request_key(["value", "prob", "event_type"], x).alias("request_sha256"))


@query("B11_build_packet", """SELECT event_id, v AS value, p AS prob, array_to_string(list_filter([CASE WHEN v IS NULL THEN 'v' END, CASE WHEN p IS NULL THEN 'p' END], lambda x: x IS NOT NULL), ',') AS issues,
  CASE WHEN v IS NULL OR p IS NULL THEN 'DATA_REVIEW' ELSE 'READY' END AS status FROM (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN value END AS v, CASE WHEN event_id % 4 <> 0 THEN prob END AS p FROM ep)""")
def _(spark, d):
    x = endpoints(spark, d).select("event_id", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 4 != 0, F.col("prob")).alias("p"))
    return s.build_packet(x, ["v", "p"]).select("event_id", F.col("packet.fields.v").alias("value"), F.col("packet.fields.p").alias("prob"), F.array_join("issues", ",").alias("issues"), "status")


@query("B12_leak_scan", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'sequence_id' ELSE '' END AS leaked, event_id % 3 <> 0 AS clean FROM ep")
def _(spark, d):
    x = endpoints(spark, d).withColumn("body", F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.struct(F.col("user_id").alias("sequence_id")).alias("fields")))).otherwise(F.to_json(F.struct(F.struct(F.col("value").alias("rms")).alias("fields")))))
    return s.leak_scan(x, "body", ["sequence", "label"]).select("event_id", F.array_join("leaked", ",").alias("leaked"), "clean")


@query("B13_parse_score_response", """SELECT event_id, CASE WHEN ok THEN 'READY' ELSE 'MODEL_UNAVAILABLE' END AS status, CASE WHEN ok THEN round(2 * prob, 6) END AS score, CASE WHEN ok THEN round(prob, 6) END AS half_score,
  CASE WHEN ok THEN CASE WHEN prob <= 0.5 THEN 0 ELSE 2 END END AS state FROM (SELECT event_id, prob, event_id % 4 <> 0 AS ok FROM ep)""")
def _(spark, d):
    p = F.col("prob")
    good = F.to_json(F.struct(F.lit("judge-1").alias("model"), (2 * p).alias("score"), F.create_map(F.lit("0"), 1 - p, F.lit("1"), F.lit(0.0), F.lit("2"), p).alias("probabilities")))
    bad = F.to_json(F.struct(F.lit("judge-1").alias("model"), (2 * p).alias("score"), F.create_map(F.lit("0"), F.lit(0.2), F.lit("1"), F.lit(0.2), F.lit("2"), F.lit(0.1)).alias("probabilities")))
    x = endpoints(spark, d).withColumn("body", F.when(F.col("event_id") % 4 != 0, good).when(F.col("event_id") % 8 == 0, bad).otherwise(F.lit("{no json")))
    return s.parse_score_response(x, "body", "judge-").select("event_id", "status", "score", "half_score", "state")


@query("B13_provider_and_legend", """SELECT event_id, CASE WHEN ok THEN 'READY' ELSE 'MODEL_UNAVAILABLE' END AS status, CASE WHEN ok THEN round(2 * prob, 6) END AS score FROM (SELECT event_id, prob, event_type <> 'error' AND value <= 60 AS ok FROM ep)""")
def _(spark, d):
    p, legend = F.col("prob"), ["no sign", "some signs", "clear signs"]
    provider = F.when(F.col("event_type") == "error", "elsewhere").otherwise("provider-7")
    last = F.when(F.col("value") <= 60, legend[2]).otherwise("another question")
    probabilities = F.create_map(F.lit("0"), 1 - p, F.lit("1"), F.lit(0.0), F.lit("2"), p)
    asked = F.create_map(F.lit("0"), F.lit(legend[0]), F.lit("1"), F.lit(legend[1]), F.lit("2"), last)
    body = F.to_json(F.struct(F.lit("judge-1").alias("model"), provider.alias("provider"), (2 * p).alias("score"), probabilities.alias("probabilities"), asked.alias("legend")))
    return s.parse_score_response(endpoints(spark, d).withColumn("body", body), "body", "judge-", "provider-", legend).select("event_id", "status", "score")


@query("B14_parse_judge_output", "SELECT event_id, event_id % 3 = 0 AS valid, CASE WHEN event_id % 3 <> 2 THEN round(100 * prob, 6) END AS priority FROM ep")
def _(spark, d):
    ev = F.array(F.struct(F.when(F.col("event_id") % 3 == 1, F.lit("secret")).otherwise(F.lit("rms")).alias("field"), F.col("value").alias("value"), F.lit("high").alias("claim")))
    none = F.array().cast("array<string>")
    good = F.to_json(F.struct(ev.alias("evidence_for"), ev.alias("evidence_against"), none.alias("unknowns"), none.alias("additional_checks"), (100 * F.col("prob")).alias("priority_score"), F.lit("REVIEW").alias("review_recommendation")))
    x = endpoints(spark, d).withColumn("body", F.when(F.col("event_id") % 3 != 2, good).otherwise(F.lit('{"evidence_for": []}')))
    return s.parse_judge_output(x, "body", ["rms"], ["REVIEW", "SKIP"]).select("event_id", "valid", F.col("judged.priority_score").alias("priority"))


@query("B15_apply_scale", ", m AS (SELECT event_type, median(value) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM ep GROUP BY event_type) SELECT event_id, round((value - med) / CASE WHEN iqr > 1e-12 THEN iqr ELSE 1 END, 6) AS scaled FROM ep JOIN m USING (event_type)")
def _(spark, d):
    x = endpoints(spark, d)
    q = lambda p: F.percentile("value", F.lit(p))
    stats = x.groupBy("event_type").agg(q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"))
    return s.apply_scale(x, stats, ["event_type"], "value").select("event_id", "scaled")


@query("B16_perturb_arms", "SELECT event_id, arm, round(value * arm, 6) AS value, round(prob, 6) AS prob FROM ep, (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS arm)")
def _(spark, d):
    return s.perturb_arms(endpoints(spark, d), "value", [0.5, 1, 2]).select("event_id", "arm", "value", "prob")


@query("B17_score_linear", "SELECT event_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.25::DOUBLE + (value - 40.0::DOUBLE) / 35.0::DOUBLE * -0.7::DOUBLE + (prob - 0.5::DOUBLE) / 0.3::DOUBLE * 1.5::DOUBLE))), 6) AS score FROM ep")
def _(spark, d):
    return s.score_linear(endpoints(spark, d), {"value": (40, 35, -0.7), "prob": (0.5, 0.3, 1.5)}, 0.25).select("event_id", "score")
