"""Queries of joins and set operations (C, K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as c
from ..operators import sets as k
from .base import endpoints, query, table


@query("C1_checked_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return c.checked_join(o, table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], all_matched=True).select("o_orderkey", "c_name")


@query("C2_keep_ids", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    ids = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.keep_ids(table(spark, d, "customer").select("c_custkey"), ids, ["c_custkey"])


@query("C2_drop_ids", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    ids = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.drop_ids(table(spark, d, "customer").select("c_custkey"), ids, ["c_custkey"])


@query("C3_asof_next", "SELECT a.event_id, b.t AS next_t FROM (SELECT * FROM ep WHERE NOT label) a ASOF LEFT JOIN (SELECT DISTINCT user_id, t FROM ep WHERE label) b ON a.user_id = b.user_id AND b.t >= a.t")
def _(spark, d):
    x = endpoints(spark, d).select("event_id", "user_id", "t", "label")
    return c.asof_next(x.where("label").select("user_id", "t"), x.where("not label").drop("label"), ["user_id"], "t").select("event_id", "next_t")


@query("C4_asof_prev", "SELECT a.event_id, b.t AS prev_t, a.t - b.t AS lag, a.t = b.t AS exact_hit FROM (SELECT * FROM ep WHERE label) a ASOF LEFT JOIN (SELECT DISTINCT user_id, t FROM ep WHERE NOT label) b ON a.user_id = b.user_id AND b.t <= a.t")
def _(spark, d):
    x = endpoints(spark, d).select("event_id", "user_id", "t", "label")
    return c.asof_prev(x.where("label").drop("label"), x.where("not label").select("user_id", "t"), ["user_id"], "t").select("event_id", "prev_t", "lag", "exact_hit")


@query("C5_window_extract", """, r AS (SELECT event_id, user_id, label, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS ord FROM ep),
  i AS (SELECT user_id, event_id AS interval_id, greatest(ord - 5, 0) AS a, ord AS b FROM r WHERE label) SELECT r.event_id, interval_id FROM r JOIN i ON r.user_id = i.user_id AND r.ord BETWEEN a AND b""")
def _(spark, d):
    x = endpoints(spark, d).withColumn("ord", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1)
    i = x.where("label").select("user_id", F.col("event_id").alias("interval_id"), F.greatest(F.col("ord") - 5, F.lit(0)).alias("start"), F.col("ord").alias("end"))
    return c.window_extract(x.select("event_id", "user_id", "ord"), i, ["user_id"], "ord", width=16).select("event_id", "interval_id")


@query("C6_cohort_overlap", """SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)) AS shared_rows,
  (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)) AS shared_groups""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return c.cohort_overlap(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), ["o_orderkey"], ["o_custkey"])


@query("C6_exclude_seen", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return c.exclude_seen(o, o.where("o_orderkey % 3 = 0"), ["o_orderkey"])


@query("C7_ordered_pairs", ", x AS (SELECT DISTINCT prob AS t FROM ep) SELECT a.t AS t1, b.t AS t2 FROM x a JOIN x b ON a.t < b.t")
def _(spark, d):
    return c.ordered_pairs(endpoints(spark, d), "prob")


@query("C8_label_consistency", """, x AS (SELECT a.user_id, a.t, b.t - a.t AS want, CASE WHEN a.event_id % 50 = 0 THEN 1 ELSE b.t - a.t END AS lab FROM (SELECT * FROM ep WHERE NOT label) a ASOF LEFT JOIN (SELECT DISTINCT user_id, t FROM ep WHERE label) b ON a.user_id = b.user_id AND b.t >= a.t)
SELECT count(*) FILTER (lab IS NOT DISTINCT FROM want) AS matched, count(*) FILTER (lab IS DISTINCT FROM want) AS mismatched FROM x""")
def _(spark, d):
    x = endpoints(spark, d).select("event_id", "user_id", "t", "label")
    events = x.where("label").select("user_id", "t")
    rows = c.asof_next(events, x.where("not label").drop("label"), ["user_id"], "t")
    rows = rows.withColumn("lab", F.when(F.col("event_id") % 50 == 0, F.lit(1)).otherwise(F.col("next_t") - F.col("t"))).drop("next_t")
    return c.label_consistency(rows, events, ["user_id"], "t", "lab").drop("examples")


@query("C9_cache_plan", """, r AS (SELECT sha256(event_type || '|' || prob::VARCHAR) AS k, min(event_id) AS event_id FROM ep GROUP BY 1) SELECT event_id FROM r WHERE k NOT IN (SELECT sha256(event_type || '|' || prob::VARCHAR) FROM ep WHERE event_id % 20 = 0) ORDER BY event_id LIMIT 100""")
def _(spark, d):
    x = endpoints(spark, d).withColumn("k", F.concat_ws("|", "event_type", F.col("prob").cast("string")))
    return c.cache_plan(x.select("event_id", "k"), x.where("event_id % 20 = 0").select("k"), "k", ["event_id"], 100).select("event_id")


@query("K1_stack", "SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS total FROM customer UNION ALL SELECT o_orderkey, NULL, round(o_totalprice, 6)::DOUBLE FROM orders")
def _(spark, d):
    return k.stack(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("total")))


@query("K2_distinct_rows", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM ep) WHERE n = 1")
def _(spark, d):
    return k.distinct_rows(endpoints(spark, d).select("user_id", "event_id", "t"), ["user_id"], ["t", "event_id"]).select("user_id", "event_id")


@query("K3_set_algebra", """SELECT coalesce(a.u, b.u) AS user_id, CASE WHEN a.u IS NOT NULL AND b.u IS NOT NULL THEN 'both' WHEN a.u IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS part
  FROM (SELECT DISTINCT user_id AS u FROM ep WHERE value > 300) a FULL JOIN (SELECT DISTINCT user_id AS u FROM ep WHERE value < 0.5) b ON a.u = b.u""")
def _(spark, d):
    x = endpoints(spark, d).select("user_id", "value")
    return k.set_algebra(x.where("value > 300"), x.where("value < 0.5"), ["user_id"])


@query("K3_is_partition", "SELECT 0::BIGINT AS overlapping, 0::BIGINT AS missing, 0::BIGINT AS \"foreign\"")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return k.is_partition([o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")], o, ["o_orderkey"])
