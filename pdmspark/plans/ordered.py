"""Queries of sequences and windows (D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequence as q
from .base import GATED, endpoints, gated, query, table

BY, ORDER = ["user_id"], ["t", "event_id"]
W = "PARTITION BY user_id ORDER BY t, event_id"
SENSORS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("D1_segment_runs", f"SELECT event_id, (sum(c) OVER ({W}))::BIGINT AS segment FROM (SELECT *, CASE WHEN row_number() OVER ({W}) = 1 OR event_type IS NOT DISTINCT FROM lag(event_type) OVER ({W}) THEN 0 ELSE 1 END AS c FROM ep)")
def _(spark, d):
    return q.segment_runs(endpoints(spark, d), BY, ORDER, ["event_type"]).select("event_id", "segment")


@query("D2_gap_profile", f"SELECT user_id, count(s) AS n_steps, count(*) FILTER (s < 0) AS negative, count(*) FILTER (s = 0) AS zero, count(*) FILTER (s = 60) AS nominal, count(*) FILTER (s > 3600) AS above_3600, count(*) FILTER (s > 86400) AS above_86400, count(*) FILTER (s < 0) = 0 AS monotone FROM (SELECT user_id, t - lag(t) OVER ({W}) AS s FROM ep) GROUP BY user_id")
def _(spark, d):
    return q.gap_profile(endpoints(spark, d), BY, ORDER, "t", 60, [3600, 86400])


@query("D3_split_on_gap", f"SELECT event_id, (sum(g) OVER ({W}))::BIGINT AS part FROM (SELECT *, coalesce((t - lag(t) OVER ({W}) > 43200)::INT, 0) AS g FROM ep)")
def _(spark, d):
    return q.split_on_gap(endpoints(spark, d), BY, ORDER, "t", 43200).select("event_id", "part")


@query("D3_after_last_gap", f", p AS (SELECT event_id, user_id, sum(g) OVER ({W}) AS part FROM (SELECT *, coalesce((t - lag(t) OVER ({W}) > 43200)::INT, 0) AS g FROM ep)) SELECT event_id FROM (SELECT *, max(part) OVER (PARTITION BY user_id) AS m FROM p) WHERE part = m")
def _(spark, d):
    return q.split_on_gap(endpoints(spark, d), BY, ORDER, "t", 43200, last_only=True).select("event_id")


@query("D4_run_to_event", f""", r AS (SELECT *, row_number() OVER ({W}) - 1 AS r, t - lag(t) OVER ({W}) AS s FROM ep),
  m AS (SELECT *, coalesce(max(CASE WHEN label THEN r + 1 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p,
    coalesce(max(CASE WHEN s > 43200 THEN r END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g0, coalesce(max(CASE WHEN s > 86400 THEN r END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g1 FROM r)
  SELECT user_id, t, r AS event_row, gap AS gap_seconds, st AS start_row, r - st + 1 AS length, r - st + 1 > 3 AS candidate FROM (
    SELECT user_id, t, r, 43200.0::DOUBLE AS gap, greatest(p, g0) AS st FROM m WHERE label UNION ALL SELECT user_id, t, r, 86400.0::DOUBLE, greatest(p, g1) FROM m WHERE label)""")
def _(spark, d):
    return q.run_to_event(endpoints(spark, d), F.col("label"), BY, ORDER, "t", [43200, 86400], 3)


@query("D5_count_windows", f""", r AS (SELECT event_id, user_id, value, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ep)
SELECT user_id, w AS window_index, count(*) AS n_rows, min(event_id) AS low_id, arg_max(event_id, i) AS last_id FROM (SELECT *, unnest(range(0, ((n - 20) // 10 + 1)::BIGINT)) AS w FROM r WHERE n >= 20) WHERE i BETWEEN w * 10 AND w * 10 + 19 GROUP BY ALL""")
def _(spark, d):
    x = q.count_windows(endpoints(spark, d), BY, ORDER, 20, 10)
    return x.groupBy("user_id", "window_index").agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("low_id"), F.max_by("event_id", "row_in_window").alias("last_id"))


def _moments(c: str) -> str:
    m = f"(avg({c}::DOUBLE))"
    third = f"(avg({c}::DOUBLE ** 3) - 3 * {m} * avg({c}::DOUBLE ** 2) + 2 * {m} ** 3)"
    return ", ".join(
        f"round({e}, 6) AS {c}__{n}"
        for n, e in {
            "mean": m, "std": f"stddev_pop({c}::DOUBLE)", "peak_abs": f"max(abs({c}::DOUBLE))", "rms": f"sqrt(avg({c}::DOUBLE * {c}::DOUBLE))", "kurtosis": f"kurtosis_pop({c}::DOUBLE)",
            "skewness": f"({third} / stddev_pop({c}::DOUBLE) ** 3)", "crest": f"max(abs({c}::DOUBLE)) / sqrt(avg({c}::DOUBLE * {c}::DOUBLE))", "shape": f"sqrt(avg({c}::DOUBLE * {c}::DOUBLE)) / avg(abs({c}::DOUBLE))",
        }.items()
    )


@query("D6_window_stats", f""", r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, w AS window_index, {_moments('l_quantity')}, {_moments('l_discount')} FROM (SELECT *, unnest(range(0, ((n - 100) // 50 + 1)::BIGINT)) AS w FROM r WHERE n >= 100) WHERE i BETWEEN w * 50 AND w * 50 + 99 GROUP BY l_suppkey, w""")
def _(spark, d):
    x = q.count_windows(table(spark, d, "lineitem"), ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 100, 50)
    return q.window_stats(x, ["l_suppkey", "window_index"], ["l_quantity", "l_discount"], 100)


@query("D7_trailing_stats", f"SELECT event_id, CASE WHEN n = 5 THEN round(rms, 6) END AS value__rms, CASE WHEN n = 5 THEN round(pk, 6) END AS value__peak_abs, CASE WHEN n = 5 THEN round(rms / ma, 6) END AS value__shape FROM (SELECT event_id, count(value) OVER w AS n, sqrt(avg(value * value) OVER w) AS rms, max(abs(value)) OVER w AS pk, avg(abs(value)) OVER w AS ma FROM ep WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))")
def _(spark, d):
    return q.trailing_stats(endpoints(spark, d), BY, ORDER, 5, ["value"]).select("event_id", "value__rms", "value__peak_abs", "value__shape")


@query("D7_slab_stats", f"SELECT event_id, CASE WHEN n = 5 THEN round(rms, 6) END AS value__rms, CASE WHEN n = 5 THEN round(pk, 6) END AS value__peak_abs FROM (SELECT event_id, count(value) OVER w AS n, sqrt(avg(value * value) OVER w) AS rms, max(abs(value)) OVER w AS pk FROM ep WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))")
def _(spark, d):
    x = endpoints(spark, d).withColumn("ordinal", F.row_number().over(Window.partitionBy(*BY).orderBy(*ORDER)) - 1)
    return q.slab_stats(x, BY, "ordinal", 5, ["value"], 16).select("event_id", "value__rms", "value__peak_abs")


@query("D8_trailing_delta", f"SELECT event_id, CASE WHEN n = 5 THEN round(value - f, 6) END AS value__delta, CASE WHEN n = 5 THEN round(s, 6) END AS value__std, n AS history_count FROM (SELECT event_id, value, count(value) OVER w AS n, first(value) OVER w AS f, stddev_pop(value) OVER w AS s FROM ep WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))")
def _(spark, d):
    return q.trailing_delta(endpoints(spark, d), BY, ORDER, "value", 5).select("event_id", "value__delta", "value__std", "history_count")


@query("D5_window_ends", f""", r AS (SELECT event_id, user_id, t, event_type, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ep)
SELECT user_id, w AS window_index, t AS last_t, event_type AS last_event_type FROM (SELECT *, unnest(range(0, ((n - 20) // 10 + 1)::BIGINT)) AS w FROM r WHERE n >= 20) WHERE i = w * 10 + 19""")
def _(spark, d):
    return q.window_ends(q.count_windows(endpoints(spark, d), BY, ORDER, 20, 10), ["user_id", "window_index"], ["t", "event_type"])


@query("D5_segment_lengths", "SELECT count(*) AS n_segments, count(*) FILTER (n < 60) AS n_short, coalesce(sum(n) FILTER (n < 60), 0)::BIGINT AS rows_in_short FROM (SELECT user_id, count(*) AS n FROM ep GROUP BY user_id)")
def _(spark, d):
    return q.segment_lengths(endpoints(spark, d), BY, 60)


@query("D9_elapsed_stats", """, b AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS s FROM ep),
 m AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS sd FROM b WHERE t - s <= 500000 GROUP BY user_id)
SELECT event_id, ok AS sufficient, CASE WHEN ok THEN round((a - m) / sd, 6) END AS value__z_200000, CASE WHEN ok THEN round(p / sd, 6) END AS value__std_ratio_200000
FROM (SELECT *, coalesce(t - s >= 300000 AND sd > 0 AND n >= 2, false) AS ok FROM (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS a, stddev_pop(value) OVER w AS p FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 200000 PRECEDING AND CURRENT ROW)) JOIN m USING (user_id))""")
def _(spark, d):
    x = q.elapsed_stats(endpoints(spark, d), BY, "t", ["value"], [200000], 500000, 300000)
    return x.select("event_id", "sufficient", "value__z_200000", "value__std_ratio_200000")


@query("D9_elapsed_slope", """, b AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS s FROM ep),
 m AS (SELECT user_id, stddev_pop(value) AS sd FROM b WHERE t - s <= 500000 GROUP BY user_id)
SELECT event_id, CASE WHEN t - s >= 300000 AND sd <> 0 AND vx > 0 THEN round(sl * 1000 / sd, 4) + 0.0 END AS slope
FROM (SELECT *, regr_slope(value, (t - s)::DOUBLE) OVER w AS sl, var_pop((t - s)::DOUBLE) OVER w AS vx FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 200000 PRECEDING AND CURRENT ROW)) JOIN m USING (user_id)""")
def _(spark, d):
    x = q.elapsed_stats(endpoints(spark, d), BY, "t", ["value"], [200000], 500000, 300000)
    return x.select("event_id", (F.round("value__slope_200000", 4) + F.lit(0.0)).alias("slope"))


@query("D10_endpoints", f"SELECT event_id FROM (SELECT event_id, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ep) WHERE i % 15 = 0 OR i = n - 1")
def _(spark, d):
    return q.endpoints(endpoints(spark, d), BY, ORDER, 15).select("event_id")


@query("D11_backward_sample", f""", r AS (SELECT event_id, user_id, label, row_number() OVER ({W}) - 1 AS ord FROM ep)
SELECT e.user_id, e.ord AS endpoint, o AS "offset", (3 - j)::INT AS slot, r.event_id FROM r e, (SELECT unnest([0, 1]) AS o), (SELECT unnest(range(4)) AS j), r WHERE e.label AND r.user_id = e.user_id AND r.ord = e.ord - o - 3 * j""")
def _(spark, d):
    x = endpoints(spark, d).withColumn("ord", (F.row_number().over(Window.partitionBy(*BY).orderBy(*ORDER)) - 1).cast("long"))
    return q.backward_sample(x.select("user_id", "ord", "event_id"), x.where("label").select("user_id", "ord"), BY, "ord", 4, 3, [0, 1]).select("user_id", "endpoint", "offset", "slot", "event_id")


@query("D11_padded_arrays", f""", r AS (SELECT event_id, user_id, label, row_number() OVER ({W}) - 1 AS ord, value FROM ep),
 s AS (SELECT e.user_id, e.ord AS endpoint, j, r.value FROM r e CROSS JOIN (SELECT unnest(range(4)) AS j) LEFT JOIN r ON r.user_id = e.user_id AND r.ord = e.ord - 3 * j WHERE e.label)
SELECT user_id, endpoint, 0 AS "offset", string_agg(coalesce(round(value, 2)::VARCHAR, '-'), ' ' ORDER BY j DESC) AS shown, count(value) AS n_real FROM s GROUP BY user_id, endpoint""")
def _(spark, d):
    x = endpoints(spark, d).withColumn("ord", (F.row_number().over(Window.partitionBy(*BY).orderBy(*ORDER)) - 1).cast("long"))
    a = q.padded_arrays(q.backward_sample(x.select("user_id", "ord", "value"), x.where("label").select("user_id", "ord"), BY, "ord", 4, 3), BY, "value", 4)
    shown = F.array_join(F.transform("values", lambda v: F.coalesce(F.round(v, 2).cast("string"), F.lit("-"))), " ")
    return a.select("user_id", "endpoint", "offset", shown.alias("shown"), F.size(F.filter("mask", lambda k: k)).cast("long").alias("n_real"))


@query("D12_rows_to_end", f"SELECT event_id, n - i AS rows_to_end, (n - i) * 4.0::DOUBLE AS sample_rul_seconds FROM (SELECT event_id, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ep)")
def _(spark, d):
    return q.rows_to_end(endpoints(spark, d), BY, ORDER).select("event_id", "rows_to_end", "sample_rul_seconds")


@query("D13_interval_audit", "SELECT user_id, count(*) AS n_rows, round(quantile_cont(s, 0.5), 6) AS median_step, round(quantile_cont(s, 0.9), 6) AS p90_step, round(count(*) FILTER (s = 60)::DOUBLE / count(s), 6) AS nominal_share, (max(t) - max(t))::BIGINT AS end_lag FROM (SELECT user_id, t, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t))::DOUBLE AS s FROM ep) GROUP BY user_id")
def _(spark, d):
    return q.interval_audit(endpoints(spark, d), BY, "t", 60, F.col("t"))


@query("D14_first_alarm", GATED + f"SELECT user_id, event_id, t FROM (SELECT *, row_number() OVER ({W}) AS n FROM g WHERE gated_alarm) WHERE n = 1")
def _(spark, d):
    return q.first_alarm(gated(spark, d), BY, ORDER, "gated_alarm").select("user_id", "event_id", "t")


@query("D14_lead_time", GATED + "SELECT user_id, round(max(CASE WHEN gated_alarm AND value <= 15 THEN value END), 6) AS lead FROM g GROUP BY user_id")
def _(spark, d):
    return q.lead_time(gated(spark, d), BY, "value", "gated_alarm", 15)


DETECTED = GATED + """, ev AS (SELECT user_id, bool_or(label AND gated_alarm) AS gated_alarm_detected, max(CASE WHEN label AND gated_alarm THEN value END) AS gated_alarm_lead,
  bool_or(label AND forecast_alarm) AS forecast_alarm_detected, max(CASE WHEN label AND forecast_alarm THEN value END) AS forecast_alarm_lead FROM g GROUP BY user_id HAVING bool_or(label)) """


@query("D15_event_detection", DETECTED + "SELECT *, NOT gated_alarm_detected AND forecast_alarm_detected AS forecast_alarm_only FROM ev")
def _(spark, d):
    return q.event_detection(gated(spark, d), BY, "label", "value", ["gated_alarm", "forecast_alarm"])


@query("D15_detection_summary", DETECTED + """SELECT method, count(*) AS n_events, count(*) FILTER (det) AS detected, round(quantile_cont(lead, 0.25), 6) AS lead_q1, round(quantile_cont(lead, 0.5), 6) AS lead_median, round(quantile_cont(lead, 0.75), 6) AS lead_q3
  FROM (SELECT 'gated_alarm' AS method, gated_alarm_detected AS det, gated_alarm_lead AS lead FROM ev UNION ALL SELECT 'forecast_alarm', forecast_alarm_detected, forecast_alarm_lead FROM ev) GROUP BY method""")
def _(spark, d):
    flags = ["gated_alarm", "forecast_alarm"]
    return q.detection_summary(q.event_detection(gated(spark, d), BY, "label", "value", flags), flags)


@query("D16_position_leakage", f"SELECT ((i * 10) // n)::INT AS position_bin, count(*) AS n_rows, round(avg(label::INT::DOUBLE), 6) AS positive_rate FROM (SELECT label, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ep) GROUP BY 1")
def _(spark, d):
    return q.position_leakage(endpoints(spark, d).withColumn("label", F.col("label").cast("int")), BY, ORDER, "label")


@query("D16_position_error", "SELECT 0.0::DOUBLE AS max_error")
def _(spark, d):
    x = q.rows_to_end(endpoints(spark, d), BY, ORDER).withColumnRenamed("sample_rul_seconds", "target").drop("rows_to_end")
    return q.position_error(x, BY, ORDER, "target", 4.0)


@query("D16_position_error_value", f"SELECT round(max(abs(value - (n - i) * 4.0::DOUBLE)), 6) AS max_error FROM (SELECT value, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ep)")
def _(spark, d):
    """A target that is not position."""
    return q.position_error(endpoints(spark, d), BY, ORDER, "value", 4.0)


@query("D17_budget_guard", "SELECT o_orderkey, round(spent, 6) AS spent, spent <= 100000 AS accepted FROM (SELECT o_orderkey, sum(CASE WHEN o_orderkey % 4 = 0 THEN 7.5::DOUBLE ELSE 10.25::DOUBLE END) OVER (ORDER BY o_orderdate, o_orderkey) AS spent FROM orders)")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("cost", F.when(F.col("o_orderkey") % 4 == 0, F.lit(7.5)))
    return q.budget_guard(o.select("o_orderkey", "o_orderdate", "cost"), ["o_orderdate", "o_orderkey"], "cost", 10.25, 100000).select("o_orderkey", "spent", "accepted")
