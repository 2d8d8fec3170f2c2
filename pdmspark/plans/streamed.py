"""Queries of streams (J): each runs over the events' files and must equal the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as j
from .base import GATED, endpoints, query, table
from .ordered import W
from .ranked import UD
from .tables import scratch

EVENTS = "events.parquet"


def stream(spark, d):
    """The events as a stream of files, with the columns of ``endpoints`` and ``ts`` as a timestamp."""
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", EVENTS).parquet(d)
    t = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    prob = F.regexp_extract("props", "[0-9]+", 0).cast("double") / 100
    return raw.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), t.alias("t"), prob.alias("prob"), (F.col("event_type") == "error").alias("label"))


def run(spark, df, name, to_table=j.run_to_table):
    key = "spark.sql.streaming.stateStore.providerClass"
    before, parts = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, j.ROCKSDB)
    try:
        return to_table(df, scratch(spark, f"{name}-out"), scratch(spark, f"{name}-checkpoint"))
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


@query("J1_stream_count_windows", f""", s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM ep), sg AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM (SELECT *, CASE WHEN o = 1 OR (event_id // 5000) = lag(event_id // 5000) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM s)),
 r AS (SELECT user_id, segment, value, row_number() OVER (PARTITION BY user_id, segment ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, segment) AS n FROM sg)
SELECT user_id::VARCHAR AS group_key, segment::BIGINT AS segment, w AS window_index, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(max(abs(value)), 6) AS peak_abs, round(sqrt(avg(value * value)), 6) AS rms FROM (SELECT *, unnest(range(0, ((n - 10) // 5 + 1)::BIGINT)) AS w FROM r WHERE n >= 10) WHERE i BETWEEN w * 5 AND w * 5 + 9 GROUP BY user_id, segment, w""")
def _(spark, d):
    x = stream(spark, d).withColumn("run_key", F.floor(F.col("event_id") / 5000))
    return run(spark, j.stream_count_windows(x, "user_id", "event_id", "run_key", "value", 10, 5), "j1")


TIMED = """, o AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, lag(event_id // 5000) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM ep)"""


@query("J1_stream_ending_windows", TIMED + """, sg AS (SELECT *, sum(CASE WHEN event_id // 5000 = k AND t - top <= 43200 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM o),
 r AS (SELECT user_id, segment, value, min(event_id) OVER (PARTITION BY user_id, segment) AS run_start, row_number() OVER (PARTITION BY user_id, segment ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, segment) AS n FROM sg)
SELECT user_id::VARCHAR AS group_key, run_start, w AS window_index, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(max(abs(value)), 6) AS peak_abs, round(sqrt(avg(value * value)), 6) AS rms, NULL::BIGINT AS late_row FROM (SELECT *, unnest(range(0, ((n - 3) // 2 + 1)::BIGINT)) AS w FROM r WHERE n >= 3) WHERE i BETWEEN w * 2 AND w * 2 + 2 GROUP BY user_id, run_start, w""")
def _(spark, d):
    x = stream(spark, d).withColumn("run_key", F.floor(F.col("event_id") / 5000))
    return run(spark, j.stream_count_windows(x, "user_id", "event_id", "run_key", "value", 3, 2, time="t", late="1 hour", idle=43200), "j1e")


@query("J2_stream_sessions", """, e AS (SELECT user_id, value, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS c FROM events WHERE ts IS NOT NULL),
 s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, count(*) AS n_rows, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def _(spark, d):
    return run(spark, j.stream_sessions(stream(spark, d), ["user_id"], "ts", "6 hours", "1 hour", "value"), "j2", j.run_to_whole_table).select("user_id", "n_rows", "total")


@query("J3_stream_time_guard", "SELECT user_id::VARCHAR AS group_key, event_id AS row_id, t, coalesce(t < max(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM ep")
def _(spark, d):
    return run(spark, j.stream_time_guard(stream(spark, d), "user_id", "t", "event_id"), "j3")


@query("J3_stream_ending_guard", "SELECT user_id::VARCHAR AS group_key, event_id AS row_id, t, coalesce(t < max(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM ep")
def _(spark, d):
    return run(spark, j.stream_time_guard(stream(spark, d), "user_id", "t", "event_id", "1 hour", 86400), "j3e")


@query("J4_stream_gate", GATED + f"SELECT event_id, gated_alarm, rescue, CASE WHEN prob >= 0.75 THEN 'HIGH' WHEN prob >= 0.25 THEN 'MID' ELSE 'LOW' END AS route, prob < 0.25 AND {UD.format(k='event_id')} < 0.1 AS audited FROM g")
def _(spark, d):
    x = j.stream_gate(stream(spark, d), "value", "prob", 20, 0.5, 0.25, 0.75, 0.1, ["event_id"])
    return run(spark, x.select("event_id", "gated_alarm", "rescue", "route", "audited"), "j4")


@query("J5_stream_dedupe", "SELECT DISTINCT event_id FROM ep")
def _(spark, d):
    x = stream(spark, d).select("event_id", "ts")
    return run(spark, j.stream_dedupe(x.union(x), ["event_id"], "ts", "3650 days"), "j5").select("event_id")


@query("J6_stream_first_alarm", GATED + f"SELECT user_id::VARCHAR AS group_key, event_id AS row_id, t FROM (SELECT *, row_number() OVER ({W}) AS n FROM g WHERE gated_alarm) WHERE n = 1")
def _(spark, d):
    x = stream(spark, d).withColumn("alarm", (F.col("value") <= 20) & (F.col("prob") >= 0.5))
    return run(spark, j.stream_first_alarm(x, "user_id", "t", "event_id", "alarm"), "j6")


@query("J6_stream_sequence_alarms", GATED + f""", s AS (SELECT *, sum(c) OVER ({W}) AS part FROM (SELECT *, CASE WHEN t - lag(t) OVER ({W}) > 86400 THEN 1 ELSE 0 END AS c FROM g))
SELECT user_id::VARCHAR AS group_key, event_id AS row_id, t, false AS late FROM (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY t, event_id) AS n FROM s WHERE gated_alarm) WHERE n = 1""")
def _(spark, d):
    x = stream(spark, d).withColumn("alarm", (F.col("value") <= 20) & (F.col("prob") >= 0.5))
    return run(spark, j.stream_sequence_alarms(x, "user_id", "t", "event_id", "alarm", "1 hour", 86400), "j6e")


ROLLUP = "SELECT event_type, count(*) AS n_rows, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(sqrt(avg(value * value)), 6) AS rms FROM (SELECT *, t // 86400 AS k FROM ep) GROUP BY event_type, k"


@query("J7_stream_rollup", ROLLUP)
def _(spark, d):
    return run(spark, j.stream_rollup(stream(spark, d), ["event_type"], "ts", "value", "1 day", None, "1 hour"), "j7", j.run_to_whole_table).select("event_type", "n_rows", "mean", "std", "rms")


@query("J7_rollup_batch", ROLLUP)
def _(spark, d):
    x = endpoints(spark, d).withColumn("ts", F.timestamp_seconds("t"))
    return j.rollup(x, ["event_type"], "ts", "value", "1 day").select("event_type", "n_rows", "mean", "std", "rms")
