"""Registering queries with their SQL, and the views that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import band

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The events as model endpoints: forecast ``value``, gate probability ``prob``, label ``error``; see ``endpoints``.
ENDPOINTS = """WITH ep AS (
  SELECT event_id, user_id, (epoch_us(ts) // 1000000)::BIGINT AS t, event_type, value,
         regexp_extract(props, '[0-9]+')::DOUBLE / 100 AS prob, event_type = 'error' AS label,
         CASE WHEN value <= 20 THEN 'near' WHEN value <= 60 THEN 'boundary' WHEN value IS NOT NULL THEN 'normal' END AS band
  FROM events
)
"""


def query(name: str, sql: str | None = None):
    """Registers a query; its doubles are rounded to 6 places. ``sql`` continues the WITH clause of ENDPOINTS."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})

        QUERIES[name] = run
        if sql:
            SQL[name] = ENDPOINTS + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, t (seconds), event_type, value, prob, label, band."""
    e = table(spark, sf_dir, "events")
    t = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    return e.select(
        "event_id", "user_id", t.alias("t"), "event_type", "value", (F.regexp_extract("props", "[0-9]+", 0).cast("double") / 100).alias("prob"),
        (F.col("event_type") == "error").alias("label"), band("value", [20, 60], ["near", "boundary", "normal"]).alias("band"),
    )


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalar import gate

    return gate(endpoints(spark, sf_dir), "value", "prob", 20)


GATED = """, g AS (
  SELECT *, value <= 20 AS forecast_alarm, value <= 20 AND prob >= 0.5 AS gated_alarm, value <= 20 AND NOT (prob >= 0.5) AS rescue FROM ep
)
"""
