"""Windows and keyed state over events, as batch queries with oracles; tests replay the same operators as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.sources.tables import read
from vellum.streaming import events as op

from .registry import Registry

register = Registry()
QUERIES, ORACLE_SQL = register.queries, register.oracles


@register("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def ext_tumbling_windows(spark, sf_dir):
    return op.windowed(read(spark, sf_dir, "events"), "ts", "event_type")


@register("SELECT s AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS s FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY ALL")
def ext_sliding_windows(spark, sf_dir):
    return op.windowed(read(spark, sf_dir, "events"), "ts", "event_type", "1 hour", slide="30 minutes")


@register(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def ext_sessions(spark, sf_dir):
    return op.sessions(read(spark, sf_dir, "events"), "ts", "user_id")


@register("SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error') >= 5 AS open FROM events GROUP BY user_id")
def str4_breaker(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "error").cast("int").alias("failed"))
    return op.breaker_batch(rows, "user_id", "failed")


@register("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
def fn_json_fields(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))
