"""The streaming summaries as batch queries: the same functions on a table, where watermarks drop nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.plans.catalog import query
from quantloom.sources.driver_tables import read
from quantloom.streaming import events


def stamped(spark, d):
    return read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("str_01_daily_activity", """SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end,
    count(*) AS n, sum(value) AS total, max(value) AS largest FROM events GROUP BY ALL""", "total largest")
def str_01(spark, d):
    return events.windowed_activity(stamped(spark, d), ("event_type",))


@query("str_02_sliding_activity", """SELECT event_type, w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS n, sum(value) AS total, max(value) AS largest
    FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS w FROM events) GROUP BY ALL""", "total largest")
def str_02(spark, d):
    return events.windowed_activity(stamped(spark, d), ("event_type",), width="1 hour", slide="30 minutes")


@query("str_03_sessions", """WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def str_03(spark, d):
    return events.sessions(stamped(spark, d), ("user_id",), gap="6 hours")
