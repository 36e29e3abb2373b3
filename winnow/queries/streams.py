"""Structured Streaming operators, fed from the events table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import monitor
from .base import DE, query, sql, table, work_dir


def _event_stream(spark, sf):
    """The events table as a file stream; the glob keeps the other tables of the folder out."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)



@query("stream_quality", sql("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, count(value) AS value_ok,
 count(CASE WHEN value BETWEEN 0 AND 100 THEN 1 END) AS range_ok, round(count(value) * 100.0 / count(*), 2) AS value_pct,
 round(count(CASE WHEN value BETWEEN 0 AND 100 THEN 1 END) * 100.0 / count(*), 2) AS range_pct
FROM ev GROUP BY date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ev)""", DE))
def stream_quality(spark, sf):
    """Windows the watermark has closed; the newest ones stay open."""
    src = _event_stream(spark, sf).withColumn("value", F.expr(
        "CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 500 < 12 THEN 7D ELSE value END"))
    out = monitor.window_quality(src, "ts", {"value": F.col("value").isNotNull(), "range": F.col("value").between(0, 100)})
    path = work_dir(spark, "stream")
    monitor.write_stream(out, f"{path}/out", f"{path}/state")
    return spark.read.schema(out.schema).parquet(f"{path}/out").withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("batch_quality", sql("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, count(*) AS n, count(value) AS value_ok, round(count(value) * 100.0 / count(*), 2) AS value_pct
FROM ev GROUP BY date_trunc('day', ts)""", DE))
def batch_quality(spark, sf):
    from .base import dirty_events

    d = monitor.window_quality(dirty_events(spark, sf), "ts", {"value": F.col("value").isNotNull()}, window="1 day")
    return d.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    """The watermark covers the whole table, so the result is the batch result."""
    out = monitor.stream_dedup(_event_stream(spark, sf), ["user_id", "event_type"], "ts", delay="400 days")
    path = work_dir(spark, "dedup")
    monitor.write_stream(out.select("user_id", "event_type"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


@query("stream_mask", "SELECT event_id, left(event_type, 2) || '***' || right(event_type, 2) AS event_type FROM events WHERE value >= 0")
def stream_mask(spark, sf):
    """Row-wise operators run unchanged on a stream."""
    from ..operators.privacy import mask_pii
    from ..operators.rules import quarantine

    good, _ = quarantine(_event_stream(spark, sf), [{"column": "value", "rule_type": "min_value", "value": 0}])
    out = mask_pii(good, "event_type", "name").select("event_id", "event_type")
    path = work_dir(spark, "mask")
    monitor.write_stream(out, f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")
