"""Quality monitoring and deduplication over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import c, count_if


def as_event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a TIMESTAMP; time-zone-free ones are read in the session's zone."""
    return df.withColumn(column, c(column).cast("timestamp"))


def window_quality(df: DataFrame, ts: str, checks: dict[str, Column], window: str = "1 hour",
                   delay: str = "10 minutes") -> DataFrame:
    """Rows and passing rows of every check per tumbling window.

    Works on batch and streaming input alike; the state is one row per open window."""
    src = as_event_time(df, ts)
    if df.isStreaming:
        src = src.withWatermark(ts, delay)
    aggs = [F.count(F.lit(1)).alias("n"), *[count_if(x).alias(f"{k}_ok") for k, x in checks.items()]]
    g = src.groupBy(F.window(c(ts), window).alias("w")).agg(*aggs)
    share = [F.round(c(f"{k}_ok") * 100.0 / c("n"), 2).alias(f"{k}_pct") for k in checks]
    return g.select(F.col("w.start").alias("window_start"), "n", *[f"{k}_ok" for k in checks], *share)


def stream_dedup(df: DataFrame, keys: Sequence[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """First row per key: on a batch the earliest by time, rows without a time last (of equal times the smallest row); on a
    stream the first to arrive, whose state is dropped once the watermark has passed."""
    src = as_event_time(df, ts)
    if not df.isStreaming:
        rest = [n for n in df.columns if n not in keys]
        if not rest:
            return src.distinct()
        row = F.struct(*[c(n) for n in rest])
        first = src.groupBy(*[c(k) for k in keys]).agg(F.min_by(row, F.struct(c(ts).isNull(), c(ts), F.to_json(row))).alias("_r"))
        return first.select(*[c(n) if n in keys else F.col("_r")[n].alias(n) for n in df.columns])
    return src.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run all available input into a Parquet sink; the checkpoint makes a restart resume exactly once."""
    q = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
