"""Gap sessions of timed tracks, for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, key: str, time: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Runs of a key's events without a longer gap: (key, started, last, samples), the times in
    seconds since the epoch. The same plan serves batch and stream; a stream needs a watermark,
    after which late events are dropped and closed sessions are emitted."""
    ts = F.col(time).cast("timestamp")
    df = events.withColumn("_t", ts)
    if watermark:
        df = df.withWatermark("_t", watermark)
    out = df.groupBy(key, F.session_window("_t", gap).alias("_w")).agg((F.unix_micros(F.min("_t")) / F.lit(1e6)).alias("started"), (F.unix_micros(F.max("_t")) / F.lit(1e6)).alias("last"), F.count("*").alias("samples"))
    return out.select(key, "started", "last", "samples")


def windowed_counts(events: DataFrame, key: str, time: str, length: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Counts per key and tumbling or sliding window."""
    df = events.withColumn("_t", F.col(time).cast("timestamp"))
    if watermark:
        df = df.withWatermark("_t", watermark)
    w = F.window("_t", length, slide) if slide else F.window("_t", length)
    return df.groupBy(key, w.alias("_w")).agg(F.count("*").alias("n")).select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")
