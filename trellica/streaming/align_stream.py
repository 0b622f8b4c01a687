"""Alignment of streams of pairs with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trellica.operators.align import align


def align_stream(pairs: DataFrame, path: str, checkpoint: str, keep: tuple[str, ...] = (), trigger: str = "10 seconds", **options) -> StreamingQuery:
    """Align a stream of pairs into Parquet files at path; options are those of align()."""
    out = align(pairs, keep=keep, **options).drop("query", "target")
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def status_by_window(aligned: DataFrame, ts: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, verification_status, n): results by event-time window, final once the watermark has passed."""
    counts = aligned.withWatermark(ts, late).groupBy(F.window(ts, width), "verification_status").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "verification_status", "n")
