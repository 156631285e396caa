"""Streaming: exact dedup under a watermark, windowed counts, count-based buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_dedup(stream: DataFrame, time: str, text: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose content was not seen within the delay; state is bounded by the watermark."""
    return stream.withWatermark(time, delay).withColumn("digest", F.sha2(text, 256)).dropDuplicatesWithinWatermark(["digest"])


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, delay).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop; the sink is Parquet."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
