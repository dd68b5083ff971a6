"""A streaming front for incremental indexing: files that arrive are chunked once, and a set hash of what was seen is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals


def chunk_stream(spark: SparkSession, folder: str, schema: str, key: str = "doc_id", text: str = "text", most: int = 120, overlap: int = 12) -> DataFrame:
    """A stream of line windows over Parquet files of documents as they arrive."""
    return intervals.windows(spark.readStream.schema(schema).parquet(folder), key, text, most, overlap)


def index_available(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> None:
    """Chunks what has arrived since the last call, and stops; the checkpoint makes each file count once."""
    stream = chunk_stream(spark, folder, schema).withColumn("text_sha256", F.sha2("chunk_text", 256))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total of a stream (or table) of events, closed by a watermark."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")
