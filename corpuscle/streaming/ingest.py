"""Incremental ingest: files in, chunks out, each chunk once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import fixed


def chunk_stream(spark: SparkSession, path: str, schema, size: int = 512, overlap: float = 0.2) -> DataFrame:
    """Chunks of the documents in files that arrive in ``path``."""
    return fixed(spark.readStream.schema(schema).parquet(path), size, overlap)


def ingest_available(chunks: DataFrame, target: str, checkpoint: str) -> None:
    """Takes what is there and ends. A batch that is repeated after a failure is written to the same place again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["doc_id", "chunk_index"]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 hours", at: str = "ts") -> DataFrame:
    """Events by type and time window; rows later than the watermark are left out once their window is closed."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
