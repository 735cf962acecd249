"""Incremental ingestion: document usage arrives in micro-batches and adds up to the same lexicon as one batch job.

The table is kept as one folder for each micro-batch.  A batch that is delivered
again after a failure overwrites its own folder, so every document counts exactly
once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexispan.operators.usage import lexicon_of, usage_sums, word_rows


def start_usage(documents: DataFrame, path: str, *, checkpoint: str, axis: str = "surface") -> StreamingQuery:
    """Streams documents (doc_id, text) into usage sums under `path`; processes what is there and stops."""

    def write(batch: DataFrame, number: int) -> None:
        usage_sums(word_rows(batch), axis).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_so_far(spark: SparkSession, path: str, *, axis: str = "surface") -> DataFrame:
    """Usage summed over all batches."""
    return usage_sums(spark.read.parquet(path), axis, mass="expected_mass")


def lexicon_so_far(spark: SparkSession, path: str) -> DataFrame:
    return lexicon_of(usage_so_far(spark, path))


def windowed_counts(events: DataFrame, *, time: str, kind: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, kind, n) per tumbling window; rows later than the watermark are left out of a stream."""
    watched = events.withWatermark(time, late) if events.isStreaming else events
    return watched.groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
