"""Continuous ingestion and run logs on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.store import Store


def arriving(spark: SparkSession, path: str, schema: str, files_a_time: int = 100) -> DataFrame:
    """New Parquet files under path as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_time).parquet(path)


def new_only(stream: DataFrame, event_time: str, keys: Sequence[str], lateness: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen within the watermark: the content-hash gate of a stream."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(list(keys))


def merge_into(store: Store, table: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: upserts a batch, later batches winning. Run again for the same batch it changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        store.upsert(table, batch.withColumn("_batch", F.lit(number).cast("long")), keys, "_batch")
        store.vacuum(table)

    return merge


def call_sessions(stream: DataFrame, event_time: str, run: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Calls of a run with no gap longer than `gap`: start, end, calls."""
    s = stream.withWatermark(event_time, lateness)
    w = F.session_window(event_time, gap)
    return s.groupBy(run, w.alias("w")).agg(F.count("*").alias("calls")).select(run, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def call_rates(stream: DataFrame, event_time: str, by: str, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Calls of each group in fixed windows."""
    s = stream.withWatermark(event_time, lateness)
    return s.groupBy(by, F.window(event_time, width).alias("w")).agg(F.count("*").alias("calls")).select(by, F.col("w.start").alias("start"), "calls")
