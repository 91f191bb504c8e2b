"""Stages as streams: new records are processed as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def record_stream(spark: SparkSession, folder: str, schema: StructType, *, event_time: str | None = None, late: str = "1 day", max_files: int = 64) -> DataFrame:
    """Stream of records of a folder; with ``event_time`` each record id once within the lateness."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    return df.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["resource_id"]) if event_time else df


def run_stage(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    """``stage`` over each micro-batch, written once for each batch id, so a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{output}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_counts(events: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """``window, field_key, n``: changes by time of creation, events delivered twice once, late ones within ``late``."""
    once = events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy(F.window("created_at", window), "field_key").agg(F.count("*").alias("n"))
