"""Payload files as streams: the same row-wise shapes, with repeats dropped inside a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.stays import diagnosis_table, prepare


def payload_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def fresh(rows: DataFrame, keys: list[str], arrived: str, delay: str = "1 day") -> DataFrame:
    """Rows whose keys didn't come before within the delay: what overlapping fetch windows repeat."""
    return rows.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(keys)


def diagnosis_stream(stays: DataFrame) -> DataFrame:
    return diagnosis_table(prepare(stays))


def write_available(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Takes what is there, in bounded micro-batches, and stops; the checkpoint makes the next run go on from it."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
