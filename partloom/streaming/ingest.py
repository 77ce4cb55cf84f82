"""Structured Streaming over arriving component lines; an addition, the batch operators need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import norm, quantity


def arriving_lines(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def quantities_by_code(lines: DataFrame, time: str = "arrived", delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Window, code, qty: sums per part of lines that arrive at most ``delay`` late."""
    typed = lines.select(F.col(time), norm(F.col("internal_code")).alias("code"), quantity(F.col("qty")).alias("qty"))
    return typed.withWatermark(time, delay).groupBy(F.window(time, window), "code").agg(F.sum("qty").alias("qty"), F.count("*").alias("lines"))


def start(df: DataFrame, folder: str, checkpoint: str, once: bool = True):
    writer = df.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
