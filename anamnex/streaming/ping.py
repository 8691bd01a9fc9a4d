"""A live ping log as a stream: new files of a folder are parsed as they come; no windows, as none are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.diagnostics import ping_lines


def ping_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return ping_lines(lines)


def to_parquet(samples: DataFrame, out: str, checkpoint: str):
    """Append parsed samples to a table, each file once; ends when all files there are have been read."""
    return samples.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
