"""Judged rows as they arrive: running metrics, and each request once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.operators import judging


def judged_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of judged rows under a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """The metrics of each group so far. State: one row of counts for each group."""
    return judging.metrics(rows, by)


def first_requests(rows: DataFrame, time: str, keys: tuple[str, ...] = ("judge_model", "prompt_version", "prompt_sha256"), late: str = "1 day") -> DataFrame:
    """Each request once within the watermark; older keys leave the state."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
