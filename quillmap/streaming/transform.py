"""Row-wise operators over files as they arrive, by Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.session import shared_dir


def stream_files(spark: SparkSession, folder: str, like: DataFrame, per_batch: int = 16) -> DataFrame:
    """A stream of a folder's Parquet files, ``per_batch`` files at a time."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def stream_transform(source: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str | None = None) -> None:
    """Applies a row-wise transform to all files there are, and writes each once.

    The checkpoint remembers which files are done: a run that is broken off, or finds new files, goes on where it ended.
    Every batch is bounded, whatever the size of the source.
    """
    spark = source.sparkSession
    place = checkpoint or f"{shared_dir(spark)}/quillmap-stream-{uuid.uuid4().hex}"
    query = transform(source).writeStream.format("parquet").option("path", target).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_counts(source: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Rows of each window of event time, complete once the watermark has passed it."""
    return source.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
