"""Element and chunk folders as streams: what has been processed is known to the checkpoint, so a run takes up where the last one ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import scores
from ..operators import windows


def elements(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def chunked(stream: DataFrame, text: str = "text", size: int = 1200, overlap: int = 200) -> DataFrame:
    """Child windows with their quality; windows need no state, as each text arrives whole."""
    return windows.child_windows(stream, text, size, overlap).withColumn("quality", scores.content_quality(F.col("content")))


def arrivals(stream: DataFrame, time: str, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and mean quality of chunks for windows of arrival; rows later than ``delay`` are dropped."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.avg("quality").alias("quality"))


def run(stream: DataFrame, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Process all that is there, append Parquet below ``out`` and stop; ``process`` sees each batch as a table of its own.

    A batch that is run again after a failure replaces its own folder, so nothing is written twice.
    """
    if process is None:
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
