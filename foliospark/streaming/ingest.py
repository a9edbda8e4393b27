"""Continuous ingest: new files are scored and appended once, late and repeated rows are dropped. An extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from foliospark.sources.files import append_new


def append_stream(spark: SparkSession, source: str, schema: StructType, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, keys: list[str], *, available_now: bool = True) -> StreamingQuery:
    """Reads new Parquet files under source, applies work to each batch and appends the rows whose keys target lacks.

    A batch that is run again after a failure adds nothing twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        append_new(work(df), target, keys)

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, *, time_col: str = "ts", by: str = "event_type", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window_start, by, n, total): events by window with a watermark; the same code runs on a stream and on a table."""
    windowed = events.withWatermark(time_col, delay).groupBy(F.window(time_col, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windowed.select(F.col("window.start").alias("window_start"), by, "n", "total")
