"""The work queue as a stream: files of status events become the queue's current state, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 20) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def current(stream: DataFrame, key: str, status: str, at: str, delay: str | None = None) -> DataFrame:
    """The last status of each key and its time; works on streams and tables. With a delay, later events are dropped."""
    if delay:
        stream = stream.withWatermark(at, delay)
    return stream.groupBy(key).agg(F.max_by(status, at).alias("status"), F.max(at).alias("updated_at"))


def process(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs work on each micro-batch until all present input is done; a restart continues at the checkpoint."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(stream: DataFrame, at: str, status: str, delay: str = "10 minutes") -> DataFrame:
    """Events by hour and status, for progress reports."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, "1 hour").alias("w"), status).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), status, "n")
