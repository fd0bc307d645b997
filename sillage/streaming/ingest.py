"""Crawl while indexing: a stream over the folder into which pages are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sillage.operators import pages as P
from sillage.sources.tables import PAGES, USAGE


def pages(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New JSON-lines files of pages as they come; pages without URL or HTML drop out."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).json(folder).where("url <> '' and html <> ''")


def first_of_url(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each URL once within the delay; what is remembered is dropped after it."""
    timed = stream.withColumn("at", F.coalesce(F.to_timestamp("crawled_at"), F.current_timestamp()))
    return timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["url"])


def chunks(stream: DataFrame) -> DataFrame:
    return P.chunks(stream)


def append(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """The stream's rows into a table; once takes what is there and ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start() if once else writer.start()


def each_batch(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_by_window(spark: SparkSession, folder: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tokens of usage events by type in windows of time; late events within the delay still count."""
    events = spark.readStream.schema(USAGE).json(folder).withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", delay)
    return events.groupBy(F.window("at", window), "type").agg(F.sum("total_tokens").alias("tokens"), F.count("*").alias("events"))
