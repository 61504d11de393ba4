"""Incremental runs with Structured Streaming: an append-only log of processed items and sliding failure windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, state: str, files: int = 16) -> None:
    """Processes files that are new since the last run and appends the result; ``state`` makes it exactly once a file:
    a batch that is run again writes to its own folder anew."""

    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def failure_windows(events: DataFrame, ts: str, by: list[str], length: str, slide: str, late: str) -> DataFrame:
    """Counts in sliding windows; works on streams and tables. Rows later than ``late`` are dropped by a stream."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, length, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def replay(spark: SparkSession, source: str, schema: str, query: Callable[[DataFrame], DataFrame], name: str, state: str) -> DataFrame:
    """All of a folder through a streaming query into a table in memory (for tests and small results)."""
    q = query(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode("complete").format("memory").queryName(name)
    q.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
