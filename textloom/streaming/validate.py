"""Streams, an extension: scripts are checked as they arrive, events counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scripts import syntax_issues


def watch_scripts(spark: SparkSession, root: str, out: str, checkpoint: str, pattern: str = "*.qsrc") -> StreamingQuery:
    """Appends the issues of new scripts below the root to a Parquet table, exactly once by batch."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    arrived = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def check(batch: DataFrame, number: int) -> None:
        syntax_issues(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrived.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; those later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
