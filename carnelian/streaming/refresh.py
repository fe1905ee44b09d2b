"""Streams: files that arrive are parsed into the store, usage events are counted by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carnelian.functions.scalars import latency_bucket
from carnelian.operators.incremental import KEEP_USAGE_DAYS
from carnelian.sources.checkouts import split_scan
from carnelian.sources.store import Store

SAVES = "checkout string, path string, text string, seq bigint"


def saved_files(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of saved files (checkout, path, text, and seq: which of two saves of a path is the later) from a folder of JSON lines."""
    return spark.readStream.schema(SAVES).option("maxFilesPerTrigger", files_a_batch).json(folder)


def refresh(store: Store, saves: DataFrame, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch into the store: contents are parsed once, and a save replaces its path's entry.

    Of several saves of a path in a batch that with the greatest seq counts, of equals the greatest text.
    A batch that runs again after a failure finds its contents parsed and its
    entries in place, so it changes nothing."""

    def upsert(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("checkout", "path").agg(F.max(F.struct("seq", "text")).alias("last"))
        scan = last.select("checkout", "path", F.col("last.text").cast("binary").alias("content"))
        files, blobs = split_scan(scan)
        kept = store.files().join(files.select("checkout", "path"), ["checkout", "path"], "left_anti")
        store.load(kept.unionByName(files), blobs)

    return saves.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_counts(events: DataFrame, by: list[str], at: str = "ts") -> DataFrame:
    """Counts by day and key of a stream of events; days older than the retention are dropped from its state."""
    return events.withWatermark(at, f"{KEEP_USAGE_DAYS} days").groupBy(F.window(at, "1 day").alias("day"), *by).agg(F.count("*").alias("n")).select(F.col("day.start").cast("date").alias("day"), *by, "n")


def latency_counts(events: DataFrame, milliseconds: str, at: str = "ts") -> DataFrame:
    return usage_counts(events.withColumn("bucket", latency_bucket(F.col(milliseconds))), ["bucket"], at)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that is there now, run through the stream; its result as a table in memory."""
    spark = stream.sparkSession
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
