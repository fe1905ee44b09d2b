"""Streams run to the end of what is there, beside SQL over the same table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from carnelian.plans.lineage import cut
from carnelian.streaming import refresh

QUERIES: dict = {}
ORACLES: dict = {}


def _folder(spark) -> str:
    cut(spark.range(1))  # sets the folder where none is
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def streamed_usage(spark, sf_dir):
    counts = refresh.usage_counts(_events(spark, sf_dir), ["event_type"])
    return refresh.run_to_table(counts, f"usage_{uuid.uuid4().hex}", _folder(spark))


def streamed_latency(spark, sf_dir):
    counts = refresh.latency_counts(_events(spark, sf_dir), "value")
    rows = refresh.run_to_table(counts, f"latency_{uuid.uuid4().hex}", _folder(spark))
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


QUERIES = {"streamed_usage": streamed_usage, "streamed_latency": streamed_latency}
ORACLES = {
    "streamed_usage": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "streamed_latency": "SELECT CASE WHEN value < 1 THEN '<1ms' WHEN value < 10 THEN '<10ms' WHEN value < 100 THEN '<100ms' WHEN value < 1000 THEN '<1s' WHEN value < 10000 THEN '<10s' ELSE '>=10s' END AS bucket, count(*) AS n FROM events GROUP BY 1",
}
