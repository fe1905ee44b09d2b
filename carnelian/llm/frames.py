"""What the operators share around their Arrow kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_batches(df: DataFrame, columns: list, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """work() on every Arrow batch of the columns; only these are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.select(*columns).mapInArrow(run, schema)


def text_bytes(column: str):
    """The text as bytes, under the name "text"; null stays null."""
    return F.col(column).cast("binary").alias("text")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes not to be a column of df."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and both are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='carnelian-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again: lineage ends there.

    The table goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/carnelian-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[id(out)] = (out, place)
    return out


_PLACES: dict[int, tuple] = {}


def released(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for table in tables:
        _, place = _PLACES.pop(id(table), (None, None))
        if place is not None:
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def broadcast(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)


def first_by_hash(rows: DataFrame, most: int, slack: int = 4) -> DataFrame:
    """rows (id, and a column group of few values): of each group the most rows that come first by a hash of the id.

    Groups are counted first, and only rows whose hash is low enough to be among
    the first slack * most (as many as that are expected) go on to be ranked, so
    what a task ranks doesn't grow with the table."""
    counts = {r["group"]: r.n for r in rows.groupBy("group").agg(F.count("*").alias("n")).collect()}
    hashed = rows.withColumn("_h", F.xxhash64("id"))
    low = F.lit(False)
    for group, n in counts.items():
        same = F.col("group").eqNullSafe(F.lit(group))
        edge = -(1 << 63) + (1 << 64) * slack * most // max(1, n)
        low = low | (same if edge >= 1 << 63 else same & (F.col("_h") < F.lit(edge)))
    place = F.row_number().over(Window.partitionBy("group").orderBy("_h", "id"))
    return hashed.where(low).withColumn("_place", place).where(F.col("_place") <= most).drop("_h", "_place")
