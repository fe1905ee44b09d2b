"""Fact tables on disk: Parquet by version and kind, written whole or as a delta."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian import schema
from carnelian.extract.facts import KINDS
from carnelian.operators import extraction
from carnelian.operators.incremental import apply_delta, map_delta


class Store:
    """A folder: facts/v=N (append only, by content) and maps (a new folder for each state)."""

    def __init__(self, spark: SparkSession, root: str, version: int = schema.VERSION):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version
        self.facts_path = f"{self.root}/facts/v={version}"
        moved = self._read(f"{self.root}/compactions/v={version}", "at timestamp, path string").orderBy(F.desc("at")).limit(1).collect()
        if moved:
            self.facts_path = moved[0].path

    def _read(self, path: str, columns: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(columns).parquet(path)
        except AnalysisException:
            return self.spark.createDataFrame([], columns)

    def wide(self) -> DataFrame:
        """Every blob's facts; an older version's folder is never read."""
        return self._read(self.facts_path, extraction.WIDE)

    def facts(self, kind: str) -> DataFrame:
        return extraction.facts(self.wide(), kind)

    def files(self) -> DataFrame:
        current = self.current()
        return self._read(f"{self.root}/maps/{current}", schema.FILES) if current else self.spark.createDataFrame([], schema.FILES)

    def current(self) -> str | None:
        """The map that the last finished load named."""
        rows = self._read(f"{self.root}/loads", "at timestamp, map string, parsed bigint, changed bigint").orderBy(F.desc("at"), F.desc("map")).limit(1).collect()
        return rows[0].map if rows else None

    def load(self, files: DataFrame, blobs: DataFrame, macros: list | None = None) -> dict[str, int]:
        """Parses contents that no facts are held of, and records the new map; writes nothing if it is the old one."""
        delta = map_delta(self.files(), files).persist()
        changed = delta.count()
        if not changed:
            delta.unpersist()
            return {"parsed": 0, "changed": 0}
        fresh = extraction.unknown_blobs(files, blobs, self.wide())
        parsed = extraction.extract_blobs(fresh, macros)
        parsed.sortWithinPartitions("oid").write.mode("append").parquet(self.facts_path)
        name = uuid.uuid4().hex
        apply_delta(self.files(), delta).sortWithinPartitions("checkout", "path").write.parquet(f"{self.root}/maps/{name}")
        n = self.wide().join(fresh.select("oid"), "oid", "left_semi").count()
        # the row that makes the load visible is written last
        self.spark.createDataFrame([(name, n, changed)], "map string, parsed bigint, changed bigint").select(F.current_timestamp().alias("at"), "map", "parsed", "changed").coalesce(1).write.mode("append").parquet(f"{self.root}/loads")
        delta.unpersist()
        return {"parsed": n, "changed": changed}

    def add(self, files: DataFrame, blobs: DataFrame, macros: list | None = None) -> dict[str, int]:
        """A part of a checkout: its paths are added or replaced, none is removed."""
        rest = self.files().join(files.select("checkout", "path"), ["checkout", "path"], "left_anti")
        return self.load(rest.unionByName(files.select("checkout", "path", "oid")), blobs, macros)

    def drop_checkout(self, root: str) -> int:
        """Forgets the map of a checkout; the facts of its contents stay until they are collected. How many paths went."""
        held = self.files()
        gone = held.where(F.col("checkout") == root).count()
        if gone:
            self.load(held.where(F.col("checkout") != root), self.spark.createDataFrame([], "oid string, reader string, content binary"))
        return gone

    def compact(self, files: int = 1) -> bool:
        """Rewrites the facts in that many files under a new folder and names it, if there are more; readers of the old one are not disturbed.

        Facts that no file maps any more are left behind."""
        wide = self.wide()
        held = wide.inputFiles()
        if len(held) <= files:
            return False
        fresh = f"{self.facts_path}-{uuid.uuid4().hex}"
        wide.join(self.files().select("oid").distinct(), "oid", "left_semi").dropDuplicates(["oid"]).coalesce(files).sortWithinPartitions("oid").write.parquet(fresh)
        self.spark.createDataFrame([(fresh,)], "path string").select(F.current_timestamp().alias("at"), "path").coalesce(1).write.mode("append").parquet(f"{self.root}/compactions/v={self.version}")
        self.facts_path = fresh
        return True

    def write_kinds(self, path: str) -> None:
        """A table for each kind of fact, for readers that want them flat."""
        for kind in KINDS:
            self.facts(kind).write.mode("overwrite").parquet(f"{path}/kind={kind}")


def write_listing(rows: DataFrame, path: str, answer: str) -> None:
    """Rows as newline-delimited JSON, and a footer that counts them."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    rows.agg(F.lit(answer).alias("answer"), F.count("*").alias("rows")).write.mode("overwrite").json(f"{path}/footer")


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def rooted(rows: DataFrame, checkouts: DataFrame) -> DataFrame:
    """rows (path, ...) with root and the path below it: that of the deepest checkout above."""
    from carnelian.operators.relational import owning_checkout

    owner = owning_checkout(rows.select("path").distinct(), checkouts)
    return rows.join(owner, "path", "left").withColumn("path", F.when(F.col("root").isNotNull(), F.expr("substring(path, length(root) + 2)")).otherwise(F.col("path")))
