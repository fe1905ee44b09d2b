"""Checkouts as files(checkout, path, oid) and blobs(oid, content, reader)."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.functions.scalars import git_oid
from carnelian.sources.readers import MOST_BYTES, REGULAR, is_indexed, reader_of


def from_rows(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(checkout, path, text) as a scan."""
    df = spark.createDataFrame(rows, "checkout string, path string, text string")
    return df.select("checkout", "path", F.col("text").cast("binary").alias("content"))


def read_directory(spark: SparkSession, root: str, checkout: str | None = None) -> DataFrame:
    """Files below a directory that are read, regular and not too large.  Paths are relative to the root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "/")
    relative = F.regexp_replace(path, "^" + _quoted(root.split(":", 1)[-1].rstrip("/")) + "/", "")
    rows = found.where(F.col("length") <= MOST_BYTES).select(F.lit(checkout or root).alias("checkout"), relative.alias("path"), "content")
    return rows.where(is_indexed(F.col("path")))


def _quoted(text: str) -> str:
    return "\\Q" + "/" + text.lstrip("/") + "\\E"


def split_scan(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files and blobs of a scan (checkout, path, content); each content is a blob once."""
    rows = scan.where(is_indexed(F.col("path"))).withColumn("oid", git_oid(F.col("content")))
    files = rows.select("checkout", "path", "oid", *[c for c in scan.columns if c == "layer"])
    blobs = rows.select("oid", "content", reader_of(F.col("path")).alias("reader")).dropDuplicates(["oid"])
    return files, blobs


def git_listing(root: str) -> list[tuple[str, str, str]]:
    """(mode, oid, path) of what git tracks."""
    out = subprocess.run(["git", "-C", root, "ls-files", "-s", "-z"], capture_output=True, check=True).stdout
    rows = []
    for entry in out.split(b"\0"):
        if entry:
            head, path = entry.split(b"\t", 1)
            mode, oid, _stage = head.decode().split(" ")
            rows.append((mode, oid, path.decode("utf-8", "replace")))
    return rows


def git_files(spark: SparkSession, root: str, checkout: str | None = None) -> DataFrame:
    """files of a git checkout as its index has them: regular files only, no links or submodules."""
    rows = spark.createDataFrame(git_listing(root), "mode string, oid string, path string")
    return rows.where(F.col("mode").isin(*REGULAR) & is_indexed(F.col("path"))).select(F.lit(checkout or root).alias("checkout"), "path", "oid")


def git_dirty(spark: SparkSession, root: str) -> DataFrame:
    """path, gone of what differs from the index or isn't tracked."""
    out = subprocess.run(["git", "-C", root, "status", "--porcelain=v1", "-z", "--no-renames", "--untracked-files=all"], capture_output=True, check=True).stdout
    rows = [(e[3:].decode("utf-8", "replace"), "D" in e[:2].decode()) for e in out.split(b"\0") if e]
    return spark.createDataFrame(rows, "path string, gone boolean")


def one_schema_an_app(files: DataFrame) -> DataFrame:
    """files with one schema dump for each db directory: db/schema.rb where there is one, else structure.sql."""
    dump = F.col("path").rlike(r"(^|/)db/(schema\.rb|structure\.sql)$")
    where = F.regexp_replace("path", r"[^/]+$", "")
    ruby = files.where(dump & F.col("path").endswith("schema.rb")).select("checkout", where.alias("at")).distinct()
    other = files.where(dump & F.col("path").endswith("structure.sql")).withColumn("at", where).join(ruby, ["checkout", "at"], "left_semi").select("checkout", "path")
    return files.join(other, ["checkout", "path"], "left_anti")


def nearby(names: DataFrame, files: DataFrame, cap: int = 4) -> DataFrame:
    """For each (checkout, path, name) the files that autoload conventions would hold the constant in, nearest first, at most cap."""
    from pyspark.sql.window import Window

    from carnelian.functions.scalars import shared_dirs, underscore

    wanted = names.withColumn("file", F.concat(F.element_at(F.split(underscore(F.col("name")), "/"), -1), F.lit(".rb")))
    held = files.select("checkout", F.col("path").alias("candidate"), F.element_at(F.split("path", "/"), -1).alias("file"))
    rows = wanted.join(held, ["checkout", "file"])
    near = Window.partitionBy("checkout", "path", "name").orderBy(F.desc(shared_dirs(F.col("path"), F.col("candidate"))), F.length("candidate"), "candidate")
    return rows.withColumn("at", F.row_number().over(near)).where(F.col("at") <= cap).select("checkout", "path", "name", "candidate", "at")


def git_fingerprint(root: str) -> str | None:
    """What git's index looks like from outside; while it is the same, nothing was staged or checked out."""
    import os

    try:
        s = os.stat(os.path.join(root, ".git", "index"))
    except OSError:
        return None
    return f"{s.st_mtime_ns}:{s.st_size}:{s.st_ino}"


def load_order(files: DataFrame, open_paths: list[str], roots: DataFrame) -> DataFrame:
    """files with batch: what is open and its directory first, then the checkout, the gems it names, and the rest.

    roots: checkout, kind."""
    where = F.regexp_replace("path", r"[^/]+$", "")
    near = [p.rsplit("/", 1)[0] + "/" if "/" in p else "" for p in open_paths]
    rows = files.join(F.broadcast(roots), "checkout")
    batch = F.when(F.col("path").isin(open_paths), 0).when(where.isin(near), 1).when(F.col("kind") == "repo", 2).when(F.col("kind") == "gem", 3).otherwise(4)
    return rows.withColumn("batch", batch).drop("kind")


def compose(scan: DataFrame, checkouts: DataFrame, gem_use: DataFrame) -> DataFrame:
    """The scan of every application: its own files, those of the gems it uses, and those of the standard library and core.

    checkouts: root, kind.  gem_use: checkout, gem_root.  Files of other checkouts
    are named by their root and path; layer says what is read before what."""
    from carnelian.operators.relational import layer

    apps = checkouts.where("kind = 'repo'").select(F.col("root").alias("app"))
    own = apps.select("app", F.col("app").alias("root"))
    gems = gem_use.select(F.col("checkout").alias("app"), F.col("gem_root").alias("root")).join(apps, "app", "left_semi")
    shared = checkouts.where("kind IN ('stdlib', 'core')").select("root").join(apps, how="cross").select("app", "root")
    pairs = own.unionByName(gems).unionByName(shared).distinct().join(checkouts.select("root", "kind"), "root")
    rows = scan.withColumnRenamed("checkout", "root").join(F.broadcast(pairs), "root")
    path = F.when(F.col("root") == F.col("app"), F.col("path")).otherwise(F.concat("root", F.lit("/"), "path"))
    return rows.select(F.col("app").alias("checkout"), path.alias("path"), "content", layer(F.col("kind")).alias("layer"))
