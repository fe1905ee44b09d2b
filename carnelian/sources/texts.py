"""Evidence in files that aren't Ruby: words of views, YAML scalars, generated files, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def words_of(files: DataFrame) -> DataFrame:
    """checkout, path, word, n: identifiers in each text file."""
    text = F.col("content").cast("string")
    words = files.select("checkout", "path", F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*[?!]?"), F.lit(0))).alias("word"))
    return words.groupBy("checkout", "path", "word").agg(F.count("*").alias("n"))


def yaml_scalars(files: DataFrame) -> DataFrame:
    """checkout, path, value: scalars of YAML files that could name a method or a constant; locales are left out."""
    yaml = files.where(F.col("path").rlike(r"\.ya?ml$") & ~F.col("path").rlike(r"(^|/)locales?/"))
    lines = yaml.select("checkout", "path", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))
    value = F.regexp_extract("line", r"""^\s*(?:-\s*)?(?:[\w.\-]+:\s*)?["']?([A-Za-z_](?:[\w:]*\w)?[?!]?)["']?\s*(?:#.*)?$""", 1)
    return lines.select("checkout", "path", value.alias("value")).where("value <> ''").distinct()


def is_generated(path: Column, content: Column) -> Column:
    """A path under generated/, or a mark in the first five lines."""
    head = F.array_join(F.slice(F.split(content.cast("string"), "\n"), 1, 5), "\n")
    return path.rlike(r"(^|/)generated/") | head.rlike(r"(?i)(auto-?generated|generated by|do not edit|@generated)")


def linguist_generated(attributes: str) -> list[str]:
    """Patterns that .gitattributes marks as generated."""
    return [line.split()[0] for line in attributes.split("\n") if "linguist-generated" in line and not line.strip().startswith("#") and "linguist-generated=false" not in line]


def read_misses(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Events of a newline-delimited JSON log that tell of a miss."""
    rows = spark.read.schema("ts timestamp, event string, name string, path string, line int, reason string").json(path)
    rows = rows.where(F.col("event") == "miss")
    return rows.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else rows


def doc_above(files: DataFrame, defs: DataFrame) -> DataFrame:
    """defs (checkout, path, name, line) with the comment that stands right above each."""
    lines = files.select("checkout", "path", F.split(F.col("content").cast("string"), "\n").alias("lines"))
    rows = defs.select("checkout", "path", "name", "line").join(lines, ["checkout", "path"])
    before = F.reverse(F.slice("lines", 1, F.greatest(F.col("line") - 1, F.lit(0))))
    first_other = F.array_position(F.transform(before, lambda x: x.rlike(r"^\s*#")), False)
    block = F.when(first_other == 0, before).otherwise(F.slice(before, 1, F.greatest(first_other.cast("int") - 1, F.lit(0))))
    text = F.array_join(F.transform(F.reverse(block), lambda x: F.regexp_replace(x, r"^\s*#+ ?", "")), "\n")
    return rows.select("checkout", "path", "name", "line", F.nullif(text, F.lit("")).alias("doc"))
