"""What changes between loads: deltas of the file map, overlays, retention, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnelian.functions.scalars import latency_bucket

#: Most changed files that a query reads in passing; beyond, what is stored is stale.
MOST_CHANGES = 32
KEEP_USAGE_DAYS, KEEP_BLOB_DAYS, YOUNG_HOURS = 90, 14, 1


def map_delta(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """checkout, path, change (added, removed, moved), oid of what differs between two file maps."""
    a = stored.select("checkout", "path", F.col("oid").alias("old"))
    b = scanned.select("checkout", "path", F.col("oid").alias("oid"))
    both = a.join(b, ["checkout", "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("oid")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("oid").isNull(), "removed").otherwise("moved")
    return both.select("checkout", "path", change.alias("change"), "oid")


def apply_delta(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """The new map: what didn't change, and what was added or moved."""
    kept = stored.join(delta.select("checkout", "path"), ["checkout", "path"], "left_anti")
    return kept.select("checkout", "path", "oid").unionByName(delta.where("change <> 'removed'").select("checkout", "path", "oid"))


def unchanged(stored_digest: DataFrame, scanned_digest: DataFrame) -> DataFrame:
    """checkout, same: whether a load has anything to do."""
    a, b = stored_digest.withColumnRenamed("digest", "old"), scanned_digest.withColumnRenamed("digest", "new")
    return a.join(b, "checkout", "full_outer").select("checkout", F.col("old").eqNullSafe(F.col("new")).alias("same"))


def overlay(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files with edits (checkout, path, oid; a null oid is a deleted file) laid over them, for one query."""
    base = files.join(edits.select("checkout", "path"), ["checkout", "path"], "left_anti").select("checkout", "path", "oid")
    return base.unionByName(edits.where("oid IS NOT NULL").select("checkout", "path", "oid"))


def freshness(delta: DataFrame, most: int = MOST_CHANGES) -> DataFrame:
    """checkout, changes, stale: too many changes are not read in passing."""
    return delta.groupBy("checkout").agg(F.count("*").alias("changes")).withColumn("stale", F.col("changes") > most)


def stamp_unmapped(blobs: DataFrame, files: DataFrame, loose: DataFrame, now: Column) -> DataFrame:
    """oid, recorded_at of blobs that no file maps: an earlier stamp stays, a mapped blob loses its own."""
    unmapped = blobs.select("oid").distinct().join(files.select("oid"), "oid", "left_anti")
    return unmapped.join(loose, "oid", "left").select("oid", F.coalesce("recorded_at", now).alias("recorded_at"))


def collectable(loose: DataFrame, now: Column, keep_days: int = KEEP_BLOB_DAYS) -> DataFrame:
    """Stamped blobs that have been loose for long enough."""
    return loose.where(F.col("recorded_at") < now - F.make_interval(days=F.lit(keep_days)))


def reachable_checkouts(checkouts: DataFrame, on_disk: DataFrame, gem_use: DataFrame) -> DataFrame:
    """Checkouts to keep: repositories on disk, gems on disk that a kept repository uses, and the rest of their kind on disk."""
    there = checkouts.join(on_disk.select("root"), "root", "left_semi")
    repos = there.where("kind = 'repo'")
    used = gem_use.join(repos.select(F.col("root").alias("checkout")), "checkout", "left_semi").select(F.col("gem_root").alias("root")).distinct()
    return repos.unionByName(there.where("kind = 'gem'").join(used, "root", "left_semi")).unionByName(there.where("kind NOT IN ('repo', 'gem')"))


def garbage(checkouts: DataFrame, on_disk: DataFrame, gem_use: DataFrame) -> DataFrame:
    """What a collection would drop; a dry run only counts it."""
    return checkouts.join(reachable_checkouts(checkouts, on_disk, gem_use).select("root"), "root", "left_anti")


def usage_daily(events: DataFrame, by: list[str], at: str = "ts") -> DataFrame:
    """Counts by day and key."""
    return events.groupBy(F.to_date(at).alias("day"), *by).agg(F.count("*").alias("n"))


def prune_usage(daily: DataFrame, today: Column, keep_days: int = KEEP_USAGE_DAYS) -> DataFrame:
    return daily.where(F.col("day") >= F.date_sub(today, keep_days))


def latency_histogram(events: DataFrame, milliseconds: Column, by: list[str]) -> DataFrame:
    return events.groupBy(*by, latency_bucket(milliseconds).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_quantile(histogram: DataFrame, by: list[str], order: Column, share: float) -> DataFrame:
    """For each group the first bucket at which the running count reaches the share."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by)
    rows = histogram.withColumn("at", order).withColumn("running", F.sum("n").over(w.orderBy("at"))).withColumn("total", F.sum("n").over(w))
    return rows.where(F.col("running") >= F.ceil(F.col("total") * share)).groupBy(*by).agg(F.min_by("bucket", "at").alias("bucket"))


def coverage(progress: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (checkout, confidence, ...) scaled by how much of a first load (checkout, read, of) is done."""
    share = F.when(F.col("of") > 0, F.col("read") / F.col("of")).otherwise(F.lit(1.0))
    rows = answers.join(progress.select("checkout", share.alias("share")), "checkout", "left")
    return rows.withColumn("confidence", F.round(F.col("confidence") * F.coalesce("share", F.lit(1.0)), 2)).drop("share")


def subtract(whole: DataFrame, part: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """whole without part: counts by key less those of the part, keys that fall to nothing left out."""
    less = part.groupBy(*keys).agg(*[F.sum(c).alias(f"less_{c}") for c in counts])
    rows = whole.join(less, keys, "left").select(*keys, *[(F.col(c) - F.coalesce(f"less_{c}", F.lit(0))).alias(c) for c in counts])
    return rows.where(" OR ".join(f"{c} <> 0" for c in counts))
