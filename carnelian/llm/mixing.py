"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source has a weight and a target in words; targets stop at CAP times what
the source holds, and what is above is shared out again by weight.  The mix is
a whole number of equal blocks of BLOCK words, but that the last block which a
limit allows may be short.  Blocks go to sources one at a
time by the highest quotient target / (2 * blocks + 1); within a source, the
blocks go to its shards by the same rule on the shards' sizes.  A shard is laid
end to end in an order seeded by document; its quota is the blocks from the
start of that order, around again if it is more than the shard.

Source totals (a row for each source) are summed before they reach the driver.
A source has a shard for every SHARD_WORDS words, at most MOST_SHARDS: a hot
source is spread over many tasks.  Only ids, sources and sizes are shuffled.

Defined cases: a null or empty text has size 0 and is never taken; a null
source is a source of its own, the last; a null id is ordered by its text's
hash like any other; equal rows are told apart by nothing, and their running
sums follow one another in either order, so the set of rows is the same in any
run.  An empty table gives no rows.  If nothing holds a word all targets are 0.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carnelian.llm.frames import documents, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the query's mix.
WEIGHTS, SHARE, CAP = (3, 1, 2), Fraction(3, 2), 2
BLOCK = 8
#: Words of a shard; a source has at most so many shards, which grow beyond that.
SHARD_WORDS, MOST_SHARDS = 200_000, 1 << 16
#: Most rows of a table (a row a source, or a shard) that is broadcast.
MOST_BROADCAST = 200_000
SEED = 20240229


def targets(sizes: list[int], weights: list[int], total: Fraction, cap: int = CAP) -> list[Fraction]:
    """Shares of total by weight, none above cap times its size; the excess goes to the rest by weight."""
    out = [Fraction(0)] * len(sizes)
    free, left = list(range(len(sizes))), Fraction(total)
    while free:
        weight = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] > cap * sizes[i] * weight]
        if not above:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = Fraction(cap * sizes[i])
        left -= sum(out[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return out


def sainte_lague(seats: int, votes: list, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 * seats held + 1); ties go to the earlier; most: a limit for each.

    Starts from what each surely gets, so the number of steps doesn't grow with
    the seats: no quotient rounds by more than a half, so of S seats n parties
    leave a share q at least q * (1 - n / 2S) - 1/2, or its limit.  Seats that
    limits set free are shared out in the same way."""
    most = most or [seats] * len(votes)
    held = [0] * len(votes)
    active = [i for i, v in enumerate(votes) if v > 0 and most[i] > 0]
    moved = True
    while active and moved:
        moved = False
        pool = seats - sum(held) + sum(held[i] for i in active)
        total = sum(Fraction(votes[i]) for i in active)
        rate = (pool - Fraction(len(active), 2)) / total
        for i in active:
            sure = min(most[i], math.floor(rate * votes[i] - Fraction(1, 2)))
            if sure > held[i]:
                held[i], moved = sure, True
        active = [i for i in active if held[i] < most[i]]
    heap = [(-Fraction(votes[i]) / (2 * held[i] + 1), i) for i in active]
    heapq.heapify(heap)
    left = seats - sum(held)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        held[i] += 1
        left -= 1
        if held[i] < most[i]:
            heapq.heappush(heap, (-Fraction(votes[i]) / (2 * held[i] + 1), i))
    return held


def sized(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, source, size, shard order."""
    return df.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.lit(SEED), F.col(id_column), F.col(text_column)).alias("turn"),
    )


def plan(totals: list[tuple], weights: tuple = WEIGHTS, share: Fraction = SHARE, cap: int = CAP, block: int = BLOCK) -> list[tuple]:
    """(source, size, target, blocks, shards) for (source, size) in their order."""
    sizes = [n for _, n in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), cap)
    total = sum(goal)
    seats = max(int(total / block + Fraction(1, 2)), min(1, math.ceil(total)))
    blocks = sainte_lague(seats, goal, [-(-cap * n // block) for n in sizes])
    shards = [min(MOST_SHARDS, max(1, n // SHARD_WORDS)) for n in sizes]
    return [(name, n, float(t), b, s) for (name, n), t, b, s in zip(totals, goal, blocks, shards, strict=True)]


def _quotas(block: int, cap: int):
    """For the shards of one source (source_key, shard, words, blocks): blocks of each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        held = sainte_lague(int(rows["blocks"].iloc[0]), rows["words"].tolist(), [-(-cap * int(w) // block) for w in rows["words"]])
        return pd.DataFrame({"source_key": rows["source_key"].to_numpy(), "shard": rows["shard"].to_numpy(), "shard_words": rows["words"].to_numpy(), "quota": [min(h * block, cap * int(w)) for h, w in zip(held, rows["words"], strict=True)]})

    return run


def mix_sources(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple = WEIGHTS, share: Fraction = SHARE, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of df."""
    spark = df.sparkSession
    rows = stored(sized(df, id_column, text_column, source_column))
    totals = [(r.source, r.n) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
    table = [(i, *row) for i, row in enumerate(plan(totals, weights, share, cap, block))]
    sources = spark.createDataFrame(table, "source_key int, source_name string, source_size bigint, target double, blocks bigint, shards int")
    # a row for each source
    sources = F.broadcast(sources) if len(table) <= MOST_BROADCAST else sources
    placed = rows.join(sources, F.col("source").eqNullSafe(F.col("source_name"))).withColumn("shard", F.pmod(F.xxhash64("turn"), F.col("shards")).cast("int"))
    words = placed.groupBy("source_key", "shard", "blocks").agg(F.sum("size").alias("words"))
    quotas = words.groupBy("source_key").applyInPandas(_quotas(block, cap), "source_key int, shard int, shard_words bigint, quota bigint")
    order = Window.partitionBy("source_key", "shard").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    known = stored(quotas.withColumnsRenamed({"source_key": "k", "shard": "s"}))
    known = F.broadcast(known) if sum(row[-1] for row in table) <= MOST_BROADCAST else known
    out = laid.join(known, (F.col("source_key") == F.col("k")) & (F.col("shard") == F.col("s")), "left")
    around = F.floor(F.col("quota") / F.greatest(F.col("shard_words"), F.lit(1)))
    rest = F.col("quota") - around * F.col("shard_words")
    taken = F.coalesce(around * F.col("size") + F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size")), F.lit(0)).cast("bigint")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("source")


QUERIES = {"op4_source_mixing": op4_source_mixing}
