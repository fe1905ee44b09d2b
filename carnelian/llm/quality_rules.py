"""Quality rules, and a log-likelihood ratio of hashed n-grams beside them.

Words and word pairs are hashed into BUCKETS buckets.  One scan counts the
buckets over all documents (the raw corpus) and over trusted documents (those
labelled good); a second one scores every document by the mean log ratio of the
two multinomials over its n-grams.  A document is kept if it passes the rules
and its score is THRESHOLD at least: a fixed number of nats an n-gram, so that
the decision on a text depends on nothing but the text and the two counts.

Counts are summed in each task before the shuffle, and the ratios (one number a
bucket, 512 KB) are all that is broadcast.  The trusted labels that take part
are bounded: the MOST_TRUSTED good ones that come first by a hash of their id.

Defined cases: a null or empty text has no words, so it fails the rules; rows
repeated in the input come out repeated; without labels every ratio is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.llm.frames import broadcast, documents, first_by_hash, text_bytes
from carnelian.llm.text import Slice, Words, mix, ngrams, slices, words

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
MOST_TRUSTED = 20_000
#: Added to a bucket's trusted count and to the count expected there, so that rare n-grams say little.
SMOOTHING = 20.0
#: n-grams with a ratio of 0 that are added to each document, so that a few words decide nothing.
SHRINK = 10
THRESHOLD = -0.1

#: Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 10, 20
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_NOT_CHARS = _SPACE + bytes(range(0x80, 0xC0))


def buckets(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and word pair of a slice."""
    pairs, at = ngrams(found, 2)
    hashes = np.concatenate([mix(found.hashes, 7), pairs])
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate([found.rows, found.rows[at]])


def repeated_words(found: Words, n_rows: int, window: int = 5) -> np.ndarray:
    """By row: words in windows that the text holds twice or more."""
    grams, at = ngrams(found, window)
    if not len(grams):
        return np.zeros(n_rows, dtype=np.int64)
    keys = mix(grams ^ (found.rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 11)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(found.hashes) + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    return np.bincount(found.rows[np.cumsum(edge[:-1]) > 0], minlength=n_rows)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, out = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            out += 1
        elif line.strip():
            seen.add(line)
    return out


def rules(part: Slice, found: Words) -> dict[str, np.ndarray]:
    texts = [part.text(r) for r in range(len(part))]
    out = {
        "n_words": found.counts(),
        "word_chars": [len(t.translate(None, _NOT_CHARS)) for t in texts],
        "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
        "n_dup_lines": [repeated_lines(t) for t in texts],
        "n_repeat_words": repeated_words(found, len(part)),
    }
    out = {k: np.asarray(v, dtype=np.int64) for k, v in out.items()}
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
    return out


def trusted_ids(labels: DataFrame, id_column: str = "doc_id", quality_column: str = "quality", most: int = MOST_TRUSTED) -> list:
    """Ids of good labels: all, or the first of them by a hash of the id."""
    good = labels.where((F.col(quality_column) == 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id")).distinct()
    return [r.id for r in first_by_hash(good.withColumn("group", F.lit(1)), most).collect()]


def log_ratios(df: DataFrame, trusted: list, id_column: str = "doc_id", text_column: str = "text", smoothing: float = SMOOTHING) -> np.ndarray:
    """log p(bucket | trusted) - log p(bucket | all rows), smoothed, from one scan of df."""
    chosen = broadcast(df.sparkSession, frozenset(trusted))

    def run(batches):
        ids, total = chosen.value, np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            good = np.array([i in ids for i in batch.column("id").to_pylist()], dtype=bool)
            for part in slices(batch.column("text")):
                bucket, row = buckets(words(part, folded=False))
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[good[part.at : part.at + len(part)][row]], minlength=BUCKETS)
        full = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[0][full]), pa.array(total[1][full])], ["bucket", "n_raw", "n_trusted"])

    counted = df.select(F.col(id_column).alias("id"), text_bytes(text_column)).mapInArrow(run, "bucket bigint, n_raw bigint, n_trusted bigint")
    counts = np.zeros((2, BUCKETS))
    for row in counted.groupBy("bucket").agg(F.sum("n_raw").alias("a"), F.sum("n_trusted").alias("b")).toLocalIterator():
        counts[0, row.bucket], counts[1, row.bucket] = row.a, row.b
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    expected = counts[0] * (counts[1].sum() / counts[0].sum())
    return np.log((counts[1] + smoothing) / (expected + smoothing))


def judge(df: DataFrame, ratios: np.ndarray, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, shrink: int = SHRINK) -> DataFrame:
    """The rules, the score and the verdict for every row of df, in one scan without a shuffle."""
    sent, kind = broadcast(df.sparkSession, ratios), df.schema[id_column].dataType.simpleString()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

    def run(batches):
        weight = sent.value
        for batch in batches:
            out: dict[str, list] = {name: [] for name in (*names, "score")}
            for part in slices(batch.column("text")):
                found = words(part, folded=False)
                for name, values in rules(part, found).items():
                    out[name].append(values)
                bucket, row = buckets(found)
                n = np.bincount(row, minlength=len(part))
                out["score"].append(np.bincount(row, weights=weight[bucket], minlength=len(part)) / (n + shrink))
            done = {name: np.concatenate(values) for name, values in out.items()}
            kept = ~done["base_failed"] & (done["score"] >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(done[n]) for n in names), pa.array(kept), pa.array(done["score"])], ["doc_id", *names, "kept", "llr_score"])

    schema = f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, llr_score double"
    return df.select(F.col(id_column).alias("id"), text_bytes(text_column)).mapInArrow(run, schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir)
    return judge(df, log_ratios(df, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))))


QUERIES = {"op7_quality_rules": op7_quality_rules}
