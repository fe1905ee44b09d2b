"""The corpus pipeline: five stages from raw documents to a mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the
caller writes and reads again as the docs of the next one.  All but the last
return the columns of docs.

1. language: documents whose language can't be told (no letter, or a posterior
   below LEAST_POSTERIOR) go.
2. near duplicates: of each group of texts that share words in four fifths of
   their five-word shingles, the one with the smallest id stays.
3. decontamination: passages of the benchmark are cut out; documents that
   consist of them for the most part go.
4. secrets: credentials that only their owner's documents hold are masked.
5. mixing: how many words of each document the mix takes.

Nulls: a null text is rejected in the first stage.  An empty table passes
through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.llm import decontaminate, language, mixing, near_duplicates, secrets
from carnelian.llm.frames import documents, stored
from carnelian.plans.shipping import ship

LEAST_POSTERIOR = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = language.learn_model(docs, language.not_held_out("doc_id"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    judged = language.identify(docs, model, [F.col(c) for c in docs.columns], schema)
    return judged.where((F.col("lang_pred") != language.UNDECIDED) & (F.col("score") >= LEAST_POSTERIOR)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_duplicates.keep_one(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_owned_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix_sources(docs)


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("secrets", mask_owned_secrets),
    ("mixing", mix),
]

#: Similarity joins, automata and seeded selection are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict = {}
