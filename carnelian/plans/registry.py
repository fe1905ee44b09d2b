"""Queries of the engine by name, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carnelian.plans import files_queries, graph_queries, program_queries, relational_queries, ruby_queries, streaming_queries

_MODULES = [relational_queries, graph_queries, program_queries, files_queries, ruby_queries, streaming_queries]
QUERIES: dict = {}
ORACLES: dict = {}
for _module in _MODULES:
    QUERIES |= {name: run for name, run in _module.QUERIES.items() if name not in getattr(_module, "COVERED", ())}
    ORACLES |= _module.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of methods of the tables' program, each judged by its receiver."""
    return program_queries.QUERIES["program_references"](spark, sf_dir)
