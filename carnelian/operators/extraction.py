"""Blobs to fact tables: one pass of the parser over blobs that aren't known yet."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from carnelian import schema
from carnelian.extract.facts import KINDS, digest, extract
from carnelian.sources.readers import to_ruby

_ROWS = {
    "defs": schema.DEFS, "ancestry": schema.ANCESTRY, "const_refs": schema.CONST_REFS, "calls": schema.CALLS, "assigns": schema.ASSIGNS,
    "body_calls": schema.BODY_CALL, "reaching": schema.REACHING, "errors": "oid string, message string, line int, col int",
}


def _struct(kind: str) -> str:
    ddl = _ROWS[kind].split(",", 1)[1]
    out, depth, name = "", 0, True
    for c in ddl.strip():
        if name and c == " ":
            out, name = out + ": ", False
            continue
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out, name = out + ", ", None
            continue
        if name is None:
            if c == " ":
                continue
            name = True
        out += c
    return f"array<struct<{out}>>"


WIDE = "oid string, lines int, parse_errors int, surface bigint, namespace bigint, " + ", ".join(f"{k} {_struct(k)}" for k in KINDS)


def extract_blobs(blobs: DataFrame, macros: list | None = None) -> DataFrame:
    """One wide row for each blob (oid, content, reader): an array of rows for each kind of fact.

    macros: the table of class macros, which a caller may have added to."""
    arrow = to_arrow_schema(StructType.fromDDL(WIDE))

    def run(batches):
        for batch in batches:
            rows = []
            for oid, content, reader in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                source = to_ruby(content or b"", reader)
                facts = extract(source, macros)
                rows.append({"oid": oid, "lines": (content or b"").count(b"\n") + 1, "parse_errors": len(facts["errors"]), "surface": digest(facts), "namespace": digest(facts, True)} | facts)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return blobs.select("oid", "content", "reader").mapInArrow(run, WIDE)


def facts(wide: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind, in its schema."""
    return wide.select("oid", F.inline(kind))


def call_names(wide: DataFrame) -> DataFrame:
    """The posting list, counted within each blob before any shuffle."""
    from carnelian.operators.relational import posting_list

    return posting_list(facts(wide, "calls"))


def unknown_blobs(files: DataFrame, blobs: DataFrame, known: DataFrame) -> DataFrame:
    """Blobs to parse: each content once, and only if no facts of it are held."""
    return blobs.dropDuplicates(["oid"]).join(files.select("oid").distinct(), "oid", "left_semi").join(known.select("oid"), "oid", "left_anti")
