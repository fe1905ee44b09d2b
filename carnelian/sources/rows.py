"""Readers of one file's text as rows, spread over a DataFrame of files."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def read_rows(files: DataFrame, schema: str, reader: Callable[[bytes], list[dict]]) -> DataFrame:
    """checkout, path and the reader's columns for every row that it finds in a file (checkout, path, content)."""
    full = f"checkout string, path string, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(full))

    def run(batches):
        for batch in batches:
            rows = []
            for checkout, path, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows += [{"checkout": checkout, "path": path} | row for row in reader(content or b"")]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("checkout", "path", "content").mapInArrow(run, full)
