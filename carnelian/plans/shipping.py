"""Making a session ready: the package on every executor, and batches that fit long texts."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import carnelian

_shipped: set[str] = set()
#: Rows of an Arrow batch: whole texts are rows, and each of a task's copies of a batch counts.
BATCH_ROWS = 2_000


def archive() -> str:
    """The package's modules as a zip file on the driver, named after their contents."""
    top = os.path.dirname(os.path.abspath(carnelian.__file__))
    files = sorted(os.path.join(d, n) for d, _, names in os.walk(top) for n in names if n.endswith(".py"))
    contents = [(os.path.join("carnelian", os.path.relpath(f, top)), open(f, "rb").read()) for f in files]
    name = hashlib.sha1(b"".join(n.encode() + b"\0" + c for n, c in contents)).hexdigest()[:16]
    path = os.path.join(tempfile.mkdtemp(prefix="carnelian-"), f"carnelian-{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for n, c in contents:
            out.writestr(n, c)
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Hands the package to the session's executors, once for each application; Spark's own file server serves it.

    A smaller number of rows a batch that the session has is left alone."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.sparkContext.applicationId not in _shipped:
        spark.sparkContext.addPyFile(archive())
        _shipped.add(spark.sparkContext.applicationId)
    return spark
