"""Facts beside the files that have their blob, against plain loops."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from carnelian.operators import relational as R

FILES = [(f"b{k % 3}", f"src{k % 2}", f"lib/{k}.rb") for k in range(60)] + [("b9", "src0", "lib/9.rb"), (None, "src0", "lib/none.rb")]
#: One blob has most facts; some stand twice; one has no file, one no blob, one no name.
FACTS = [("b0", f"A{k % 4}::Q{k % 5}", k // 2, k % 7) for k in range(80)] + [("b1", "A::Q3", 1, 1)] * 3 + [("b7", "Q3", 1, 1), (None, "Q3", 1, 1), ("b2", None, 2, 2)]


@pytest.fixture(params=[7, R.ROWS_OF_A_PART])
def part(request, monkeypatch):
    monkeypatch.setattr(R, "ROWS_OF_A_PART", request.param)
    return request.param


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(FACTS, "oid string, name string, line int, col int"), spark.createDataFrame(FILES, "oid string, checkout string, path string")


def beside(facts):
    return Counter((c, p, *f[1:]) for f in facts for o, c, p in FILES if f[0] is not None and f[0] == o)


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_mentions_of_one_blob_are_made_by_several_tasks(spark, tables, part):
    facts, files = tables
    got = R.mentions(facts.where("oid = 'b0'").limit(0), facts, files)
    want = beside([(o, n, "ref", line, col) for o, n, line, col in FACTS])
    assert Counter(map(tuple, got.collect())) == want
    if part == 7:
        assert tasks(got.where("path LIKE 'lib/%' AND name LIKE 'A%::Q%' AND line > 1")) > 1
    both = R.mentions(facts, facts, files, "A::Q3")
    assert Counter(r.what for r in both.collect()) == {"def": 60, "ref": 60}


def test_references_by_their_last_segment_are_made_by_several_tasks(spark, tables, part):
    _, files = tables
    refs = FACTS + [("b0", n, 9, 9) for n in ("Q3", "::Q3", "A:::Q3", "AQ3", "A::Q3::B", "A::Q3::", "")]
    got = R.const_refs_ending(spark.createDataFrame(refs, "oid string, name string, line int, col int"), files, "Q3")
    meant = [f for f in refs if f[1] is not None and f[1] in {"Q3", "::Q3", "A::Q3", *(f"A{k}::Q3" for k in range(4))}]
    assert Counter(map(tuple, got.collect())) == beside(meant)
    if part == 7:
        assert tasks(got.where("name <> 'A::Q3'")) > 1
