"""Queries beside their SQL, on the smallest tables where they are there."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table):
    """Rows as text, floats to six places, columns by name."""
    names = sorted(table[0]) if table else []
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted(str([plain(r[n]) for n in names]) for r in table)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_registered_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from carnelian.plans.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert set(ORACLES) <= set(QUERIES)
    wrong = []
    for name, sql in ORACLES.items():
        got = rows([r.asDict() for r in QUERIES[name](spark, SF).collect()])
        result = con.execute(sql)
        columns = [d[0] for d in result.description]
        want = rows([dict(zip(columns, r, strict=True)) for r in result.fetchall()])
        if got != want:
            wrong.append((name, len(got), len(want), got[:2], want[:2]))
    assert not wrong, wrong
