"""Queries that go over whole tables, against counts in Python."""

import pytest

from carnelian.plans import graph_queries as G
from carnelian.plans import relational_queries as Q


@pytest.fixture
def tables(spark, monkeypatch):
    made = {}
    for module in (Q, G):
        monkeypatch.setattr(module, "table", lambda s, d, name: made[name], raising=False)

    def put(name, rows, schema):
        made[name] = spark.createDataFrame(rows, schema)

    return put


def test_checkout_status_counts_every_document(spark, tables, monkeypatch):
    tables("documents", [(i, f"text {i % 9}", "en", "src1") for i in range(30)], "doc_id bigint, text string, lang string, source string")
    monkeypatch.setattr(Q, "checkouts", lambda s, d: spark.createDataFrame([("src1", "app"), ("src2", "gem")], "root string, kind string"))
    got = {r.root: (r.files, r.blobs) for r in Q.checkout_status_whole(spark, "").collect()}
    assert got == {"src1": (30, 9), "src2": (0, 0)}


def test_graph_queries_read_all_rows(spark, tables):
    lines = [(k, n, 1 + k % 3, 10 * n, k % 5) for k in range(1, 40) for n in range(1, 8)]
    tables("lineitem", lines, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_quantity int, l_partkey bigint")
    tables("orders", [(k, k % 3) for k in range(1, 60)], "o_orderkey bigint, o_custkey bigint")
    tables("part", [(k, k % 4) for k in range(80)], "p_partkey bigint, p_size int")
    tables("pages", [(k, f"https://h{k}/a/b") for k in range(1, 10)], "page_id bigint, url string")

    edges = {(f"P{k % 40}", f"{'K' if k % 3 == 0 else 'P'}{k % 40 + 1 + (k % 4) % 2}") for k in range(80)}
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    assert {(r.module, r.mixer) for r in G.mixers_closure_whole(spark, "").collect()} == {x for x in reach if x[1].startswith("K")}

    want = {}
    for call, customer in ((k, k % 3) for k in range(1, 60)):
        held = [(n * 7, -(k % 200), f"m{k}") for k, n, supplier, _, _ in lines if supplier == customer % 100 + 1 and k % 200 <= call % 250 <= k % 200 + n * 7]
        if held:
            want[call] = (min(held)[2], -min(held)[1])
    assert {r.call: (r.def_name, r.def_line) for r in G.enclosing_method_whole(spark, "").collect()} == want

    spans = [(k * 10 + n, supplier, k % 200) for k, n, supplier, _, _ in lines]
    count = {i: sum(s == t and a <= i * 7 % 200 <= a + 9 and i != j for j, t, a in spans) for i, s, _ in spans}
    assert {r.id: r.n for r in G.candidate_callers_whole(spark, "").collect()} == {i: n for i, n in count.items() if n}
    assert {r.q for r in G.dead_tiers_whole(spark, "").collect()} == set(range(5))
    assert {r.page_id: r.shared for r in G.nearest_by_directory_whole(spark, "").collect()} == dict.fromkeys(range(1, 10), 1)
