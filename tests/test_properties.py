"""Properties that hold for any input."""

import string

from hypothesis import given, settings
from hypothesis import strategies as st

from carnelian.extract.facts import extract
from carnelian.extract.flow import union
from carnelian.operators.chains import Graph
from carnelian.sources import bundles, dumps, signatures
from carnelian.sources.readers import erb_to_ruby


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=200))
def test_readers_survive_any_bytes(data):
    extract(data)
    assert len(erb_to_ruby(data)) == len(data)
    dumps.ruby_tables(data)
    dumps.sql_tables(data)
    bundles.lockfile(data)
    bundles.declared(data)
    signatures.to_stubs(data.decode("utf-8", "replace"))


names = st.sampled_from(list("ABCDEFG"))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(names, names, max_size=6), st.dictionaries(names, st.lists(st.tuples(st.sampled_from(["include", "prepend", "extend"]), names), max_size=4), max_size=6))
def test_chains_end_and_hold_their_own_name(parents, mixins):
    graph = Graph({n: "class" for n in "ABCDEFG"}, {k: v for k, v in parents.items() if k != v}, {}, mixins)
    for n in "ABCDEFG":
        chain = graph.instance(n)
        assert n in chain and len(chain) < 2000
        side = graph.class_side(n)
        assert len(side) == len(set(side)) and (n, "class") in side


@given(st.dictionaries(st.text(string.ascii_lowercase, max_size=2), st.frozensets(st.integers(0, 9)), max_size=4), st.dictionaries(st.text(string.ascii_lowercase, max_size=2), st.frozensets(st.integers(0, 9)), max_size=4))
def test_states_unite_in_any_order(a, b):
    assert union(a, b) == union(b, a) and union(a, a) == a
