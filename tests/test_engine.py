import pytest
from pyspark.sql import functions as F

from carnelian.api import Index
from carnelian.functions import scalars as S
from carnelian.operators import references as P
from carnelian.operators.chains import Graph
from carnelian.sources.checkouts import from_rows


def graph(kinds, parents=None, mixins=None):
    return Graph(kinds, parents or {}, {}, mixins or {})


def test_prepends_come_before_and_later_includes_first():
    g = graph({"A": "class", "M": "module", "N": "module", "P": "module", "Object": "class"}, {}, {"A": [("include", "M"), ("include", "N"), ("prepend", "P")]})
    assert g.instance("A") == ["P", "A", "N", "M", "Object"]


def test_an_include_known_to_the_parent_is_not_repeated_but_a_prepend_is():
    kinds = {"A": "class", "B": "class", "M": "module", "Object": "class"}
    assert graph(kinds, {"B": "A"}, {"A": [("include", "M")], "B": [("include", "M")]}).instance("B") == ["B", "A", "M", "Object"]
    assert graph(kinds, {"B": "A"}, {"A": [("include", "M")], "B": [("prepend", "M")]}).instance("B") == ["M", "B", "A", "M", "Object"]


def test_prepending_again_brings_to_the_front():
    g = graph({"A": "class", "M": "module", "N": "module", "Object": "class"}, {}, {"N": [("prepend", "M")], "A": [("prepend", "M"), ("prepend", "N")]})
    assert g.instance("A") == ["M", "N", "A", "Object"]


def test_cycles_end():
    g = graph({"A": "module", "B": "module"}, {}, {"A": [("include", "B")], "B": [("include", "A")]})
    assert g.instance("A") == ["A", "B"] and g.instance("B") == ["B", "A"]
    loop = graph({"A": "class", "B": "class"}, {"A": "B", "B": "A"})
    assert loop.instance("A") == ["A", "B"]


def test_class_side():
    g = graph({"A": "class", "B": "class", "E": "module", "Class": "class", "Module": "class", "Object": "class"}, {"B": "A", "Class": "Module", "Module": "Object"}, {"A": [("extend", "E")]})
    assert g.class_side("B")[:4] == [("B", "class"), ("A", "class"), ("E", "instance"), ("Object", "class")]


PROGRAM = [
    ("app", "app/widget.rb", "class Widget\n  include Saves\n  def save(x = nil); touch; end\n  def touch; end\n  def unused; end\n  private\n  def hidden; end\nend\nclass Gadget\n  def save; super; end\nend\nmodule Saves\n  def store; save; end\nend\nclass Small < Widget\n  def save(x = nil); super; end\nend\n"),
    ("app", "app/use.rb", "module Shop\n  class Runner\n    def run(flag)\n      w = Widget.new\n      w.save\n      g = Gadget.new\n      g.save\n      thing.save\n      w = flag ? Gadget.new : w\n      Small.new.save(1)\n      thing.touch(1, 2)\n    end\n  end\n  module Inner::Deep\n    X = Widget\n    X.new.touch\n  end\n  module Inner; end\nend\n"),
    ("app", "spec/widget_spec.rb", "Widget.new.store\nWidget.new(1).unused\n"),
]


@pytest.fixture(scope="module")
def index(spark):
    return Index(spark, from_rows(spark, PROGRAM))


def test_compact_paths_are_placed(index):
    assert {r.fqn for r in index.paths.collect()} >= {"Shop::Inner::Deep", "Shop::Runner"}
    assert index.aliases.where("fqn = 'Shop::Inner::Deep::X'").first().namespace == "Widget"


def test_references_are_narrowed_by_receiver(index):
    got = {(r.path, r.line): (r.tier, r.why) for r in index.references(["Widget#save"]).collect()}
    assert got["app/use.rb", 5][0] == "confirmed"
    assert got["app/use.rb", 7] == ("excluded", "different_owner")
    assert got["app/use.rb", 8][0] == "possible"
    assert got["app/widget.rb", 13] == ("possible", "a subclass may run it")
    assert got["app/widget.rb", 16] == ("confirmed", "super")
    counts = P.counts(index.references(["Widget#save"]), ["query"]).first()
    assert (counts.confirmed, counts.possible, counts.excluded) == (2, 2, 3)


def test_receiver_through_an_alias(index):
    got = {(r.path, r.line): r.tier for r in index.references(["Widget#touch"]).collect()}
    assert got == {("app/widget.rb", 3): "confirmed", ("app/use.rb", 16): "confirmed", ("app/use.rb", 11): "excluded"}
    assert P.counts(index.references(["Widget#touch"]), ["query"]).first().arity == 1


def test_dead_code(index):
    got = {r["query"]: r.tier for r in index.dead_methods().collect()}
    assert got["Widget#unused"] == "test-only" and got["Widget#hidden"] == "unreferenced" and got["Saves#store"] == "test-only"
    assert "Widget#save" not in got
    assert {r.fqn for r in index.dead_constants().collect()} >= {"Shop::Runner"}


def test_answers(index):
    rows = {(r.path, r.line, r.name): r for r in index.answers().collect()}
    assert rows["app/use.rb", 5, "save"].def_line == 3 and rows["app/use.rb", 5, "save"].status == "resolved"
    assert rows["app/use.rb", 8, "save"].status == "residue"


def test_null_arguments_never_exclude(spark):
    rows = spark.createDataFrame([([("req", "a")], None), ([("req", "a")], 0), ([("req", "a")], 1), ([("req", "a"), ("key", "b")], 2), ([("opt", "a")], 3), (None, 5)], "params array<struct<kind: string, name: string>>, argc int")
    assert [r.f for r in rows.select(S.accepts(F.col("params"), F.col("argc")).alias("f")).collect()] == [True, False, True, True, True, True]


def test_inflection_agrees_with_extraction(spark):
    from carnelian.extract.macros import singular

    words = ["orders", "companies", "boxes", "people", "children", "statuses", "wolves", "series", "buses", "movies", "indices", "analyses", "news", "order_lines", "quizzes"]
    got = [r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select(S.singular(F.col("w")).alias("s")).collect()]
    assert got == [singular(w) for w in words]
    assert got[:7] == ["order", "company", "box", "person", "child", "status", "wolf"]


def test_git_oid(spark):
    import hashlib

    data = bytearray("é x".encode())
    row = spark.createDataFrame([(data,)], "c binary").select(S.git_oid(F.col("c")).alias("o")).first()
    assert row.o == hashlib.sha1(b"blob %d\0" % len(data) + bytes(data)).hexdigest()


def test_versions(spark):
    rows = spark.createDataFrame([("2.10.0", "2.9"), ("1.0.rc1", "1.0"), ("1.0", "1.0.0")], "a string, b string")
    got = [(r.x, r.y) for r in rows.select((S.version_key(F.col("a")) > S.version_key(F.col("b"))).alias("x"), (S.version_key(F.col("a")) < S.version_key(F.col("b"))).alias("y")).collect()]
    assert got[:2] == [(True, False), (False, True)]


def test_incremental_load_parses_a_content_once(spark):
    from carnelian.operators.extraction import unknown_blobs
    from carnelian.sources.checkouts import split_scan

    files, blobs = split_scan(from_rows(spark, [("a", "x.rb", "A = 1"), ("b", "y.rb", "A = 1"), ("a", "z.txt", "no")]))
    assert (files.count(), blobs.count()) == (2, 1)
    assert unknown_blobs(files, blobs, blobs.select("oid")).count() == 0


def test_every_ruby_query_runs_and_is_stable(spark):
    from carnelian.plans import ruby_queries as R

    for name in ("ruby_dead_methods", "ruby_definition_at", "spec_reads", "view_controllers", "ruby_delegates", "bundle_resolved"):
        first, again = (sorted(map(str, R.QUERIES[name](spark, "").collect())) for _ in range(2))
        assert first and first == again, name


def test_sample_answers(spark):
    from carnelian.plans import ruby_queries as R

    ix = R.index(spark)
    chains = {r.fqn: [x.owner for x in r.chain] for r in ix.chains.where("side = 'instance'").collect()}
    assert chains["SpecialOrder"] == ["Audited", "SpecialOrder", "Order", "Comparable", "Priced", "ApplicationRecord"]
    dead = {r["query"]: r.tier for r in ix.dead_methods().collect()}
    assert dead["OrdersController#index"] == "convention-only" and dead["OrdersController#orphan"] == "unreferenced" and dead["Search#never_called"] == "test-only"
    refs = {(r.path, r.line): r.tier for r in ix.references(["Charge#initialize"]).collect()}
    assert refs == {("app/models/order.rb", 23): "confirmed"}
    up = {(r.path, r.line): (r.tier, r.why) for r in ix.references(["Order#pay!"]).collect()}
    assert up["app/models/concerns/search.rb", 10] == ("confirmed", "super of every class mixing it in")
    unread = [r.name for r in R.spec_unread_members(spark, "").collect()]
    assert unread == ["unused"]
    (chosen,) = [r.version for r in R.bundle_resolved(spark, "").collect() if r.name == "tools"]
    assert chosen == "1.3.1"


def test_load_hooks_macros_and_splits(spark):
    from carnelian.plans import ruby_queries as R

    ix = R.index(spark)
    chains = {r.fqn: [x.owner for x in r.chain] for r in ix.chains.where("side = 'instance'").collect()}
    assert chains["Guest"][:3] == ["Guest", "Host", "Late"]
    assert [(r.owner, r.target) for r in ix.macro_mixins.collect()] == [("Guest", "Acting")]
    assert [(r.owner, r.variants) for r in R.ruby_conflicting_superclasses(spark, "").collect()] == [("Split", "Host Order")]
    assert {r.path: r.variant for r in R.ruby_nearest_variant(spark, "").collect()} == {"lib/x.rb": "Split@1", "app/models/y.rb": "Split@2", "config/z.rb": "Split"}


def test_an_application_with_its_gems_and_stubs(spark):
    scan = from_rows(
        spark,
        [
            ("app", "app/order.rb", "class Order < ActiveRecord::Base\n  def pay\n    Order.find(1).save\n    Money.new(2).round\n    puts 1\n  end\nend\n"),
            ("other", "x.rb", "class Money; def round; end; end\n"),
            ("/gems/money", "lib/money.rb", "class Money\n  def initialize(x); end\n  def round; end\n  def unused; end\nend\n"),
            ("/gems/far", "lib/far.rb", "class Far; end\n"),
        ],
    )
    checkouts = spark.createDataFrame([("app", "repo"), ("other", "repo"), ("/gems/money", "gem"), ("/gems/far", "gem")], "root string, kind string")
    ix = Index.of_applications(spark, scan, checkouts, spark.createDataFrame([("app", "/gems/money")], "checkout string, gem_root string"))
    got = {(r.line, r.name): (r.owner, r.def_path) for r in ix.answers().where("path = 'app/order.rb' AND owner IS NOT NULL").collect()}
    assert got[3, "find"] == ("ActiveRecord::Querying", "(stubs)/activerecord.rbi")
    assert got[3, "save"][0] == "ActiveRecord::Base" and got[5, "puts"][0] == "Kernel"
    assert got[4, "round"] == ("Money", "/gems/money/lib/money.rb") and got[4, "new"][1] == "/gems/money/lib/money.rb"
    assert ix.names.where("fqn = 'Far'").isEmpty()
    assert {r["query"] for r in ix.dead_methods().collect()} == {"Order#pay", "Money#round"}
    assert "/gems/money" not in str(ix.dead_constants().collect())


def test_grades_know_libraries_writers_and_built_names(spark):
    scan = from_rows(
        spark,
        [
            ("app", "app/job.rb", "class Send < ApplicationJob\n  def perform_now_or_later; end\n  def perform; end\nend\n"),
            ("app", "app/order.rb", "class Order < ActiveRecord::Base\n  def note=(x); end\n  def on_paid; end\n  def idle; end\nend\nclass Named; end\nclass Lone; end\n"),
            ("app", "app/run.rb", 'class Run\n  def go(what)\n    public_send("on_#{what}")\n    "Named".constantize\n  end\nend\nRun.new.go(1)\n'),
        ],
    )
    ix = Index(spark, scan)
    dead = {r["query"]: (r.tier, r.confidence, r.caveats) for r in ix.dead_methods().collect()}
    assert dead["Send#perform"][0] == "convention-only" and dead["Send#perform_now_or_later"][0] == "unreferenced"
    assert dead["Order#note="][1:] == ("lower", ["a hash of attributes may write it"])
    assert dead["Order#on_paid"][1:] == ("lower", ["a name built at run time fits: on_*"])
    assert dead["Order#idle"][1:] == ("clear", [])
    constants = {r.fqn: (r.confidence, r.caveats) for r in ix.dead_constants().collect()}
    assert constants["Named"] == ("lower", ["named by a string"]) and constants["Lone"] == ("clear", [])


def test_the_later_of_two_saves_of_a_path_wins(spark, tmp_path):
    import json

    from carnelian.sources.store import Store
    from carnelian.streaming.refresh import refresh, saved_files

    (tmp_path / "in").mkdir()
    saves = [("a", "x.rb", "A = 2", 2), ("a", "x.rb", "A = 1", 1), ("a", "y.rb", "B = 1", 1)]
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps(dict(zip(("checkout", "path", "text", "seq"), s))) for s in saves))
    store = Store(spark, f"file://{tmp_path}/store")
    refresh(store, saved_files(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/checkpoint").awaitTermination()
    from carnelian.sources.checkouts import split_scan

    want, _ = split_scan(from_rows(spark, [("a", "x.rb", "A = 2"), ("a", "y.rb", "B = 1")]))
    assert sorted(map(tuple, store.files().select("checkout", "path", "oid").collect())) == sorted(map(tuple, want.select("checkout", "path", "oid").collect()))
