import random

import pytest

from carnelian.extract.facts import extract
from carnelian.extract.ruby import parse
from carnelian.sources import bundles, dumps, signatures
from carnelian.sources.readers import erb_to_ruby, haml_to_ruby


def defs(source):
    return {(r["name"], r["singleton"]): r for r in extract(source.encode())["defs"]}


def test_names_carry_nesting_kind_and_visibility():
    got = defs("module A::B\n class C < D\n  def x; end\n  private\n  def y=(v); end\n  class << self\n   def z; end\n  end\n end\nend")
    assert got["A::B", False]["kind"] == "module"
    assert got["x", False]["nesting"] == ["C", "A::B"]
    assert got["y=", False]["visibility"] == "private"
    assert got["z", True]["kind"] == "method"


def test_every_kind_of_parameter():
    (row,) = [r for r in extract(b"def m(a, (b, c), d = 1, *e, f, g:, h: 2, **i, &j); end")["defs"]]
    assert [p["kind"] for p in row["params"]] == ["req", "req", "opt", "rest", "post", "keyreq", "key", "keyrest", "block"]


def test_macros_make_methods():
    got = defs("class W\n attr_accessor :a\n belongs_to :owner\n has_many :cats, class_name: 'Pet'\n scope :live, -> { x }\n enum :state, { on: 1 }, prefix: true\n delegate :n, to: :owner, prefix: true\n Point = Struct.new(:x)\nend")
    for name in ("a", "a=", "owner", "build_owner", "cats", "cat_ids", "state_on?", "owner_n", "x", "x="):
        assert (name, False) in got, name
    assert ("live", True) in got and got["owner", False]["sig_returns"] == "Owner"


def test_calls_know_their_receiver_and_count():
    calls = {r["name"]: r for r in extract(b"class A\n def m(x)\n  w = B.new(1, 2)\n  w.go(*x)\n  @i.stop a: 1\n  each(&:sym)\n  super\n end\nend")["calls"]}
    assert (calls["new"]["recv"], calls["new"]["recv_text"], calls["new"]["argc"]) == ("const", "B", 2)
    assert calls["go"]["recv"] == "local" and calls["go"]["argc"] is None
    assert calls["stop"]["recv"] == "ivar" and calls["stop"]["argc"] == 1
    assert calls["sym"]["symbol"] and calls["m"]["recv"] == "super"


def test_edges_in_bodies_and_sent():
    rows = [(r["relation"], r["target"], r["owner"][0]) for r in extract(b"class A < B\n include C, D\n class << self\n  include E\n end\nend\nA.prepend(F)\nA.send(:include, G)")["ancestry"]]
    assert rows == [("superclass", "B", "A"), ("include", "D", "A"), ("include", "C", "A"), ("extend", "E", "A"), ("prepend", "F", "(sent A)"), ("include", "G", "(sent A)")]


def test_writes_that_reach_a_read():
    source = b"def m(f)\n  a = 1\n  a = 2 if f\n  p(a)\n  while f\n    q(a)\n    a = 3\n  end\n  begin\n    a = 4\n  rescue\n    r(a)\n  end\nend"
    reach = {}
    for r in extract(source)["reaching"]:
        reach.setdefault(r["read_line"], set()).add(r["write_line"])
    assert reach[4] == {2, 3} and reach[6] == {2, 3, 7} and reach[12] == {2, 3, 4, 7, 10} - {4}


@pytest.mark.parametrize(
    "source",
    ["x = <<~A + <<-'B'\n a #{b}\nA\n c\n B\ny", "foo /a b/, 1\nx = y / 2 / z", "a ? b : c ? :d : 'e'", "m a, *b, **c, &d do |(x, y), z: 1| end", "p(<<~S)\n  #{[1, \"#{2}\"].map { |v| v }}\nS\n", "return if x\n%i[a b].each { |s| t[s] ||= u&.v }", "case [1, {a: 2}]\nin [Integer, {a: Integer => n}] if n then n\nelse nil\nend", "def a = 1\ndef b(x) = x + a\ndef ==(o) = true\ndef !; end", "->(a, b = 1) { a }.(1)\nf = lambda do |x| x end", "a, (b, *c), d = 1, [2, 3], 4\nwhile (l = gets) do puts l end", "if a then b elsif c then d else e end\nunless x; y; end\nbegin; z; end until q", "alias $new $old\nundef a, :b\nBEGIN { x }\n__END__\ngarbage ((("],
)
def test_reads_without_errors(source):
    assert parse(source.encode())[1].errors == []


def test_survives_any_bytes():
    random.seed(3)
    pieces = [b"def ", b"end\n", b"class A", b"(", b")", b"{", b"}", b"do |x|", b"#{", b'"', b"'", b"%w[", b"<<~T\n", b"\xff\xfe", b"\x00", b"if ", b"::", b"=>", b"\n", b"1", b"a.b", b":s", b"/", b"?"]
    for _ in range(300):
        facts = extract(b"".join(random.choice(pieces) for _ in range(random.randint(0, 40))))
        assert set(facts) >= {"defs", "calls"}
    assert extract(b"(" * 5000)["errors"]


def test_errors_are_counted_and_the_rest_is_read():
    facts = extract(b"class A\n def a(\n x = ]\nend\nclass B\n def ok; end\nend")
    assert facts["errors"] and any(r["name"] == "ok" for r in facts["defs"])


def test_templates_keep_places():
    erb = erb_to_ruby(b"<p><%= a.b %></p>\n<% c.each do |x| %><%# no %><%= x %><% end %>")
    assert len(erb) == len(b"<p><%= a.b %></p>\n<% c.each do |x| %><%# no %><%= x %><% end %>")
    assert {(r["name"], r["line"], r["col"]) for r in extract(erb)["calls"]} >= {("b", 1, 10), ("each", 2, 6)}
    assert {r["name"] for r in extract(haml_to_ruby(b"%h1= title\n- list.each do |x|\n  %p= x.name\n- if ok?\n  yes\n- else\n  = other"))["calls"]} >= {"title", "each", "name", "ok?", "other"}


def test_dumps():
    (users, posts) = dumps.sql_tables(b"-- dump\nCREATE TABLE public.users (\n    id bigint NOT NULL,\n    email character varying(255) DEFAULT ''::character varying NOT NULL,\n    price numeric(10,2),\n    tags text[]\n);\nALTER TABLE ONLY public.users ADD CONSTRAINT users_pkey PRIMARY KEY (id);\nCREATE UNIQUE INDEX i ON public.users USING btree (email);\nCREATE TABLE `posts` (`id` int(11) NOT NULL AUTO_INCREMENT, `flag` tinyint(1) DEFAULT NULL, PRIMARY KEY (`id`), KEY `k` (`flag`)) ENGINE=InnoDB;")
    assert users["primary_key"] == ["id"] and [(c["sql_type"], c["class"], c["nullable"]) for c in users["columns"]] == [("bigint", "Integer", False), ("string", "String", False), ("decimal", "BigDecimal", True), ("text", "Array", True)]
    assert users["indexes"] == [{"columns": ["email"], "unique": True}]
    assert posts["primary_key"] == ["id"] and [c["class"] for c in posts["columns"]] == ["Integer", None]
    (t,) = dumps.ruby_tables(b'create_table "ws" do |t|\n t.string "a", null: false\n t.references :b\n t.timestamps\nend\nadd_index "ws", ["a"], unique: true')
    assert [c["name"] for c in t["columns"]] == ["id", "a", "b_id", "created_at", "updated_at"] and t["indexes"][0]["unique"]


def test_bundles_and_signatures():
    assert [g["version"] for g in bundles.lockfile(b"GEM\n  specs:\n    a (1.2)\n      b (>= 1)\n    c (2.0-x86_64-linux)\n")] == ["1.2", "2.0"]
    stub = signatures.to_stubs("class A < B\n  def x: (Integer n, ?k: String) -> Foo\n  def self.y: () { () -> void } -> (A | B)\nend")
    got = defs(stub)
    assert got["x", False]["sig_returns"] == "Foo" and got["y", True]["sig_returns"] is None


def test_source_in_strings_is_read_at_its_place():
    got = defs("class A\n  class_eval <<~RUBY\n    def made(x)\n      x\n    end\n  RUBY\n  B.class_eval 'def other; end'\nend")
    assert (got["made", False]["line"], got["made", False]["col"], got["made", False]["nesting"]) == (3, 9, ["A"])
    assert got["other", False]["nesting"] == ["B", "A"]


def test_readers_return_what_every_write_makes():
    got = defs("class A\n attr_reader :a, :b\n def initialize\n  @a = X.new\n  @b = X.new\n end\n def set; @b = 1; end\nend")
    assert got["a", False]["sig_returns"] == "X" and got["b", False]["sig_returns"] is None


def test_mixins_in_macros_are_marked():
    rows = [(r["relation"], r["target"]) for r in extract(b"module M\n def self.acts(x)\n  include Acting\n end\nend")["ancestry"]]
    assert rows == [("macro", "include|acts|Acting")]
