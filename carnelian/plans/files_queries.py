"""Queries over files that aren't plain Ruby, made from the rows of nation, with SQL for what stands in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.api import Index
from carnelian.operators import positions, specs, views
from carnelian.plans.program import filled
from carnelian.sources import bundles, dumps, routes, texts
from carnelian.sources.checkouts import one_schema_an_app
from carnelian.sources.rows import read_rows
from carnelian.sources.signatures import to_stubs

QUERIES: dict = {}
ORACLES: dict = {}
CHECKOUT = "ports"

#: Path and content of the files of each nation.
FILES = {
    "n{n}/db/schema.rb": """ActiveRecord::Schema.define(version: 1) do
  create_table "n{n}_depots", force: :cascade do |t|
    t.string "name"
    t.integer "nation_id", null: false
    t.index ["nation_id"], name: "i{n}"
  end
end
""",
    "n{n}/db/structure.sql": """CREATE TABLE public.n{n}_depots (
    id bigint NOT NULL
);
""",
    "other{n}/db/structure.sql": """-- a dump
CREATE TABLE public.n{n}_ports (
    id bigint NOT NULL,
    label character varying
);
""",
    "n{n}/Gemfile.lock": """GEM
  remote: https://rubygems.org/
  specs:
    gem{n} (1.{r})
    tool{n} (2.0.{n})
      gem{n} (>= 1)
""",
    "n{n}/Gemfile": """gem "gem{n}", "~> 1.{r}", ">= 1.0"
gem "plain{n}"
""",
    "n{n}/config/routes.rb": """Rails.application.routes.draw do
  resources :port{n}s, only: [:index, :show]
  get "/ping{n}", to: "ping{n}#up"
end
""",
    "n{n}/config/jobs.yml": """job: Worker{n}
list:
  - run_{n}
  - 12
""",
    "app/views/n{n}/show.html.erb": """<%= render "card" %>
<p>word{n} word{n}</p>
""",
    "app/views/n{n}/_card.html.erb": """card{n}
""",
    "lib/n{n}/main.rb": """require_relative "part"
require "n{n}/part"
require "missing{n}"
""",
    "lib/n{n}/part.rb": """# Part of {n}.
# It is small.
class Part{n}
end
""",
    "generated/n{n}.rb": """x = 1
""",
    "lib/made{n}.rb": """# auto-generated by a tool
x = 1
""",
    "spec/n{n}_spec.rb": """RSpec.describe Part{n} do
  let(:part) { Part{n}.new }
  let(:idle) { 1 }

  it "works" do
    part
  end
end
""",
    "spec/support/lone{n}_spec.rb": """RSpec.shared_examples "lone{n}" do
  it { true }
end
""",
    "sig/n{n}.rbs": """class Port{n}
  def size: () -> Integer
  def self.open: (String, ?Integer) -> Port{n}
end
""",
}


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """checkout, path, content of all files."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    marks = {"n": "n_nationkey", "r": "n_regionkey"}
    each = F.explode(F.array(*[F.struct(filled(path, **marks).alias("path"), filled(text, **marks).alias("text")) for path, text in FILES.items()]))
    return nation.select(each.alias("f")).select(F.lit(CHECKOUT).alias("checkout"), "f.path", F.col("f.text").cast("binary").alias("content"))


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(scan(spark, sf_dir))
        ORACLES[f.__name__] = f"WITH nat AS (SELECT n_nationkey AS n, n_regionkey AS r, 'n' || n_nationkey AS d FROM nation) {sql}"
        return f

    return register


@query("SELECT d || '/db/schema.rb' AS path, d || '_depots' AS name, 2 AS line, 'id:Integer name:String nation_id:Integer' AS columns FROM nat UNION ALL SELECT d || '/db/structure.sql', d || '_depots', 1, 'id:Integer' FROM nat UNION ALL SELECT 'other' || n || '/db/structure.sql', d || '_ports', 2, 'id:Integer label:String' FROM nat")
def files_schema_tables(files):
    return dumps.tables(files).select("path", "name", "line", F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(":"), c["class"])), " ").alias("columns"))


@query("SELECT path FROM (SELECT unnest([d || '/db/schema.rb', 'other' || n || '/db/structure.sql']) AS path FROM nat)")
def files_schema_choice(files):
    return one_schema_an_app(files).where("path LIKE '%/db/%'").select("path")


@query(
    """SELECT 'N' || n || 'Depot' AS owner, replace(m, '{}', c) AS name, CASE WHEN m = '{}' THEN k END AS returns
FROM nat, (SELECT unnest(['id', 'name', 'nation_id']) AS c, unnest(['Integer', 'String', 'Integer']) AS k), (SELECT unnest(['{}', '{}=', '{}?', '{}_changed?', '{}_was', '{}_previously_changed?', '{}_before_last_save', 'saved_change_to_{}?', 'will_save_change_to_{}?']) AS m)"""
)
def files_attribute_methods(files):
    return dumps.attribute_methods(dumps.tables(files.where("path LIKE '%/schema.rb'"))).select("owner", "name", "returns")


@query("SELECT d || '/Gemfile.lock' AS path, 'gem' || n AS name, '1.' || r AS version, 'gem' AS source FROM nat UNION ALL SELECT d || '/Gemfile.lock', 'tool' || n, '2.0.' || n, 'gem' FROM nat")
def files_locked_gems(files):
    return bundles.locked_gems(files).select("path", "name", "version", "source")


@query("SELECT d || '/Gemfile' AS path, 'gem' || n AS name, '~> 1.' || r || ', >= 1.0' AS requirements FROM nat UNION ALL SELECT d || '/Gemfile', 'plain' || n, '' FROM nat")
def files_declared_gems(files):
    return bundles.declared_gems(files).select("path", "name", F.array_join("requirements", ", ").alias("requirements"))


@query("SELECT 'gem' || n AS name, '1.' || (r + 2) AS version, '/gems/gem' || n || '-1.' || (r + 2) AS root FROM nat UNION ALL SELECT 'plain' || n, '3.0', '/gems/plain' || n || '-3.0' FROM nat UNION ALL SELECT 'base' || n, '0.9', '/gems/base' || n || '-0.9' FROM nat")
def files_resolved_gems(files):
    """The highest installed version that meets what is declared, and what its own gems need."""
    gems = bundles.declared_gems(files).select("checkout", "name", "requirements")
    have = gems.where("name LIKE 'gem%'").select("name", F.regexp_extract(F.array_join("requirements", " "), r"1\.(\d+)", 1).cast("int").alias("r"), F.regexp_replace("name", "gem", "").alias("n"))
    version = lambda k: F.concat(F.lit("1."), (F.col("r") + k).cast("string"))
    own = have.select("name", F.explode(F.array(version(0), version(2), version(1), F.lit("2.0"), F.lit("0.5"))).alias("version"))
    plain = have.select(F.concat(F.lit("plain"), "n").alias("name"), F.explode(F.array(F.lit("3.0"), F.lit("2.9"))).alias("version"))
    base = have.select(F.concat(F.lit("base"), "n").alias("name"), F.explode(F.array(F.lit("0.9"), F.lit("1.0"))).alias("version"))
    root = F.concat(F.lit("/gems/"), "name", F.lit("-"), "version")
    installed = own.unionByName(plain).unionByName(base).withColumn("root", root)
    needs = have.select(F.concat(F.lit("/gems/"), "name", F.lit("-"), version(2)).alias("root"), F.concat(F.lit("base"), "n").alias("name"), F.array(F.lit("< 1")).alias("requirements"))
    return bundles.resolve(gems, installed, needs).select("name", "version", "root")


@query("SELECT 'Port' || n || 'sController' AS controller, a AS action, 2 AS line FROM nat, (SELECT unnest(['index', 'show']) AS a) UNION ALL SELECT 'Ping' || n || 'Controller', 'up', 3 FROM nat")
def files_route_actions(files):
    return routes.routes(files).select("controller", "action", "line")


@query("SELECT d || '/config/jobs.yml' AS path, unnest(['Worker' || n, 'run_' || n]) AS value FROM nat")
def files_yaml_names(files):
    return texts.yaml_scalars(files).select("path", "value")


@query("SELECT 'app/views/' || d || '/_card.html.erb' AS path, 'card' || n AS word, CAST(1 AS BIGINT) AS n FROM nat UNION ALL SELECT 'app/views/' || d || '/show.html.erb', unnest(['render', 'card', 'p', 'word' || n]), unnest([1, 1, 2, 2]) FROM nat")
def files_view_words(files):
    return texts.words_of(files.where("path LIKE 'app/views/%'")).select("path", "word", "n")


@query("SELECT 'app/views/' || d || '/show.html.erb' AS path, 1 AS line, '_card' AS wanted, 'app/views/' || d || '/_card.html.erb' AS template FROM nat")
def files_view_renderings(files):
    return views.rendered(views.renderings(files), views.templates(files)).select("path", "line", "wanted", "template")


@query(
    """SELECT 'lib/' || d || '/main.rb' AS path, 1 AS line, 'resolved' AS status, 'lib/' || d || '/part.rb' AS file FROM nat
UNION ALL SELECT 'lib/' || d || '/main.rb', 2, 'resolved', 'lib/' || d || '/part.rb' FROM nat UNION ALL SELECT 'lib/' || d || '/main.rb', 3, 'residue', NULL FROM nat"""
)
def files_requires(files):
    path = files.sparkSession.createDataFrame([(CHECKOUT, 0, "lib", "repo"), (CHECKOUT, 1, "", "stdlib")], "checkout string, ord int, dir string, kind string")
    return positions.resolve_requires(positions.requires(files), files.select("checkout", "path"), path).select("path", "line", "status", "file")


@query("SELECT 'Part' || n AS name, 'Part of ' || n || '.' || chr(10) || 'It is small.' AS doc FROM nat")
def files_doc_comments(files):
    part = files.where("path LIKE '%/part.rb'")
    return texts.doc_above(part, Index(files.sparkSession, part).placed_facts("defs")).select("name", "doc")


@query("SELECT unnest(['generated/' || d || '.rb', 'lib/made' || n || '.rb']) AS path FROM nat")
def files_generated(files):
    return files.where(texts.is_generated(F.col("path"), F.col("content"))).select("path")


def _specs(files):
    return specs.groups(files), specs.members(files), specs.reads(files), specs.includes(files)


@query("SELECT 'spec/' || d || '_spec.rb' AS path, 'part' AS name, 6 AS line, 'confirmed' AS tier, 'own' AS source, 2 AS member_line FROM nat")
def files_spec_reads(files):
    g, m, r, i = _specs(files)
    return specs.answered(r, m, g, i).select("path", "name", "line", "tier", "source", "member_line")


@query("SELECT 'spec/' || d || '_spec.rb' AS path, 'idle' AS name, 3 AS line, 'unreferenced' AS tier, 'lower' AS confidence FROM nat")
def files_spec_unread_members(files):
    g, m, r, i = _specs(files)
    return specs.unread(m, specs.answered(r, m, g, i)).select("path", "name", "line", "tier", "confidence")


@query("SELECT 'spec/support/lone' || n || '_spec.rb' AS path, 'lone' || n AS described, 1 AS line FROM nat")
def files_unused_shared_groups(files):
    g, _, _, i = _specs(files)
    return specs.unused_shared(g, i).select("path", "described", "line")


@query("SELECT 'spec/' || d || '_spec.rb' AS path, unnest(['part', 'subject']) AS name, 'Part' || n AS fqn, 1.0::DOUBLE AS confidence FROM nat")
def files_spec_typed_members(files):
    g, m, _, _ = _specs(files)
    names = Index(files.sparkSession, files.where("path LIKE '%/part.rb'")).own_names
    return specs.typed_members(m, g, names).select("path", "name", "fqn", "confidence")


@query("SELECT 'Port' || n AS name, 'class' AS kind, false AS singleton, NULL AS sig_returns, '' AS params FROM nat UNION ALL SELECT 'size', 'method', false, 'Integer', '' FROM nat UNION ALL SELECT 'open', 'method', true, 'Port' || n, 'req opt' FROM nat")
def files_signature_stubs(files):
    stubs = read_rows(files.where("path LIKE '%.rbs'"), "stub string", lambda content: [{"stub": to_stubs(content.decode())}])
    made = Index(files.sparkSession, stubs.select("checkout", F.replace("path", F.lit(".rbs"), F.lit(".rbi")).alias("path"), F.col("stub").cast("binary").alias("content")))
    params = F.array_join(F.transform(F.coalesce("params", F.array().cast("array<struct<kind:string,name:string>>")), lambda p: p["kind"]), " ")
    return made.placed_facts("defs").select("name", "kind", "singleton", "sig_returns", params.alias("params"))


@query(
    """SELECT path, batch FROM (
  SELECT unnest([d || '/db/schema.rb', d || '/db/structure.sql', 'other' || n || '/db/structure.sql', d || '/Gemfile.lock', d || '/Gemfile', d || '/config/routes.rb', d || '/config/jobs.yml', 'app/views/' || d || '/show.html.erb',
    'app/views/' || d || '/_card.html.erb', 'lib/' || d || '/main.rb', 'lib/' || d || '/part.rb', 'generated/' || d || '.rb', 'lib/made' || n || '.rb', 'spec/' || d || '_spec.rb', 'spec/support/lone' || n || '_spec.rb', 'sig/' || d || '.rbs']) AS path FROM nat),
  LATERAL (SELECT CASE WHEN path = 'lib/n3/part.rb' THEN 0 WHEN path LIKE 'lib/n3/%' THEN 1 ELSE 2 END AS batch)"""
)
def files_load_order(files):
    from carnelian.sources.checkouts import load_order

    roots = files.sparkSession.createDataFrame([(CHECKOUT, "repo")], "checkout string, kind string")
    return load_order(files.select("checkout", "path"), ["lib/n3/part.rb"], roots).select("path", "batch")
