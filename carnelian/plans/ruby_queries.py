"""Queries over source code itself: rows of the sample program, through the whole engine.

DuckDB can't parse Ruby, so these have no SQL beside them; tests hold them to
expected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.api import Index
from carnelian.operators import chains as C
from carnelian.operators import conventions, dead, positions, specs, views
from carnelian.operators import references as P
from carnelian.plans.sample import FILES, TEXTS
from carnelian.sources import bundles, dumps, routes, texts
from carnelian.sources.checkouts import from_rows, nearby, one_schema_an_app
from carnelian.sources.signatures import to_stubs

QUERIES: dict = {}
ORACLES: dict = {}
#: Those that program_queries and files_queries ask of the tables' own files, with SQL; the sample's stay for the tests.
COVERED = frozenset(
    [f"ruby_{x}" for x in ("definitions", "edges", "constant_references", "calls", "assignments", "reaching_writes", "syntax_errors", "names", "placed_edges", "chains", "aliases", "includers", "constants_resolved", "receivers", "answers", "residue", "references", "reference_counts", "dead_methods", "dead_constants", "dead_summary", "overrides", "call_hierarchy", "completion", "outline", "doc_comments", "requires", "workspace_symbols", "implementations", "load_order")]
    + ["schema_tables", "schema_attribute_methods", "schema_choice", "bundle_locked", "bundle_declared", "bundle_resolved", "signature_stubs", "route_actions", "view_words", "view_renderings", "yaml_names", "generated_files", "spec_reads", "spec_unread_members", "spec_unused_shared_groups", "spec_typed_members"]
)
_indexes: dict[str, Index] = {}


def index(spark: SparkSession) -> Index:
    """The sample's index, made once for a session."""
    key = spark.sparkContext.applicationId
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(spark, from_rows(spark, FILES))
    return _indexes[key]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _flat(df: DataFrame) -> DataFrame:
    """Arrays and structs as text, so that rows compare and sort plainly."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct")) else F.col(c) for c, t in df.dtypes])


def texts_of(spark: SparkSession) -> DataFrame:
    return from_rows(spark, TEXTS)


@query
def ruby_definitions(spark, sf_dir):
    return _flat(index(spark).placed_facts("defs").drop("oid"))


@query
def ruby_edges(spark, sf_dir):
    return _flat(index(spark).placed_facts("ancestry").drop("oid"))


@query
def ruby_constant_references(spark, sf_dir):
    return _flat(index(spark).placed_facts("const_refs").drop("oid"))


@query
def ruby_calls(spark, sf_dir):
    return _flat(index(spark).placed_facts("calls").drop("oid"))


@query
def ruby_assignments(spark, sf_dir):
    return _flat(index(spark).placed_facts("assigns").drop("oid"))


@query
def ruby_body_calls(spark, sf_dir):
    return _flat(index(spark).placed_facts("body_calls").drop("oid"))


@query
def ruby_reaching_writes(spark, sf_dir):
    return index(spark).placed_facts("reaching").drop("oid")


@query
def ruby_syntax_errors(spark, sf_dir):
    return index(spark).placed_facts("errors").drop("oid")


@query
def ruby_blob_digests(spark, sf_dir):
    return index(spark).wide.select("oid", "lines", "parse_errors", "surface", "namespace")


@query
def ruby_names(spark, sf_dir):
    return index(spark).names.select("checkout", "fqn", "kind", "target", F.size("sites").alias("sites"))


@query
def ruby_placed_edges(spark, sf_dir):
    return index(spark).edges.select("checkout", "owner", "relation", "target", "resolved")


@query
def ruby_chains(spark, sf_dir):
    return index(spark).chains.select("fqn", "side", F.array_join(F.transform("chain", lambda x: F.concat(x["owner"], F.when(x["side"] == "class", ".").otherwise("#"))), " ").alias("chain"), F.array_join("unresolved", " ").alias("unresolved"))


@query
def ruby_aliases(spark, sf_dir):
    return index(spark).aliases.where("fqn <> namespace")


@query
def ruby_includers(spark, sf_dir):
    ix = index(spark)
    return C.includers(ix.chains, ix.names).select("module", F.array_join("classes", " ").alias("classes"))


@query
def ruby_constants_resolved(spark, sf_dir):
    return index(spark).constants().select("path", "line", "col", "written", "fqn", "via", "scopes_tried", "confidence")


@query
def ruby_receivers(spark, sf_dir):
    ix = index(spark)
    return ix.receivers.join(ix.calls.select("call_id", "path", "line", "col", "name"), "call_id").drop("call_id")


@query
def ruby_answers(spark, sf_dir):
    return index(spark).answers().drop("call_id", "checkout")


@query
def ruby_includer_votes(spark, sf_dir):
    ix = index(spark)
    return ix.includer_votes().join(ix.calls.select("call_id", "path", "line", "name"), "call_id").drop("call_id")


@query
def ruby_delegates(spark, sf_dir):
    ix = index(spark)
    return ix.delegates().join(ix.calls.select("call_id", F.col("path").alias("at_path"), F.col("line").alias("at_line")), "call_id").drop("call_id")


@query
def ruby_dynamic_markers(spark, sf_dir):
    return index(spark).dynamic


@query
def ruby_residue(spark, sf_dir):
    ix = index(spark)
    asked = ix.calls.join(ix.receivers.select("call_id"), "call_id", "left_anti").withColumn("typed", F.lit(False))
    return P.residue(asked, ix.methods, ix.chains).join(ix.calls.select("call_id", F.col("path").alias("at_path"), F.col("line").alias("at_line"), "name"), "call_id").drop("call_id")


@query
def ruby_references(spark, sf_dir):
    return index(spark).references(["Order#total", "Order#pay!", "Charge#initialize", "Gate::Result#report", "SpecialOrder#total", "Order.import", "total"]).drop("call_id", "checkout")


@query
def ruby_reference_counts(spark, sf_dir):
    return P.counts(ruby_references(spark, sf_dir), ["query"])


@query
def ruby_dead_methods(spark, sf_dir):
    return _flat(index(spark).dead_methods())


@query
def ruby_dead_constants(spark, sf_dir):
    return index(spark).dead_constants()


@query
def ruby_dead_summary(spark, sf_dir):
    return dead.summary(index(spark).dead_methods().withColumn("kind", F.lit("method")))


@query
def ruby_entry_points(spark, sf_dir):
    ix = index(spark)
    return dead.entry_points(ix.methods, ix.chains)


@query
def ruby_overrides(spark, sf_dir):
    ix = index(spark)
    return P.overriding(ix.methods, ix.chains)


@query
def ruby_call_hierarchy(spark, sf_dir):
    ix = index(spark)
    return P.call_hierarchy(ix.references(["Order#total", "Order#pay!", "Charge#run"]), ix.placed_facts("defs"))


@query
def ruby_completion(spark, sf_dir):
    ix = index(spark)
    return P.complete(ix.chains, ix.methods, "SpecialOrder", "instance", "p")


@query
def ruby_outline(spark, sf_dir):
    return index(spark).symbols("app/models/order.rb")


@query
def ruby_card(spark, sf_dir):
    return _flat(index(spark).card("Order#total"))


@query
def ruby_doc_comments(spark, sf_dir):
    ix = index(spark)
    return texts.doc_above(from_rows(spark, FILES), ix.placed_facts("defs"))


@query
def ruby_return_vote(spark, sf_dir):
    return C.return_vote(index(spark).methods)


@query
def ruby_nearby_files(spark, sf_dir):
    ix = index(spark)
    wanted = ix.placed_facts("const_refs").select("checkout", "path", "name").distinct()
    return nearby(wanted, ix.files)


@query
def schema_tables(spark, sf_dir):
    rows = dumps.tables(from_rows(spark, FILES + TEXTS))
    return rows.select("path", "name", "line", F.array_join("primary_key", " ").alias("primary_key"), F.to_json("columns").alias("columns"), F.to_json("indexes").alias("indexes"))


@query
def schema_attribute_methods(spark, sf_dir):
    return dumps.attribute_methods(dumps.tables(from_rows(spark, FILES)))


@query
def schema_model_tables(spark, sf_dir):
    ix = index(spark)
    models = C.inherits(ix.names.where("kind = 'class'").select("checkout", "fqn", F.lit("ApplicationRecord").alias("ancestor")), ix.chains)
    return dumps.model_tables(models.withColumn("table_name", F.lit(None).cast("string")))


@query
def schema_choice(spark, sf_dir):
    files = from_rows(spark, FILES + TEXTS).select("checkout", "path", F.lit("x").alias("oid"))
    return one_schema_an_app(files).where("path LIKE 'db/%'").select("path")


@query
def bundle_locked(spark, sf_dir):
    return bundles.locked_gems(texts_of(spark))


@query
def bundle_declared(spark, sf_dir):
    return bundles.declared_gems(texts_of(spark)).select("path", "name", F.array_join("requirements", ", ").alias("requirements"))


@query
def bundle_resolved(spark, sf_dir):
    installed = spark.createDataFrame([("money", v, f"/gems/money-{v}") for v in ("1.9.0", "2.0.3", "2.1.0", "3.0.0")] + [("tools", v, f"/gems/tools-{v}") for v in ("1.2.0", "1.3.1", "2.0.0")] + [("base", "0.9", "/gems/base-0.9")], "name string, version string, root string")
    needs = spark.createDataFrame([("/gems/money-2.1.0", "tools", ["~> 1.2"]), ("/gems/tools-1.3.1", "base", [])], "root string, name string, requirements array<string>")
    return bundles.resolve(bundles.declared_gems(texts_of(spark)).select("checkout", "name", "requirements"), installed, needs)


@query
def signature_stubs(spark, sf_dir):
    from carnelian.sources.rows import read_rows

    rbs = texts_of(spark).where("path LIKE '%.rbs'")
    stubs = read_rows(rbs, "stub string", lambda content: [{"stub": to_stubs(content.decode())}])
    made = Index(spark, stubs.select("checkout", F.replace("path", F.lit(".rbs"), F.lit(".rbi")).alias("path"), F.col("stub").cast("binary").alias("content")))
    return made.placed_facts("defs").select("name", "kind", "singleton", "sig_returns", F.array_join(F.transform(F.coalesce("params", F.array().cast("array<struct<kind:string,name:string>>")), lambda p: p["kind"]), " ").alias("params"))


@query
def route_actions(spark, sf_dir):
    return routes.routes(from_rows(spark, FILES)).select("controller", "action", "line", "unread")


@query
def view_words(spark, sf_dir):
    return texts.words_of(from_rows(spark, FILES).where("path LIKE 'app/views/%'"))


@query
def yaml_names(spark, sf_dir):
    return texts.yaml_scalars(texts_of(spark))


@query
def generated_files(spark, sf_dir):
    rows = from_rows(spark, FILES + TEXTS)
    return rows.where(texts.is_generated(F.col("path"), F.col("content"))).select("path")


# -- places -------------------------------------------------------------------------
def _asked(spark):
    places = [("app/models/order.rb", 24, 28), ("app/models/order.rb", 18, 13), ("app/services/charge.rb", 10, 8), ("app/models/order.rb", 17, 6), ("app/models/special_order.rb", 1, 25), ("app/models/order.rb", 90, 1)]
    return spark.createDataFrame([("shop", *p) for p in places], "checkout string, path string, line int, col int")


def _found(spark):
    ix = index(spark)
    return positions.under(_asked(spark), *[ix.placed_facts(k) for k in ("defs", "const_refs", "calls", "assigns")])


@query
def ruby_under_cursor(spark, sf_dir):
    return _found(spark)


@query
def ruby_definition_at(spark, sf_dir):
    ix = index(spark)
    return positions.definitions_at(_found(spark), ix.answers(), ix.constants(), ix.names, ix.placed_facts("reaching"))


@query
def ruby_hover(spark, sf_dir):
    ix = index(spark)
    docs = texts.doc_above(from_rows(spark, FILES), ix.placed_facts("defs"))
    return positions.hover(ruby_definition_at(spark, sf_dir), docs, ix.methods)


@query
def ruby_instance_variables(spark, sf_dir):
    ix = index(spark)
    return positions.variable_mentions(ix.placed_facts("assigns"), ix.placed_facts("calls"), ix.placed_facts("reaching"), ix.paths)


@query
def ruby_local_variables(spark, sf_dir):
    ix = index(spark)
    return positions.local_mentions(ix.placed_facts("assigns"), ix.placed_facts("reaching"))


@query
def ruby_requires(spark, sf_dir):
    ix = index(spark)
    path = spark.createDataFrame([("shop", 0, "lib", "repo"), ("shop", 1, "spec", "repo"), ("shop", 2, "", "stdlib")], "checkout string, ord int, dir string, kind string")
    return positions.resolve_requires(positions.requires(from_rows(spark, FILES)), ix.files, path)


@query
def ruby_workspace_symbols(spark, sf_dir):
    return positions.workspace_symbols(index(spark).placed_facts("defs"), "or")


@query
def ruby_implementations(spark, sf_dir):
    ix = index(spark)
    return positions.implementations(ix.chains, ix.methods, "Order", "total")


# -- specs --------------------------------------------------------------------------
def _specs(spark):
    files = from_rows(spark, FILES)
    return specs.groups(files), specs.members(files), specs.reads(files), specs.includes(files)


@query
def spec_reads(spark, sf_dir):
    g, m, r, i = _specs(spark)
    return specs.answered(r, m, g, i)


@query
def spec_unread_members(spark, sf_dir):
    g, m, r, i = _specs(spark)
    return specs.unread(m, specs.answered(r, m, g, i))


@query
def spec_unused_shared_groups(spark, sf_dir):
    g, _, _, i = _specs(spark)
    return specs.unused_shared(g, i)


@query
def spec_typed_members(spark, sf_dir):
    g, m, _, _ = _specs(spark)
    return specs.typed_members(m, g, index(spark).names)


# -- templates -----------------------------------------------------------------------
@query
def view_renderings(spark, sf_dir):
    files = from_rows(spark, FILES)
    return views.rendered(views.renderings(files), views.templates(files))


@query
def view_controllers(spark, sf_dir):
    files, ix = from_rows(spark, FILES), index(spark)
    made = views.templates(files)
    return views.reached_from(views.rendered(views.renderings(files), made), views.actions_of(made, ix.methods))


@query
def view_instance_variables(spark, sf_dir):
    from carnelian.operators.receivers import settle_values

    files, ix = from_rows(spark, FILES), index(spark)
    assigns = ix.placed_facts("assigns").withColumn("assign_id", F.xxhash64("checkout", "path", "line", "col", "target"))
    settled = settle_values(assigns, ix.scopes, ix.names, ix.chains, ix.methods)
    writes = assigns.join(settled.where("side = 'instance'").select("assign_id", "fqn"), "assign_id", "left").join(ix.paths.select("checkout", F.col("path").alias("nesting"), F.col("fqn").alias("owner")), ["checkout", "nesting"]).select("checkout", "owner", "target", "fqn")
    found = views.view_variables(ix.calls, view_controllers(spark, sf_dir), writes)
    return found.join(ix.calls.select("call_id", "path", "line", "name", "recv_text"), "call_id").drop("call_id")


@query
def view_helpers(spark, sf_dir):
    ix = index(spark)
    return views.helpers(ix.names, ix.files)


# -- conventions ------------------------------------------------------------------------
@query
def convention_methods(spark, sf_dir):
    ix = index(spark)
    return conventions.by_library(ix.methods, ix.chains, conventions.default_rules(spark))


@query
def convention_writers(spark, sf_dir):
    ix = index(spark)
    return conventions.attribute_writers(ix.methods, ix.chains)


@query
def built_names(spark, sf_dir):
    return conventions.hedged(index(spark).methods, conventions.built_shapes(from_rows(spark, FILES)))


@query
def constants_in_text(spark, sf_dir):
    return conventions.constants_named(from_rows(spark, FILES), index(spark).own_names)


# -- assembly ---------------------------------------------------------------------------
@query
def ruby_macro_mixins(spark, sf_dir):
    return index(spark).macro_mixins


@query
def ruby_conflicting_superclasses(spark, sf_dir):
    return index(spark).conflicts.select("checkout", "owner", F.array_join("variants", " ").alias("variants"))


@query
def ruby_nearest_variant(spark, sf_dir):
    from carnelian.operators.namespace import nearest_variant

    variants = spark.createDataFrame([("shop", "Split", "Split@1", "lib/one.rb"), ("shop", "Split", "Split@2", "app/models/two.rb")], "checkout string, name string, variant string, path string")
    asked = spark.createDataFrame([("shop", "Split", p) for p in ("lib/x.rb", "app/models/y.rb", "config/z.rb")], "checkout string, name string, path string")
    return nearest_variant(asked, variants)


@query
def ruby_load_order(spark, sf_dir):
    from carnelian.sources.checkouts import load_order

    ix = index(spark)
    return load_order(ix.files, ["app/models/order.rb"], ix.checkouts.select(F.col("root").alias("checkout"), "kind")).select("path", "batch")


@query
def ruby_explained(spark, sf_dir):
    """Every reference as a line of text."""
    rows = ruby_references(spark, sf_dir)
    return rows.select(F.concat_ws(" ", F.concat("path", F.lit(":"), "line", F.lit(":"), "col"), "tier", F.concat(F.lit("("), "why", F.lit(")")), F.concat(F.lit("via "), "via")).alias("text"), "query")
