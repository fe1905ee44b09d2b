"""Ways in which a library calls what no source calls, and evidence in names built at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carnelian.functions.scalars import camelize, shape_matches
from carnelian.operators.chains import exploded

#: Fixed values: (convention, ancestor that a class must have, pattern of the names that the library calls).
RULES = (
    ("test method", "Minitest::Test", "^test_"), ("test method", "ActiveSupport::TestCase", "^test_"), ("test method", "Test::Unit::TestCase", "^test_"),
    ("command of a Thor class", "Thor", "^[a-z]"), ("command of a Thor group", "Thor::Group", "^[a-z]"),
    ("job", "ApplicationJob", "^perform$"), ("job", "ActiveJob::Base", "^perform$"), ("worker", "Sidekiq::Worker", "^perform$"), ("worker", "Sidekiq::Job", "^perform$"),
    ("serializer attribute", "ActiveModel::Serializer", "^include_.*\\?$"), ("migration", "ActiveRecord::Migration", "^(up|down|change)$"), ("validator", "ActiveModel::EachValidator", "^validate_each$"),
    ("validator", "ActiveModel::Validator", "^validate$"), ("channel", "ApplicationCable::Channel", "^(subscribed|unsubscribed)$"), ("component", "ViewComponent::Base", "^(call|before_render|render\\?)$"),
)


def by_library(methods: DataFrame, chains: DataFrame, rules: DataFrame) -> DataFrame:
    """checkout, owner, name, convention of public methods that a library runs.

    rules: convention, ancestor, pattern; a caller may add rows.  An ancestor counts
    where the chain holds it or couldn't resolve it."""
    held = chains.where("side = 'instance'").select("checkout", F.col("fqn").alias("owner"), F.explode(F.array_distinct(F.concat(F.transform("chain", lambda x: x["owner"]), "unresolved"))).alias("ancestor"))
    classes = held.join(F.broadcast(rules), "ancestor")
    return methods.where("side = 'instance' AND visibility = 'public'").select("checkout", "owner", "name").distinct().join(classes, ["checkout", "owner"]).where(F.call_function("rlike", F.col("name"), F.col("pattern"))).select("checkout", "owner", "name", "convention").distinct()


def default_rules(spark) -> DataFrame:
    return spark.createDataFrame(list(RULES), "convention string, ancestor string, pattern string")


def policies(methods: DataFrame, authorizing: DataFrame) -> DataFrame:
    """checkout, owner, name of a policy's predicates that a controller's action of the same stem asks.

    authorizing: checkout, controller, action."""
    asked = authorizing.select("checkout", F.concat(F.regexp_replace(F.regexp_replace("controller", "Controller$", ""), "s$", ""), F.lit("Policy")).alias("owner"), F.concat("action", F.lit("?")).alias("name"))
    return methods.where("side = 'instance' AND visibility = 'public'").select("checkout", "owner", "name").join(asked, ["checkout", "owner", "name"], "left_semi").distinct()


def attribute_writers(methods: DataFrame, chains: DataFrame) -> DataFrame:
    """checkout, owner, name of public writers on what takes a hash of attributes: a caveat, not a call."""
    takers = chains.where("side = 'instance'").where(F.array_contains(F.concat(F.transform("chain", lambda x: x["owner"]), "unresolved"), "ActiveRecord::Base") | F.array_contains(F.col("unresolved"), "ActiveModel::AttributeAssignment")).select("checkout", F.col("fqn").alias("owner"))
    return methods.where("side = 'instance' AND visibility = 'public' AND name RLIKE '[a-z]=$'").select("checkout", "owner", "name").distinct().join(takers, ["checkout", "owner"], "left_semi")


def built_shapes(files: DataFrame) -> DataFrame:
    """checkout, path, line, shape of interpolated symbols and of interpolated strings that are sent or called by name."""
    lines = files.select("checkout", "path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("n", "text"))
    symbol = F.regexp_extract_all("text", F.lit(r''':"([^"]*#\{[^"]*)"'''), F.lit(1))
    sent = F.regexp_extract_all("text", F.lit(r'''\b(?:send|public_send|__send__|method|respond_to\?|define_method|const_get|constantize)[\s(]+"([^"]*#\{[^"]*)"'''), F.lit(1))
    rows = lines.select("checkout", "path", (F.col("n") + 1).alias("line"), F.explode(F.concat(symbol, sent)).alias("text"))
    return rows.select("checkout", "path", "line", F.regexp_replace("text", r"#\{[^}]*\}", "*").alias("shape")).distinct()


def hedged(methods: DataFrame, shapes: DataFrame) -> DataFrame:
    """checkout, owner, name, shape of methods that a name built at run time could be.

    A shape of stars alone says nothing and is left out, so the shapes are few."""
    telling = F.broadcast(shapes.where(~F.col("shape").rlike(r"^\**$")).select("checkout", "shape").distinct())
    names = methods.select("checkout", "name").distinct().join(telling, "checkout").where(shape_matches(F.col("shape"), F.col("name")))
    return methods.select("checkout", "owner", "name").distinct().join(names, ["checkout", "name"])


def constants_named(files: DataFrame, names: DataFrame) -> DataFrame:
    """checkout, fqn, path, line, how of constants that a string or a symbol names, as written or in snake case."""
    lines = files.select("checkout", "path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("n", "text"))
    quoted = lines.select("checkout", "path", (F.col("n") + 1).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(r"""["']([A-Z]\w*(?:::[A-Z]\w*)*)["']"""), F.lit(1))).alias("fqn"), F.lit("string").alias("how"))
    symbols = lines.select("checkout", "path", (F.col("n") + 1).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(r":([a-z_]\w*)"), F.lit(1))).alias("word")).select("checkout", "path", "line", camelize(F.col("word")).alias("fqn"), F.lit("symbol").alias("how"))
    return quoted.unionByName(symbols).join(names.select("checkout", "fqn"), ["checkout", "fqn"], "left_semi").distinct()


def api_names(names: DataFrame, files: DataFrame) -> DataFrame:
    """checkout, fqn of what a library's lib offers: outside tests, in a checkout that isn't an application."""
    app = files.where(F.col("path").rlike(r"^(config/application\.rb|config\.ru)$|^app/")).select("checkout").distinct()
    site = F.element_at("sites", 1)["path"]
    return names.where(F.size("sites") > 0).where(site.rlike("^lib/")).join(app, "checkout", "left_anti").select("checkout", "fqn")


def computed_sends(calls: DataFrame, chains: DataFrame, own_checkouts: DataFrame) -> DataFrame:
    """checkout, fqn of classes below an ancestor outside the checkout that sends names it computes.

    calls: checkout, scopes, name, computed.  Methods of such a class may be called by it."""
    senders = calls.where("computed").select("checkout", F.element_at("scopes", 1).alias("owner")).join(own_checkouts, "checkout", "left_anti").select("owner").distinct()
    return exploded(chains.where("side = 'instance'")).join(senders, "owner", "left_semi").select("checkout", "fqn").distinct()
