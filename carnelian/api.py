"""An index of checkouts, and the questions that it answers as DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.operators import chains as C
from carnelian.operators import conventions, dead, extraction, namespace, receivers, references, relational
from carnelian.plans.lineage import cut
from carnelian.sources.checkouts import compose, split_scan
from carnelian.sources.routes import routes
from carnelian.sources.stubs import with_stubs

#: Names that every program has, with the edges between them.
CORE = (("BasicObject", "class"), ("Object", "class"), ("Module", "class"), ("Class", "class"), ("Kernel", "module"), ("Comparable", "module"), ("Enumerable", "module"), ("Struct", "class"))
CORE_SUPERCLASS = (("Object", "BasicObject"), ("Module", "Object"), ("Class", "Module"), ("Struct", "Object"))


class Index:
    """Facts of a scan (checkout, path, content), and what is derived from them, each once."""

    def __init__(self, spark: SparkSession, scan: DataFrame, checkouts: DataFrame | None = None, macros: list | None = None):
        self.spark = spark
        self.scan = scan
        self.files, self.blobs = split_scan(scan)
        roots = scan.select(F.col("checkout").alias("root")).distinct()
        self.checkouts = checkouts if checkouts is not None else roots.select("root", F.lit("repo").alias("kind"))
        self.wide = cut(extraction.extract_blobs(self.blobs, macros))

    @classmethod
    def of_applications(cls, spark: SparkSession, scan: DataFrame, checkouts: DataFrame, gem_use: DataFrame, stubs: bool = True, macros: list | None = None) -> Index:
        """An index of every application among the checkouts (root, kind), each with its gems, the standard library and stubs."""
        if stubs:
            scan, checkouts = with_stubs(spark, scan, checkouts)
        return cls(spark, compose(scan, checkouts, gem_use), checkouts.where("kind = 'repo'"), macros)

    def facts(self, kind: str) -> DataFrame:
        return extraction.facts(self.wide, kind)

    def placed_facts(self, kind: str) -> DataFrame:
        return self.facts(kind).join(self.files, "oid")

    @cached_property
    def decls(self) -> DataFrame:
        return relational.declarations(self.facts("defs"), self.files, self.checkouts).withColumnRenamed("path", "file")

    @cached_property
    def raw_edges(self) -> DataFrame:
        return relational.edges(self.facts("ancestry"), self.files, self.checkouts)

    @cached_property
    def paths(self) -> DataFrame:
        calls = self.placed_facts("calls").select("checkout", "nesting")
        consts = self.placed_facts("const_refs").select("checkout", "nesting")
        defs = self.placed_facts("defs").select("checkout", "nesting")
        clean = lambda df, c: df.withColumn(c, F.filter(F.transform(c, lambda x: F.regexp_replace(x, r"^\(mixed (.*)\)$", "$1")), lambda x: ~x.startswith("(")))
        return cut(namespace.place(self.decls, clean(self.raw_edges, "owner"), clean(calls.unionByName(consts).unionByName(defs), "nesting")))

    @cached_property
    def own_names(self) -> DataFrame:
        return cut(namespace.names(self.decls, self.paths))

    @cached_property
    def names(self) -> DataFrame:
        core = self.spark.createDataFrame(list(CORE), "fqn string, kind string").join(F.broadcast(self.checkouts.select(F.col("root").alias("checkout"))), how="cross")
        missing = core.join(self.own_names.select("checkout", "fqn"), ["checkout", "fqn"], "left_anti")
        return cut(self.own_names.unionByName(missing.select("checkout", "fqn", "kind"), allowMissingColumns=True).withColumn("sites", F.coalesce("sites", F.array().cast(self.own_names.schema["sites"].dataType))))

    @cached_property
    def aliases(self) -> DataFrame:
        return cut(namespace.follow_aliases(self.names, self.paths))

    @cached_property
    def edges(self) -> DataFrame:
        placed = namespace.place_edges(self.raw_edges, self.paths, self.names, self.aliases)
        lazy = namespace.load_hook_edges(self.placed_facts("ancestry"), self.paths, self.names)
        if not lazy.isEmpty():
            # what a hook mixes in comes after everything that bodies say
            zero = F.struct(F.lit(9).alias("layer"), F.col("checkout").alias("checkout"), F.lit("").alias("path"), F.lit(0).alias("line"), F.lit(0).alias("col"))
            placed = placed.unionByName(lazy.withColumn("ord", F.struct(F.lit(2).alias("runtime"), zero.alias("ord"))))
        return cut(namespace.apply_hooks(placed, namespace.hook_edges(self.raw_edges, self.paths, self.names)))

    @cached_property
    def macro_mixins(self) -> DataFrame:
        """Mixins that class macros make; their chains are the callers' own business."""
        return cut(namespace.macro_mixins(self.placed_facts("ancestry"), self.placed_facts("body_calls"), self.methods, self.paths, self.chains))

    @cached_property
    def conflicts(self) -> DataFrame:
        return cut(namespace.conflicts(self.edges, self.names))

    @cached_property
    def dynamic(self) -> DataFrame:
        return cut(namespace.place_dynamic(self.placed_facts("ancestry"), self.paths))

    @cached_property
    def chains(self) -> DataFrame:
        core = self.spark.createDataFrame(list(CORE_SUPERCLASS), "owner string, superclass string").join(F.broadcast(self.checkouts.select(F.col("root").alias("checkout"))), how="cross").select("checkout", "owner", "superclass", F.col("superclass").alias("written"))
        chosen = namespace.choose_superclass(self.edges, self.names)
        chosen = chosen.unionByName(core.join(chosen.select("checkout", "owner"), ["checkout", "owner"], "left_anti"))
        return cut(C.linearize(self.names, self.edges, chosen))

    @cached_property
    def scopes(self) -> DataFrame:
        return cut(namespace.scope_names(self.paths))

    @cached_property
    def methods(self) -> DataFrame:
        """checkout, owner, side, name, params, visibility, sig_returns, path, line, end_line, is_rbi, ord."""
        rows = relational.methods(self.facts("defs"), self.files, self.checkouts).withColumn("nesting_", F.filter("nesting", lambda x: ~x.startswith("(")))
        placed = rows.join(self.paths.select("checkout", F.col("path").alias("nesting_"), "fqn"), ["checkout", "nesting_"])
        owner = F.when(F.col("fqn") == "", "Object").otherwise(F.col("fqn"))
        # class methods of a path sent to another constant stand on that constant
        owner = F.coalesce(F.col("alias_of"), owner)
        joined = placed.join(self.aliases.select("checkout", F.col("fqn"), F.col("namespace").alias("alias_of")), ["checkout", "fqn"], "left")
        return cut(joined.select("checkout", owner.alias("owner"), F.when(F.col("singleton"), "class").otherwise("instance").alias("side"), "name", "params", "visibility", "sig_returns", F.col("via").alias("kind_via"), "target", "path", "line", "end_line", F.col("path").endswith(".rbi").alias("is_rbi"), "ord"))

    @cached_property
    def calls(self) -> DataFrame:
        rows = self.placed_facts("calls").withColumn("nesting", F.filter("nesting", lambda x: ~x.startswith("(")))
        rows = rows.withColumn("call_id", F.xxhash64("checkout", "path", "line", "col", "name", "symbol"))
        return cut(rows.join(self.scopes.select("checkout", F.col("path").alias("nesting"), "scopes"), ["checkout", "nesting"], "left").withColumn("scopes", F.coalesce("scopes", F.array().cast("array<string>"))))

    @cached_property
    def receivers(self) -> DataFrame:
        assigns = self.placed_facts("assigns").withColumn("nesting", F.filter("nesting", lambda x: ~x.startswith("("))).withColumn("assign_id", F.xxhash64("checkout", "path", "line", "col", "target"))
        return cut(receivers.type_receivers(self.calls.drop("scopes"), assigns, self.facts("reaching"), self.scopes, self.names, self.chains, self.methods, self.aliases))

    @cached_property
    def routed(self) -> DataFrame:
        """owner, name of the actions that routes files name."""
        return cut(routes(self.scan).where("action IS NOT NULL").select(F.col("controller").alias("owner"), F.col("action").alias("name")).distinct())

    # -- questions ----------------------------------------------------------
    def references(self, queries: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame([(q,) for q in queries], "query string").withColumn("q", references.parse_query(F.col("query"))).select("query", "q.owner", "q.side", "q.name")
        return references.gather(F.broadcast(asked), self.calls, self.receivers, self.chains, self.methods, self.names, self.dynamic)

    def references_of(self, methods: DataFrame) -> DataFrame:
        """References of methods (query, owner, side, name)."""
        asked = cut(methods.select("query", "owner", "side", "name").distinct())
        return references.gather(asked, self.calls, self.receivers, self.chains, self.methods, self.names, self.dynamic)

    def answers(self) -> DataFrame:
        return references.answers(self.calls, self.receivers, self.chains, self.methods)

    def includer_votes(self) -> DataFrame:
        return references.includer_votes(self.calls, self.receivers, self.names, self.chains, self.methods)

    def delegates(self) -> DataFrame:
        return references.follow_delegates(self.answers().where("owner IS NOT NULL").select("call_id", "checkout", "owner", "owner_side", "name"), self.methods, self.chains, self.names)

    def ancestors(self, fqn: str) -> DataFrame:
        return C.ancestors(self.chains, fqn)

    def constants(self) -> DataFrame:
        """Every constant reference with what it names."""
        rows = self.placed_facts("const_refs").withColumn("nesting", F.filter("nesting", lambda x: ~x.startswith("(")))
        rows = rows.join(self.scopes.select("checkout", F.col("path").alias("nesting"), "scopes"), ["checkout", "nesting"], "left").withColumn("scopes", F.coalesce("scopes", F.array().cast("array<string>")))
        found = C.resolve_constant(rows.select("checkout", "path", "line", "col", F.col("name").alias("written"), F.col("scopes").alias("around"), "scopes"), self.names, self.chains)
        return found.withColumnRenamed("around", "scopes")

    def dead_methods(self) -> DataFrame:
        dynamic = self.dynamic.select("checkout", "owner").distinct().withColumn("dynamic", F.lit(True))
        own = self.methods.where(F.col("ord.layer") == relational.LAYERS["repo"])
        mine = dead.candidates(own, extraction.call_names(self.wide), self.files).withColumn("query", F.concat("owner", F.when(F.col("side") == "class", ".").otherwise("#"), "name"))
        mine = relational.last_wins(mine.withColumn("o", F.struct("ord")), ["checkout", "query"], ["o"]).join(dynamic, ["checkout", "owner"], "left").withColumn("dynamic", F.coalesce("dynamic", F.lit(False)))
        mine = cut(mine)
        conventional = conventions.by_library(self.methods, self.chains, conventions.default_rules(self.spark))
        writers = conventions.attribute_writers(self.methods, self.chains).withColumn("caveat", F.lit("a hash of attributes may write it"))
        built = conventions.hedged(self.methods, conventions.built_shapes(self.ruby_scan)).select("checkout", "owner", "name", F.concat(F.lit("a name built at run time fits: "), "shape").alias("caveat"))
        hedges = writers.select("checkout", "owner", "name", "caveat").unionByName(built)
        return dead.grade_methods(mine, self.references_of(mine), references.overriding(self.methods, self.chains), self.routed, conventional, hedges)

    def dead_constants(self) -> DataFrame:
        ours = self.decls.where(F.col("layer") == relational.LAYERS["repo"]).select("checkout", F.col("file").alias("_first")).distinct()
        own = self.own_names.where(F.size("sites") > 0).withColumn("_first", F.element_at("sites", 1)["path"]).join(ours, ["checkout", "_first"], "left_semi").drop("_first")
        return dead.grade_constants(own, self.constants(), conventions.constants_named(self.ruby_scan, own))

    @property
    def ruby_scan(self) -> DataFrame:
        """The scan's files that are read as Ruby."""
        return self.scan.where(F.col("path").rlike(r"\.(rb|rake|ru|gemspec)$"))

    def symbols(self, path: str) -> DataFrame:
        return self.placed_facts("defs").where(F.col("path") == path).select("checkout", "name", "kind", "visibility", "line", "col").orderBy("line", "col", "name")

    def card(self, query: str) -> DataFrame:
        """Definition sites and reference counts of a method."""
        return references.counts(self.references([query]), ["query"]).join(self.methods.withColumn("query", F.concat("owner", F.when(F.col("side") == "class", ".").otherwise("#"), "name")).select("query", "path", "line", "params"), "query")
