"""Dead-code grading: methods and constants that nothing appears to use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnelian.functions.scalars import in_tests, prefixes

#: The tiers, from least to most evidence of use.
TIERS = ("unreferenced", "shadowed", "test-only", "override", "convention-only", "super-only", "single-caller")
MOST_WRITTEN = 8
#: Names that Ruby, its libraries or a framework call on their own, by side.
INSTANCE_HOOKS = (
    "marshal_dump", "marshal_load", "_dump", "init_with", "encode_with", "to_s", "inspect", "instance_variables_to_inspect", "pretty_print", "pretty_print_cycle",
    "pretty_print_instance_variables", "hash", "eql?", "==", "<=>", "===", "=~", "deconstruct", "deconstruct_keys", "each", "succ", "call", "to_proc", "coerce", "to_str", "to_ary",
    "to_hash", "to_int", "to_io", "to_path", "to_regexp", "to_a", "respond_to_missing?", "method_missing", "singleton_method_added", "singleton_method_removed",
    "singleton_method_undefined", "initialize_copy", "initialize_dup", "initialize_clone", "to_param", "to_partial_path", "to_model", "to_key", "model_name", "persisted?",
    "to_attachable_partial_path", "as_json", "to_json", "serializable_hash", "cache_key", "cache_key_with_version", "cache_version", "read_attribute_for_serialization",
    "read_attribute_for_validation", "perform",
)
CLASS_HOOKS = (
    "_load", "json_create", "inherited", "included", "extended", "prepended", "append_features", "extend_object", "prepend_features", "method_added", "method_removed",
    "method_undefined", "singleton_method_added", "singleton_method_removed", "singleton_method_undefined", "method_missing", "respond_to_missing?", "const_missing", "const_added",
    "model_name", "table_name_prefix", "table_name_suffix", "use_relative_model_naming?",
)


#: Ancestors that make a class a job.
JOBS = ("Sidekiq::Job", "Sidekiq::Worker", "ActiveJob::Base", "ApplicationJob")


def protocol_hook(name: Column, side: Column) -> Column:
    return F.when(side == "instance", name.isin(*INSTANCE_HOOKS)).otherwise(name.isin(*CLASS_HOOKS))


def candidates(methods: DataFrame, call_name: DataFrame, files: DataFrame, scope: Column | None = None) -> DataFrame:
    """Methods worth weighing: those in scope whose name isn't written often outside tests.

    A cheap count takes out names with more than MOST_WRITTEN written calls, some
    outside tests, before any receiver is looked at."""
    mine = methods.where(~in_tests(F.col("path")) & F.col("kind_via").isNull())
    mine = mine.where(scope) if scope is not None else mine
    placed = call_name.join(files, "oid")
    written = F.col("calls") - F.col("symbols")
    often = placed.groupBy("name").agg(F.sum(written).alias("total"), F.sum(F.when(~in_tests(F.col("path")), written).otherwise(0)).alias("outside")).where((F.col("total") > MOST_WRITTEN) & (F.col("outside") > 0) & (F.col("name") != "initialize"))
    return mine.join(often.select("name"), "name", "left_anti")


def liveness(references: DataFrame) -> DataFrame:
    """query, written, supers, symbols, in_tests of the references that may run the method."""
    live = references.where("tier <> 'excluded'")
    by_symbol = F.col("symbol")
    by_super = (F.col("recv") == "super") & F.col("landed").isNotNull()
    return live.groupBy("query").agg(
        F.count_if(~by_symbol & ~by_super).alias("written"),
        F.count_if(by_super).alias("supers"),
        F.count_if(by_symbol).alias("symbols"),
        F.bool_and(in_tests(F.col("path"))).alias("only_tests"),
        F.min(F.when(~by_symbol & ~by_super, F.struct("path", "line"))).alias("caller"),
    )


def tier_of(written: Column, supers: Column, symbols: Column) -> Column:
    """The tier that counts alone give; null for what is plainly used."""
    return F.when((written == 0) & (supers == 0) & (symbols == 0), "unreferenced").when((written == 0) & (supers == 0), "convention-only").when(written == 0, "super-only").when((written == 1) & (supers == 0), "single-caller")


def grade_methods(candidates_: DataFrame, references: DataFrame, overrides: DataFrame, routed: DataFrame | None = None, conventional: DataFrame | None = None, hedges: DataFrame | None = None) -> DataFrame:
    """Rows (query, owner, side, name, path, line, tier, confidence, caveats, caller) of what looks dead.

    overrides: checkout, owner, side, name, ancestor.  routed: owner, name of actions.
    conventional: checkout, owner, name of instance methods that a library calls.
    hedges: checkout, owner, name, caveat of what may call one unseen."""
    weighed = candidates_.join(liveness(references), "query", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    rows = weighed.withColumn("counted", tier_of(n("written"), n("supers"), n("symbols")))
    rows = rows.withColumn("tests", F.coalesce("only_tests", F.lit(False)) & (n("written") > 0))
    rows = rows.join(overrides, ["checkout", "owner", "side", "name"], "left")
    if routed is not None:
        rows = rows.join(routed.select("owner", "name").distinct().withColumn("routed", F.lit(True)), ["owner", "name"], "left")
    else:
        rows = rows.withColumn("routed", F.lit(None).cast("boolean"))
    keys = ["checkout", "owner", "name"]
    held = conventional.select(*keys).distinct().withColumn("by_library", F.lit(True)) if conventional is not None else None
    rows = rows.join(held, keys, "left") if held is not None else rows.withColumn("by_library", F.lit(None).cast("boolean"))
    doubts = hedges.groupBy(*keys).agg(F.array_sort(F.collect_set("caveat")).alias("hedges")) if hedges is not None else None
    rows = rows.join(doubts, keys, "left") if doubts is not None else rows.withColumn("hedges", F.lit(None).cast("array<string>"))
    convention = F.coalesce("routed", F.lit(False)) | (F.coalesce("by_library", F.lit(False)) & (F.col("side") == "instance")) | protocol_hook(F.col("name"), F.col("side")) | F.col("name").rlike("^test_")
    tier = (
        F.when(F.col("tests"), "test-only")
        .when((F.col("counted") == "unreferenced") & F.col("ancestor").isNotNull(), "override")
        .when((F.col("counted") == "unreferenced") & convention, "convention-only")
        .otherwise(F.col("counted"))
    )
    lands = references.where("tier = 'excluded' AND why = 'different_owner'").join(overrides.select(F.col("owner").alias("landed"), F.col("name"), F.col("ancestor").alias("over")).distinct(), ["landed", "name"]).where("over = target").select("query").distinct().withColumn("shadow", F.lit(True))
    rows = rows.withColumn("tier", tier).join(lands, "query", "left").withColumn("tier", F.when((F.col("tier") == "unreferenced") & F.col("shadow"), "shadowed").otherwise(F.col("tier")))
    caveats = F.array_compact(F.array(F.when(F.col("visibility") != "private", F.when(F.col("dynamic"), "its class makes or forwards names at run time")), F.when(n("symbols") > 0, "named by a symbol")))
    caveats = F.concat(caveats, F.coalesce("hedges", F.array().cast("array<string>")))
    rows = rows.where("tier IS NOT NULL").withColumn("caveats", caveats)
    confidence = F.when((F.size("caveats") == 0) & (F.col("tier") != "override"), "clear").otherwise("lower")
    return rows.select("query", "checkout", "owner", "side", "name", "path", "line", "end_line", "tier", confidence.alias("confidence"), "caveats", "caller")


def inside_candidates(rows: DataFrame) -> DataFrame:
    """single-caller rows whose caller's line stands within another candidate's span, with that candidate."""
    spans = rows.select("checkout", "path", F.col("query").alias("within"), F.col("line").alias("from_line"), F.col("end_line").alias("to_line"))
    one = rows.where("tier = 'single-caller'").select("query", "checkout", F.col("caller.path").alias("path"), F.col("caller.line").alias("at"))
    return one.join(spans, ["checkout", "path"]).where("at BETWEEN from_line AND to_line AND query <> within").select("query", "within")


def grade_constants(names: DataFrame, resolved: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Names that no reference outside their own bodies resolves to, or to what they hold.

    resolved: checkout, path, fqn (what the reference names), scopes (full names around it).
    texts: checkout, fqn, how of constants that a string or a symbol names: a caveat."""
    used = resolved.where("fqn IS NOT NULL AND NOT array_contains(scopes, fqn)")
    each = used.select("checkout", "path", F.explode(F.concat(F.array("fqn"), prefixes(F.col("fqn")))).alias("fqn"), "scopes").where("NOT array_contains(scopes, fqn)")
    counted = each.groupBy("checkout", "fqn").agg(F.count("*").alias("uses"), F.count_if(in_tests(F.col("path"))).alias("test_uses"))
    rows = names.where(F.size("sites") > 0).join(counted, ["checkout", "fqn"], "left")
    tier = F.when(F.coalesce("uses", F.lit(0)) == 0, "unreferenced").when(F.col("uses") == F.col("test_uses"), "test-only")
    site = F.element_at("sites", 1)
    rows = rows.withColumn("tier", tier).where("tier IS NOT NULL").where(~in_tests(site["path"]))
    none = F.array().cast("array<string>")
    if texts is not None:
        rows = rows.join(texts.groupBy("checkout", "fqn").agg(F.array_sort(F.collect_set(F.concat(F.lit("named by a "), "how"))).alias("caveats")), ["checkout", "fqn"], "left").withColumn("caveats", F.coalesce("caveats", none))
    else:
        rows = rows.withColumn("caveats", none)
    confidence = F.when(F.size("caveats") == 0, "clear").otherwise("lower")
    return rows.select("checkout", "fqn", "kind", "tier", site["path"].alias("path"), site["line"].alias("line"), confidence.alias("confidence"), "caveats")


def summary(rows: DataFrame) -> DataFrame:
    """Counts by tier, by confidence and by kind, in one pass."""
    rows.createOrReplaceTempView("carnelian_dead")
    return rows.sparkSession.sql("SELECT tier, confidence, kind, count(*) AS n FROM carnelian_dead GROUP BY GROUPING SETS ((tier), (confidence), (kind))")


def entry_points(methods: DataFrame, chains: DataFrame) -> DataFrame:
    """checkout, owner, kind: job classes, by what stands among their ancestors, unresolved names too."""
    jobs = F.array(*[F.lit(x) for x in JOBS])
    rows = chains.where("side = 'instance' AND fqn <> 'ApplicationJob'").where(F.arrays_overlap(F.concat(F.transform("chain", lambda x: x["owner"]), "unresolved"), jobs))
    return rows.select("checkout", F.col("fqn").alias("owner"), F.lit("job").alias("kind"))
