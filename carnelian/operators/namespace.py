"""Assembly of a checkout's namespace: where every declaration and edge belongs.

A scope is known by its path: the names that were written around a place,
innermost first.  A path of plain names is its own full name; one with a
compact name (module A::B) stands where the first enclosing scope has an A, so
those paths are resolved in rounds until no round finds a new name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carnelian.functions.scalars import prefixes, qualify, scopes, whole_name
from carnelian.plans.lineage import cut

SPECIAL = r"^\("


def _plain(path: Column) -> Column:
    return ~F.exists(path, lambda n: F.contains(n, F.lit("::")))


def paths_of(decls: DataFrame, edges: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """Distinct (checkout, path) of every scope that something is written in or opens."""
    opened = decls.where(F.col("kind").isin("class", "module")).select("checkout", F.concat(F.array("name"), "nesting").alias("path"))
    found = opened.unionByName(decls.select("checkout", F.col("nesting").alias("path")))
    for more, column in ((edges, "owner"), (others, "nesting")):
        if more is not None:
            found = found.unionByName(more.select("checkout", F.col(column).alias("path")))
    every = found.select("checkout", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", n + 1, F.greatest(F.size("path") - n, F.lit(0))))).alias("path"))
    return every.distinct()


def place(decls: DataFrame, edges: DataFrame | None = None, others: DataFrame | None = None, rounds: int = 8) -> DataFrame:
    """checkout, path, fqn of every scope path; the empty path is the top level, ""."""
    paths = paths_of(decls, edges, others)
    plain = F.when(F.size("path") == 0, F.lit("")).otherwise(F.element_at(scopes(F.col("path")), 1))
    placed = cut(paths.withColumn("fqn", F.when((F.size("path") == 0) | _plain(F.col("path")), plain)))
    constants = decls.where(F.col("kind") == "constant").select("checkout", F.col("nesting").alias("path"), "name")
    while True:
        known = _known(placed, constants)
        open_ = placed.where("fqn IS NULL").select("checkout", "path")
        if open_.isEmpty():
            return placed
        step = cut(_resolve_compact(open_, placed, known))
        found = placed.join(step, ["checkout", "path"], "left").select("checkout", "path", F.coalesce("fqn", "placed").alias("fqn"))
        after = cut(found)
        rounds -= 1
        left = after.where("fqn IS NULL").count()
        if not left or rounds <= 0 or left == open_.count():
            # what no scope explains stands at the top level as it is written
            written = F.element_at(F.transform(F.col("path"), whole_name), 1)
            return cut(after.withColumn("fqn", F.coalesce("fqn", written)))
        placed = after


def _known(placed: DataFrame, constants: DataFrame) -> DataFrame:
    """Distinct (checkout, fqn) of names that exist so far, namespaces that they imply among them."""
    names = placed.where(F.col("fqn").isNotNull() & (F.col("fqn") != "")).select("checkout", "fqn")
    held = constants.join(placed, ["checkout", "path"]).where(F.col("fqn").isNotNull()).select("checkout", qualify(F.col("fqn"), F.col("name")).alias("fqn"))
    every = names.unionByName(held)
    implied = every.select("checkout", F.explode(prefixes(F.col("fqn"))).alias("fqn"))
    return every.unionByName(implied).distinct()


def _resolve_compact(open_: DataFrame, placed: DataFrame, known: DataFrame) -> DataFrame:
    """(checkout, path, placed) for the open paths whose parent is placed and whose head some scope has."""
    parent = placed.where("fqn IS NOT NULL").select("checkout", F.col("path").alias("parent"), F.col("fqn").alias("within"))
    rows = open_.withColumn("parent", F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0)))).join(parent, ["checkout", "parent"])
    name = F.element_at("path", 1)
    rows = rows.withColumn("name", whole_name(name)).withColumn("top", name.startswith("::"))
    # the scopes around: the parent and each namespace above it as written, then the top level
    around = F.when(F.col("top"), F.array(F.lit(""))).otherwise(F.concat(F.filter(F.array("within"), lambda s: s != ""), F.reverse(prefixes(F.col("within"))), F.array(F.lit(""))))
    head = F.element_at(F.split("name", "::"), 1)
    candidates = rows.select("checkout", "path", "name", F.posexplode(around).alias("at", "scope")).withColumn("fqn", qualify(F.col("scope"), head if isinstance(head, Column) else F.col("head")))
    plain = rows.where(~F.contains("name", F.lit("::"))).select("checkout", "path", F.when(F.col("top"), F.col("name")).otherwise(qualify(F.col("within"), F.col("name"))).alias("placed"))
    hit = candidates.where(F.contains("name", F.lit("::"))).join(known, ["checkout", "fqn"])
    best = hit.groupBy("checkout", "path").agg(F.min_by(qualify(F.col("scope"), F.col("name")), "at").alias("placed"))
    return plain.unionByName(best)


def names(decls: DataFrame, placed: DataFrame) -> DataFrame:
    """checkout, fqn, kind, target, sites of every name; implied namespaces are modules without a site.

    A class or module beats a constant of its name; sites are in reading order."""
    at = placed.select("checkout", F.col("path").alias("nesting"), F.col("fqn").alias("scope"))
    opened = placed.select("checkout", "path", F.col("fqn").alias("own"))
    rows = decls.join(at, ["checkout", "nesting"]).withColumn("path", F.concat(F.array("name"), "nesting")).join(opened, ["checkout", "path"], "left")
    fqn = F.when(F.col("kind").isin("class", "module"), F.coalesce("own", qualify(F.col("scope"), whole_name(F.col("name"))))).otherwise(qualify(F.col("scope"), whole_name(F.col("name"))))
    rows = rows.select("checkout", fqn.alias("fqn"), "kind", "target", "file", "line", "col", "nesting", "ord")
    rank = F.when(F.col("kind") == "constant", 1).otherwise(0)
    best = rows.groupBy("checkout", "fqn").agg(
        F.min_by("kind", F.struct(rank, "ord")).alias("kind"),
        F.max_by("target", F.struct(F.when(F.col("target").isNull(), 0).otherwise(1), "ord")).alias("target"),
        F.max_by("nesting", F.struct(F.when(F.col("target").isNull(), 0).otherwise(1), "ord")).alias("nesting"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "file", "line", "col"))), lambda s: F.struct(s["file"].alias("path"), s["line"].alias("line"), s["col"].alias("col"))).alias("sites"),
    )
    implied = best.select("checkout", F.explode(prefixes(F.col("fqn"))).alias("fqn")).distinct().join(best.select("checkout", "fqn"), ["checkout", "fqn"], "left_anti")
    none = F.array().cast(best.schema["sites"].dataType)
    return best.unionByName(implied.select("checkout", "fqn", F.lit("module").alias("kind"), F.lit(None).cast("string").alias("target"), F.array().cast("array<string>").alias("nesting"), none.alias("sites")))


def scope_names(placed: DataFrame) -> DataFrame:
    """checkout, path, scopes: full names of the scopes around a path, innermost first."""
    each = placed.select("checkout", "path", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", n + 1, F.greatest(F.size("path") - n, F.lit(0))))).alias("at", "part"))
    named = each.join(placed.select("checkout", F.col("path").alias("part"), "fqn"), ["checkout", "part"]).where("fqn <> ''")
    listed = named.groupBy("checkout", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "fqn"))), lambda x: x["fqn"]).alias("scopes"))
    return placed.select("checkout", "path").join(listed, ["checkout", "path"], "left").withColumn("scopes", F.coalesce("scopes", F.array().cast("array<string>")))


def resolve_lexical(refs: DataFrame, names_: DataFrame) -> DataFrame:
    """refs (key columns, checkout, written, scopes) with fqn: the first scope that has the name, then the top.

    Later segments of a path descend from what its head names; no ancestors are asked."""
    keys = [c for c in refs.columns if c not in ("written", "scopes")]
    rows = refs.withColumn("_id", F.xxhash64(*keys, "written", "scopes")).withColumn("plain", whole_name(F.col("written")))
    around = F.when(F.col("written").startswith("::"), F.array(F.lit(""))).otherwise(F.concat("scopes", F.array(F.lit(""))))
    head = rows.select("_id", "checkout", "plain", F.posexplode(around).alias("at", "scope")).withColumn("fqn", qualify(F.col("scope"), F.element_at(F.split("plain", "::"), 1)))
    first = head.join(names_.select("checkout", "fqn"), ["checkout", "fqn"]).groupBy("_id").agg(F.min_by(qualify(F.col("scope"), F.col("plain")), "at").alias("fqn"), F.first("checkout").alias("checkout"))
    whole = first.join(names_.select("checkout", "fqn"), ["checkout", "fqn"], "left_semi").select("_id", "fqn")
    return rows.join(whole.dropDuplicates(["_id"]), "_id", "left").drop("_id", "plain")


def follow_aliases(names_: DataFrame, placed: DataFrame, rounds: int = 16) -> DataFrame:
    """checkout, fqn, namespace: what a constant that names another constant stands for in the end.

    A chain that comes back to itself stands for its own name."""
    around = scope_names(placed).select("checkout", F.col("path").alias("nesting"), "scopes")
    alias = names_.where((F.col("kind") == "constant") & F.col("target").isNotNull()).select("checkout", F.col("fqn").alias("alias"), "nesting", F.col("target").alias("written"))
    step = resolve_lexical(alias.join(around, ["checkout", "nesting"]).select("checkout", "alias", "written", "scopes"), names_).where("fqn IS NOT NULL")
    at = cut(step.select("checkout", "alias", F.col("fqn").alias("to")))
    for _ in range(rounds):
        far = at.select("checkout", F.col("alias").alias("to"), F.col("to").alias("next"))
        after = cut(at.join(far, ["checkout", "to"], "left").select("checkout", "alias", F.coalesce("next", "to").alias("to")))
        if after.join(at, ["checkout", "alias", "to"], "left_anti").isEmpty():
            break
        at = after
    loop = at.select("checkout", F.col("alias").alias("to")).distinct()
    ended = at.join(loop, ["checkout", "to"], "left_anti").select("checkout", F.col("alias").alias("fqn"), F.col("to").alias("namespace"))
    return names_.select("checkout", "fqn").join(ended, ["checkout", "fqn"], "left").withColumn("namespace", F.coalesce("namespace", "fqn"))


def place_edges(edges: DataFrame, placed: DataFrame, names_: DataFrame, aliases: DataFrame) -> DataFrame:
    """checkout, owner, relation, target, resolved, ord of every edge, runtime edges after those of bodies.

    An edge sent to a constant belongs to what the constant names where it is sent."""
    around = scope_names(placed)
    sent = F.element_at("owner", 1).startswith("(sent ")
    hooked = F.element_at("owner", 1).startswith("(mixed ") | F.element_at("owner", 1).startswith("(on_load ")
    rows = edges.withColumn("path", F.when(sent | hooked, F.slice("owner", 2, F.greatest(F.size("owner") - 1, F.lit(0)))).otherwise(F.col("owner"))).withColumn("runtime", (sent | hooked).cast("int"))
    rows = rows.join(around, ["checkout", "path"], "left").join(placed, ["checkout", "path"], "left")
    rows = rows.withColumn("scopes", F.coalesce("scopes", F.array().cast("array<string>")))
    rows = rows.withColumn("sent_to", F.when(sent, F.regexp_extract(F.element_at("owner", 1), r"^\(sent (.*)\)$", 1)))
    rows = rows.where(~F.element_at("owner", 1).startswith("(mixed ") & ~F.element_at("owner", 1).startswith("(on_load "))
    by_body = rows.where("sent_to IS NULL").select("checkout", F.col("fqn").alias("owner"), "relation", "target", "scopes", "runtime", "ord")
    found = resolve_lexical(rows.where("sent_to IS NOT NULL").select("checkout", "relation", "target", "runtime", "ord", F.col("scopes").alias("around"), F.col("sent_to").alias("written"), "scopes"), names_)
    by_constant = found.where("fqn IS NOT NULL").select("checkout", F.col("fqn").alias("owner"), "relation", "target", F.col("around").alias("scopes"), "runtime", "ord")
    both = by_body.unionByName(by_constant).where("owner IS NOT NULL")
    # an edge's target is looked up from around the body, not from within it
    outer = F.when((F.col("relation") == "superclass") & (F.size("scopes") > 0), F.slice("scopes", 2, F.greatest(F.size("scopes") - 1, F.lit(0)))).otherwise(F.col("scopes"))
    self_target = F.col("target") == "self"
    asked = both.select("checkout", "owner", "relation", "runtime", "ord", F.when(self_target, F.concat(F.lit("::"), "owner")).otherwise(F.col("target")).alias("written"), outer.alias("scopes"), F.col("target").alias("as_written"))
    got = resolve_lexical(asked, names_).join(aliases.select("checkout", "fqn", "namespace"), ["checkout", "fqn"], "left")
    return got.select("checkout", "owner", "relation", F.col("as_written").alias("target"), F.coalesce("namespace", "fqn").alias("resolved"), F.struct("runtime", "ord").alias("ord"))


def hook_edges(edges: DataFrame, placed: DataFrame, names_: DataFrame) -> DataFrame:
    """checkout, module, relation, target, resolved of what modules mix into whatever mixes them in."""
    rows = edges.where(F.element_at("owner", 1).startswith("(mixed ")).withColumn("path", F.concat(F.array(F.regexp_extract(F.element_at("owner", 1), r"^\(mixed (.*)\)$", 1)), F.slice("owner", 2, F.greatest(F.size("owner") - 1, F.lit(0)))))
    asked = rows.join(scope_names(placed), ["checkout", "path"]).join(placed, ["checkout", "path"]).select("checkout", F.col("fqn").alias("module"), "relation", "target", F.col("target").alias("written"), "scopes")
    return resolve_lexical(asked, names_).select("checkout", "module", "relation", "target", F.col("fqn").alias("resolved")).where("resolved IS NOT NULL")


def load_hook_edges(ancestry: DataFrame, placed: DataFrame, names_: DataFrame) -> DataFrame:
    """checkout, owner, relation, target, resolved of what on_load blocks mix into the classes that run their hook."""
    clean = F.filter("owner", lambda x: ~x.startswith("("))
    lazy = ancestry.where(F.element_at("owner", 1).startswith("(on_load ")).select("checkout", F.regexp_extract(F.element_at("owner", 1), r"^\(on_load (.*)\)$", 1).alias("hook"), "relation", "target", clean.alias("path"))
    known = lazy.join(scope_names(placed), ["checkout", "path"], "left").withColumn("scopes", F.coalesce("scopes", F.array().cast("array<string>")))
    found = resolve_lexical(known.select("checkout", "hook", "relation", "target", F.col("target").alias("written"), "scopes"), names_).select("checkout", "hook", "relation", "target", F.col("fqn").alias("resolved"))
    run = ancestry.where("relation = 'load_hooks'").select("checkout", F.col("target").alias("hook"), clean.alias("path")).join(placed, ["checkout", "path"]).select("checkout", "hook", F.col("fqn").alias("owner")).distinct()
    return found.where("resolved IS NOT NULL").join(run, ["checkout", "hook"]).select("checkout", "owner", "relation", "target", "resolved").distinct()


def apply_hooks(placed_edges: DataFrame, hooked: DataFrame, rounds: int = 8) -> DataFrame:
    """placed_edges with what a module's hook mixes into whatever mixes the module in, right behind the module.

    hooked: checkout, module, relation, target, resolved.  A hook may mix in a
    module with a hook of its own, so rounds follow one another until no edge is
    new."""
    at = cut(placed_edges.withColumn("step", F.array().cast("array<int>")))
    fresh = at
    order = Window.partitionBy("checkout", "module").orderBy("target", "relation")
    hooks = hooked.withColumn("n", F.row_number().over(order))
    for _ in range(rounds):
        more = fresh.where(F.col("relation").isin("include", "prepend")).join(hooks.select("checkout", F.col("module").alias("resolved"), F.col("relation").alias("r"), F.col("target").alias("t"), F.col("resolved").alias("to"), "n"), ["checkout", "resolved"])
        more = more.select("checkout", "owner", F.col("r").alias("relation"), F.col("t").alias("target"), F.col("to").alias("resolved"), "ord", F.array_append("step", F.col("n")).alias("step"))
        fresh = cut(more.join(at, ["checkout", "owner", "relation", "resolved"], "left_anti").dropDuplicates(["checkout", "owner", "relation", "resolved"]))
        if fresh.isEmpty():
            break
        at = cut(at.unionByName(fresh))
    return at.select("checkout", "owner", "relation", "target", "resolved", F.struct(F.col("ord"), F.col("step")).alias("ord"))


def place_dynamic(ancestry: DataFrame, placed: DataFrame, body_calls: DataFrame | None = None) -> DataFrame:
    """checkout, owner, shape of classes whose source makes or forwards names that it doesn't spell."""
    rows = ancestry.where("relation = 'dynamic'").withColumn("path", F.filter("owner", lambda x: ~x.startswith("(")))
    at = rows.select("checkout", "path", F.col("target").alias("shape")).join(placed, ["checkout", "path"])
    shape = F.when(F.col("shape").startswith("("), "*").otherwise(F.col("shape"))
    return at.select("checkout", F.when(F.col("fqn") == "", "Object").otherwise(F.col("fqn")).alias("owner"), shape.alias("shape")).distinct()


def choose_superclass(edges: DataFrame, names_: DataFrame) -> DataFrame:
    """checkout, owner, superclass, unresolved: the first written target that names a class."""
    kinds = names_.select("checkout", F.col("fqn").alias("resolved"), F.col("kind").alias("of"))
    rows = edges.where("relation = 'superclass'").join(kinds, ["checkout", "resolved"], "left")
    names_class = F.col("of") == "class"
    return rows.groupBy("checkout", "owner").agg(F.min_by(F.when(names_class, F.col("resolved")), F.struct(F.when(names_class, 0).otherwise(1), "ord")).alias("superclass"), F.min_by("target", F.struct(F.when(names_class, 0).otherwise(1), "ord")).alias("written"))


def conflicts(edges: DataFrame, names_: DataFrame) -> DataFrame:
    """checkout, owner, variants: names that are opened with different superclasses."""
    rows = edges.where("relation = 'superclass' AND resolved IS NOT NULL AND resolved <> owner")
    return rows.groupBy("checkout", "owner").agg(F.array_sort(F.collect_set("resolved")).alias("variants")).where(F.size("variants") > 1)


def macro_mixins(ancestry: DataFrame, body_calls: DataFrame, methods: DataFrame, placed: DataFrame, chains: DataFrame) -> DataFrame:
    """checkout, owner, relation, target: mixins that a class macro makes in the classes whose bodies call it.

    ancestry: rows of relation macro, whose target is "how|method|Module".  A call
    counts if the class's own side has that macro."""
    from carnelian.operators.chains import lookup

    parts = F.split("target", r"\|")
    made = ancestry.where("relation = 'macro'").withColumn("path", F.filter("owner", lambda x: ~x.startswith("("))).join(placed, ["checkout", "path"]).select("checkout", F.col("fqn").alias("macro_owner"), parts[0].alias("relation"), parts[1].alias("name"), parts[2].alias("target"))
    called = body_calls.select("checkout", F.col("nesting").alias("path"), "name").distinct().join(placed, ["checkout", "path"]).select("checkout", "fqn", "name")
    landed = lookup(called.select("checkout", "fqn", F.lit("class").alias("side"), "name"), chains, methods).select("checkout", "fqn", "owner", "name")
    return landed.join(made.withColumnRenamed("macro_owner", "owner"), ["checkout", "owner", "name"]).select("checkout", F.col("fqn").alias("owner"), "relation", "target").distinct()


def nearest_variant(asked: DataFrame, variants: DataFrame) -> DataFrame:
    """asked (checkout, name, path) with the variant (checkout, name, variant, path) that shares most directories; a tie gives the name."""
    from carnelian.functions.scalars import shared_dirs

    rows = asked.join(variants.withColumnRenamed("path", "own"), ["checkout", "name"])
    near = F.rank().over(Window.partitionBy("checkout", "name", "path").orderBy(F.desc(shared_dirs(F.col("path"), F.col("own")))))
    best = rows.withColumn("_r", near).where("_r = 1").groupBy("checkout", "name", "path").agg(F.collect_set("variant").alias("v"))
    return best.select("checkout", "name", "path", F.when(F.size("v") == 1, F.element_at("v", 1)).otherwise(F.col("name")).alias("variant"))
