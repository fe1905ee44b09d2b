"""References narrowed by receiver: every call of a queried name, judged.

A reference is confirmed, possible or excluded, with the reason.  The decision
is one ordered list over columns that earlier joins supply, so it stays inside
generated code; what can't be known (a null argument count, an unresolved
ancestor) never excludes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carnelian.functions.scalars import accepts, shared_dirs
from carnelian.operators import chains as C
from carnelian.plans.lineage import cut

TIERS = ("confirmed", "possible", "excluded")
MOST_CANDIDATES = 8


def parse_query(text: Column) -> Column:
    """Owner#m, Owner.m or m as struct<owner, side, name>; a bare name has neither owner nor side."""
    owner = F.nullif(F.regexp_extract(text, r"^([A-Z:][\w:]*)[#.]", 1), F.lit(""))
    mark = F.regexp_extract(text, r"^[A-Z:][\w:]*([#.])", 1)
    name = F.regexp_replace(text, r"^[A-Z:][\w:]*[#.]", "")
    return F.struct(F.regexp_replace(owner, "^::", "").alias("owner"), F.when(mark == "#", "instance").when(mark == ".", "class").alias("side"), name.alias("name"))


def gather(queries: DataFrame, calls: DataFrame, receivers: DataFrame, chains: DataFrame, methods: DataFrame, names: DataFrame, dynamic: DataFrame | None = None) -> DataFrame:
    """One row for each query and call of its name: tier, why, via, proximity.

    queries: query, owner, side, name.  calls: call_id, checkout, path, scopes and
    the columns of the calls table.  dynamic: checkout, owner, shape of classes
    that make methods at run time.  The join is on the name; a name that a third
    of all calls have is split by the engine's skew handling."""
    roots = F.broadcast(chains.select("checkout").distinct())
    target = cut(C.lookup(queries.where("owner IS NOT NULL").join(roots, how="cross").select("query", "checkout", F.col("owner").alias("fqn"), "side", "name"), chains, methods).select("query", "checkout", F.col("owner").alias("target"), F.col("owner_side").alias("target_side"), F.col("params").alias("target_params"), F.col("path").alias("target_path")))
    typed_by = receivers.withColumnsRenamed({"fqn": "recv_fqn", "side": "recv_side"})
    sites = named_calls(calls).join(queries.withColumnsRenamed({"side": "asked_side", "owner": "asked_owner"}), "name").join(target, ["query", "checkout"], "left").join(typed_by, "call_id", "left")
    sites = cut(sites.unionByName(_constructions(queries, target, calls, typed_by, chains, methods), allowMissingColumns=True))
    typed = sites.where("recv_fqn IS NOT NULL AND recv <> 'super' AND landed IS NULL").select("query", "call_id", "checkout", F.col("recv_fqn").alias("fqn"), F.col("recv_side").alias("side"), "name")
    landed = C.lookup(typed, chains, methods).select("query", "call_id", F.col("owner").alias("landed_"), F.col("owner_side").alias("landed_side_"))
    above = sites.where("recv = 'super' AND recv_fqn IS NOT NULL").select("query", "call_id", "checkout", F.col("recv_fqn").alias("fqn"), F.col("recv_side").alias("side"), "name")
    by_super = C.lookup(above, chains, methods, after_owner=True).select("query", "call_id", F.col("owner").alias("landed_"), F.col("owner_side").alias("landed_side_"))
    rows = sites.join(cut(landed.unionByName(by_super)), ["query", "call_id"], "left")
    rows = rows.join(_super_of_modules(sites, names, chains, methods), ["query", "call_id"], "left")
    rows = cut(rows.withColumns({"landed": F.coalesce("landed", "landed_"), "landed_side": F.coalesce("landed_side", "landed_side_")}).drop("landed_", "landed_side_"))

    links = C.exploded(chains.where("side = 'instance'")).select("checkout", "fqn", "owner").distinct()
    below = links.select("checkout", F.col("owner").alias("recv_fqn"), F.col("fqn").alias("target")).withColumn("reaches_below", F.lit(True))
    inherits = links.select("checkout", F.col("fqn").alias("recv_fqn"), F.col("owner").alias("target")).withColumn("inherits", F.lit(True))
    rows = rows.join(below, ["checkout", "recv_fqn", "target"], "left").join(inherits, ["checkout", "recv_fqn", "target"], "left")
    whole = chains.where("side = 'instance'").select("checkout", F.col("fqn").alias("recv_fqn"), (F.size("unresolved") == 0).alias("complete"))
    missing = methods.where("name = 'method_missing' AND side = 'instance'").select("checkout", F.col("owner").alias("target_m")).distinct()
    forwards = links.join(missing.withColumnRenamed("target_m", "owner"), ["checkout", "owner"], "left_semi").select("checkout", F.col("fqn").alias("recv_fqn")).distinct().withColumn("forwards", F.lit(True))
    rows = rows.join(whole, ["checkout", "recv_fqn"], "left").join(forwards, ["checkout", "recv_fqn"], "left")
    rows = _makers(rows, links, dynamic)
    home = links.select("checkout", F.col("fqn").alias("home"), F.col("owner").alias("target")).withColumn("home_inherits", F.lit(True))
    rows = rows.withColumn("home", F.when(F.size("scopes") > 0, F.element_at("scopes", 1))).join(home, ["checkout", "home", "target"], "left")
    return _judge(rows).select("query", "call_id", "checkout", "path", "line", "col", "name", "recv", "via", "recv_fqn", "landed", "target", "tier", "why", "proximity", "symbol")


def _makers(rows: DataFrame, links: DataFrame, dynamic: DataFrame | None) -> DataFrame:
    """rows with makes: an ancestor makes methods whose names its source doesn't say, and the shape fits."""
    from carnelian.functions.scalars import shape_matches

    if dynamic is None:
        return rows.withColumn("makes", F.lit(None).cast("boolean"))
    marked = links.join(dynamic, ["checkout", "owner"]).select("checkout", F.col("fqn").alias("recv_fqn"), "shape").distinct()
    named = rows.where("landed IS NULL AND recv_fqn IS NOT NULL").select("checkout", "recv_fqn", "name").distinct()
    fits = named.join(marked, ["checkout", "recv_fqn"]).where((F.col("shape") == "*") | shape_matches(F.col("shape"), F.col("name"))).select("checkout", "recv_fqn", "name").distinct()
    return rows.join(fits.withColumn("makes", F.lit(True)), ["checkout", "recv_fqn", "name"], "left")


def named_calls(calls: DataFrame) -> DataFrame:
    """calls, and once more under each name that a matcher asks by: be_x asks x?, have_x asks has_x?."""
    bare = calls.where("recv = 'implicit'")
    be = bare.where(F.col("name").rlike("^be_(an?_)?[a-z]")).withColumn("name", F.concat(F.regexp_replace("name", "^be_(an?_)?", ""), F.lit("?")))
    have = bare.where(F.col("name").rlike("^have_[a-z]")).withColumn("name", F.concat(F.lit("has_"), F.regexp_replace("name", "^have_", ""), F.lit("?")))
    asked = be.unionByName(have).withColumns({"recv": F.lit("other"), "symbol": F.lit(True), "argc": F.lit(None).cast("int")})
    return calls.unionByName(asked)


def _super_of_modules(sites: DataFrame, names: DataFrame, chains: DataFrame, methods: DataFrame) -> DataFrame:
    """query, call_id, some_land, all_land: where super in a module leads, over the classes that mix it in."""
    modules = names.where("kind = 'module'").select("checkout", F.col("fqn").alias("recv_fqn"))
    own = sites.where("recv = 'super' AND recv_side = 'instance' AND target IS NOT NULL").join(modules, ["checkout", "recv_fqn"], "left_semi")
    mixing = C.includers(chains, names).select("checkout", F.col("module").alias("recv_fqn"), F.explode("classes").alias("fqn"))
    each = own.join(mixing, ["checkout", "recv_fqn"]).select("query", "call_id", "checkout", "fqn", F.lit("instance").alias("side"), "name", F.col("recv_fqn").alias("after"), F.col("target").alias("wanted"))
    landed = C.lookup(each, chains, methods, after_owner=True).select("query", "call_id", (F.col("owner") == F.col("wanted")).alias("hit"))
    return landed.groupBy("query", "call_id").agg(F.bool_or("hit").alias("some_land"), F.bool_and("hit").alias("all_land"))


def _constructions(queries: DataFrame, target: DataFrame, calls: DataFrame, typed_by: DataFrame, chains: DataFrame, methods: DataFrame) -> DataFrame:
    """Sites of X.new that run a queried initialize.

    Only sites that run it are rows: every other new of a program is one of
    another class, and listing them for each initialize would pair the two."""
    made = calls.where("name = 'new'").join(typed_by.where("recv_side = 'class'"), "call_id")
    asked = made.select("call_id", "checkout", F.col("recv_fqn").alias("fqn"), F.lit("instance").alias("side"), F.lit("initialize").alias("name"))
    run = C.lookup(asked, chains, methods).select("call_id", "checkout", F.col("owner").alias("target"), F.col("owner_side").alias("target_side"), F.col("owner").alias("landed"), F.col("owner_side").alias("landed_side"))
    wanted = target.join(queries.where("name = 'initialize'").select("query"), "query", "left_semi")
    return run.join(wanted, ["checkout", "target", "target_side"]).join(made.drop("checkout", "name"), "call_id").withColumn("name", F.lit("initialize"))


def _judge(rows: DataFrame) -> DataFrame:
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    bare = F.col("target").isNull()
    typed = F.col("recv_fqn").isNotNull() & ~F.col("symbol")
    found = F.col("landed").isNotNull()
    match = found & (F.col("landed") == F.col("target")) & (F.col("landed_side") == F.col("target_side"))
    sure = F.col("agreeing") == F.col("total")
    fits = accepts(F.col("target_params"), F.col("argc")) | F.col("argc").isNull()
    same_ns = F.size(F.array_intersect(F.slice(F.split("target", "::"), 1, F.greatest(F.size(F.split("target", "::")) - 1, F.lit(0))), F.flatten(F.transform("scopes", lambda s: F.split(s, "::"))))) > 0
    proximity = F.when(F.col("symbol"), 4).when(yes("home_inherits"), 0).when(F.col("path") == F.col("target_path"), 1).when(same_ns, 2).otherwise(3)
    untyped = F.when(~fits, F.struct(F.lit("excluded").alias("tier"), F.lit("arity").alias("why"))).otherwise(F.struct(F.lit("possible").alias("tier"), F.when(F.col("symbol"), "symbol").otherwise("untyped receiver").alias("why")))
    rule = lambda tier, why: F.struct(F.lit(tier).alias("tier"), F.lit(why).alias("why"))
    decision = (
        F.when(bare, F.when(typed & found, rule("confirmed", "defined")).otherwise(rule("possible", "untyped receiver")))
        .when((F.col("recv") == "super") & F.col("some_land").isNotNull() & ~match, F.when(F.col("all_land"), rule("confirmed", "super of every class mixing it in")).when(F.col("some_land"), rule("possible", "super of a class mixing it in")).otherwise(rule("excluded", "different_owner")))
        .when(F.col("recv") == "super", F.when(match, rule("confirmed", "super")).when(found, rule("excluded", "different_owner")).when(yes("complete"), rule("excluded", "no_such_method")).otherwise(rule("possible", "super of an unknown ancestor")))
        .when(~typed, untyped)
        .when((F.col("via") == "receiver_name") & ~match, rule("possible", "a guess by name"))
        .when(match & sure, rule("confirmed", "lands on it"))
        .when(match, rule("possible", "one of several types"))
        .when(~sure & ~match & (F.col("agreeing") < F.col("total")), rule("possible", "one of several types"))
        .when(yes("bound") & yes("reaches_below") & (F.col("recv_side") == F.col("target_side")), rule("possible", "a subclass may run it"))
        .when(found, rule("excluded", "different_owner"))
        .when(yes("forwards"), rule("possible", "method_missing"))
        .when(yes("makes"), rule("possible", "made at run time"))
        .when(yes("complete"), rule("excluded", "no_such_method"))
        .otherwise(rule("possible", "an ancestor is unknown"))
    )
    return rows.withColumn("judged", decision).withColumns({"tier": F.col("judged.tier"), "why": F.col("judged.why"), "proximity": F.when(F.col("judged.tier") == "possible", proximity)}).drop("judged")


def counts(references: DataFrame, by: list[str]) -> DataFrame:
    """Confirmed, possible, excluded and the reasons for excluding, for each group."""
    one = lambda tier, why=None: F.count_if((F.col("tier") == tier) & (F.lit(True) if why is None else F.col("why") == why))
    return references.groupBy(*by).agg(one("confirmed").alias("confirmed"), one("possible").alias("possible"), one("excluded").alias("excluded"), one("excluded", "different_owner").alias("different_owner"), one("excluded", "no_such_method").alias("no_such_method"), one("excluded", "arity").alias("arity"))


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "confirmed", 0).when(tier == "possible", 1).otherwise(2)


def ordered(references: DataFrame) -> DataFrame:
    return references.orderBy(tier_rank(F.col("tier")), F.coalesce("proximity", F.lit(0)), "path", "line", "col")


def best(references: DataFrame, limit: int) -> DataFrame:
    """The first references by evidence: a top-k report."""
    return ordered(references).limit(limit)


def demote_while_loading(references: DataFrame, loading: bool) -> DataFrame:
    """While a first load is incomplete nothing is excluded."""
    return references.withColumn("tier", F.when(F.col("tier") == "excluded", "possible").otherwise(F.col("tier"))) if loading else references


def residue(asked: DataFrame, methods: DataFrame, chains: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """Ranked candidates for calls that nothing typed: at most most for each, with the confidence.

    asked: call_id, checkout, path, name, argc, scopes, recv, recv_text, typed.
    Ranks: fits and inherited by the enclosing class; the receiver is named after
    the owner; a shared namespace; the same file; fits; doesn't fit."""
    from carnelian.functions.scalars import camelize

    links = C.exploded(chains.where("side = 'instance'")).select("checkout", F.col("fqn").alias("home"), "owner").distinct().withColumn("inherited", F.lit(True))
    rows = asked.withColumn("home", F.when(F.size("scopes") > 0, F.element_at("scopes", 1))).join(methods.select("checkout", "name", "owner", "side", "params", F.col("path").alias("def_path"), F.col("line").alias("def_line"), "is_rbi"), ["checkout", "name"])
    rows = rows.join(links, ["checkout", "home", "owner"], "left")
    fits = accepts(F.col("params"), F.col("argc"))
    named = F.element_at(F.split("owner", "::"), -1) == camelize(F.regexp_replace(F.coalesce("recv_text", F.lit("")), "^@+", ""))
    space = F.slice(F.split("owner", "::"), 1, F.greatest(F.size(F.split("owner", "::")) - 1, F.lit(0)))
    shares = F.size(F.array_intersect(space, F.flatten(F.transform("scopes", lambda s: F.split(s, "::"))))) > 0
    tier = F.when(~fits, 5).when(F.coalesce("inherited", F.lit(False)), 0).when(named, 1).when(shares, 2).when(F.col("path") == F.col("def_path"), 3).otherwise(4)
    rows = rows.withColumn("rank_tier", tier)
    order = Window.partitionBy("call_id").orderBy(F.col("is_rbi"), "rank_tier", -shared_dirs(F.col("path"), F.col("def_path")), "owner", "def_path", "def_line")
    ranked = rows.withColumn("n", F.count("*").over(Window.partitionBy("call_id"))).withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
    on_self = F.col("recv").isin("implicit", "self")
    confidence = F.when(F.col("typed") & ~on_self, 0.2).when(on_self, 0.7).when(F.col("n") <= 3, 0.7).otherwise(0.2)
    return ranked.select("call_id", "at", "owner", "side", F.col("def_path").alias("path"), F.col("def_line").alias("line"), F.col("rank_tier").alias("tier"), F.col("n").alias("definitions"), confidence.alias("confidence"))


def answers(calls: DataFrame, receivers: DataFrame, chains: DataFrame, methods: DataFrame) -> DataFrame:
    """status, confidence, via and landing of every call: resolved, ambiguous or residue."""
    # what X.new runs is X's initialize
    new = (F.col("name") == "new") & (F.col("side") == "class")
    typed = calls.join(receivers, "call_id", "left")
    asked = typed.where("fqn IS NOT NULL AND recv <> 'super'").select("call_id", "checkout", "fqn", "side", "name")
    direct = C.lookup(asked, chains, methods)
    made = C.lookup(asked.where(new).select("call_id", "checkout", "fqn", F.lit("instance").alias("side"), F.lit("initialize").alias("name")), chains, methods)
    above = C.lookup(typed.where("fqn IS NOT NULL AND recv = 'super'").select("call_id", "checkout", "fqn", "side", "name"), chains, methods, after_owner=True)
    keep = lambda df: df.select("call_id", "owner", "owner_side", F.col("path").alias("def_path"), F.col("line").alias("def_line"), F.col("kind_via").alias("defined_via"))
    landed = keep(direct).unionByName(keep(above))
    landed = landed.unionByName(keep(made).join(landed.select("call_id"), "call_id", "left_anti"))
    rows = typed.join(landed, "call_id", "left")
    status = F.when(F.col("owner").isNull(), "residue").when(F.col("agreeing") < F.col("total"), "ambiguous").otherwise("resolved")
    return rows.select("call_id", "checkout", "path", "name", "line", "col", status.alias("status"), F.when(F.col("owner").isNotNull(), F.col("confidence")).otherwise(0.0).alias("confidence"), "via", F.col("fqn").alias("receiver"), "owner", "owner_side", "def_path", "def_line", "defined_via")


def includer_votes(calls: DataFrame, receivers: DataFrame, names: DataFrame, chains: DataFrame, methods: DataFrame) -> DataFrame:
    """call_id, owner, agreeing, total: for a module's call on itself that the module doesn't answer, the
    owner that most classes mixing it in land on."""
    modules = names.where("kind = 'module'").select("checkout", "fqn")
    own = calls.join(receivers.where("via = 'self' AND side = 'instance'"), "call_id").join(modules, ["checkout", "fqn"], "left_semi")
    direct = C.lookup(own.select("call_id", "checkout", "fqn", "side", "name"), chains, methods)
    open_ = own.join(direct.select("call_id"), "call_id", "left_anti").select("call_id", "checkout", F.col("fqn").alias("module"), "name")
    mixing = C.includers(chains, names).select("checkout", "module", F.explode("classes").alias("fqn"))
    each = open_.join(mixing, ["checkout", "module"]).withColumn("side", F.lit("instance"))
    total = each.groupBy("call_id").agg(F.count("*").alias("total"))
    votes = C.lookup(each.select("call_id", "checkout", "fqn", "side", "name"), chains, methods).groupBy("call_id", "owner").agg(F.count("*").alias("agreeing"))
    best = votes.groupBy("call_id").agg(F.min_by(F.struct("owner", "agreeing"), F.struct(-F.col("agreeing"), F.col("owner"))).alias("b"))
    return best.join(total, "call_id").select("call_id", "b.owner", F.col("b.agreeing").alias("agreeing"), "total")


def follow_delegates(answered: DataFrame, methods: DataFrame, chains: DataFrame, names: DataFrame) -> DataFrame:
    """answers that land on a delegator with where it leads: the target's type is what its own method or association returns.

    answered: call_id, checkout, owner, owner_side, name.  Adds to_owner, null where the target isn't typed."""
    from carnelian.functions.scalars import camelize

    via = methods.where("kind_via = 'delegate' AND target IS NOT NULL").select("checkout", "owner", F.col("side").alias("owner_side"), "name", F.regexp_extract("target", r"^(.*)\.([^.]+)$", 1).alias("to"), F.regexp_extract("target", r"^(.*)\.([^.]+)$", 2).alias("to_name"))
    rows = answered.join(via, ["checkout", "owner", "owner_side", "name"])
    declared = C.lookup(rows.select("call_id", "checkout", F.col("owner").alias("fqn"), F.lit("instance").alias("side"), F.col("to").alias("name")), chains, methods).select("call_id", "sig_returns")
    typed = rows.join(declared, "call_id", "left").withColumn("leaf", F.coalesce("sig_returns", camelize(F.col("to"))))
    known = typed.join(names.where("kind = 'class'").select("checkout", F.col("fqn").alias("leaf")), ["checkout", "leaf"], "left_semi")
    landed = C.lookup(known.select("call_id", "checkout", F.col("leaf").alias("fqn"), F.lit("instance").alias("side"), F.col("to_name").alias("name")), chains, methods).select("call_id", F.col("owner").alias("to_owner"), F.col("path").alias("to_path"), F.col("line").alias("to_line"))
    return rows.select("call_id", "name", "owner", "to", "to_name").join(landed, "call_id", "left")


def call_hierarchy(references: DataFrame, defs: DataFrame) -> DataFrame:
    """incoming: confirmed references by the innermost definition around them."""
    around = enclosing(references.where("tier = 'confirmed'").select("query", "call_id", "checkout", "path", "line"), defs)
    return around.groupBy("query", "checkout", "path", F.col("def_name").alias("caller"), "def_line").agg(F.count("*").alias("calls"))


def enclosing(places: DataFrame, defs: DataFrame) -> DataFrame:
    """places (checkout, path, line, ...) with the innermost method whose lines hold them.

    Spans of a file are joined on the file, and the narrowest is taken."""
    keys = places.columns
    spans = defs.where("kind = 'method'").select("checkout", "path", F.col("name").alias("def_name"), F.col("line").alias("def_line"), F.col("end_line").alias("def_end"))
    rows = places.join(spans, ["checkout", "path"]).where("line BETWEEN def_line AND def_end")
    return rows.groupBy(*keys).agg(F.min_by(F.struct("def_name", "def_line", "def_end"), F.struct(F.col("def_end") - F.col("def_line"), -F.col("def_line"), "def_name")).alias("d")).select(*keys, "d.*")


def last_write_before(reads: DataFrame, writes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each read the last write of its key before it: a backward as-of join, as one window over both."""
    both = reads.withColumn("is_write", F.lit(0)).withColumn("written", F.lit(None).cast(writes.schema["written"].dataType)).unionByName(writes.withColumn("is_write", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(*order, F.col("is_write")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("last_write", F.last("written", ignorenulls=True).over(w)).where("is_write = 0").drop("is_write", "written")


def complete(chains: DataFrame, methods: DataFrame, fqn: str, side: str, prefix: str = "", most: int = 300) -> DataFrame:
    """Names that can be called on a receiver, the nearest owner of each, at most most."""
    links = C.exploded(chains.where((F.col("fqn") == fqn) & (F.col("side") == side))).withColumnRenamed("owner_side", "oside")
    rows = links.join(methods.withColumnRenamed("side", "oside"), ["checkout", "owner", "oside"]).where(F.col("name").startswith(prefix) & (F.col("visibility") == "public"))
    first = rows.groupBy("checkout", "name").agg(F.min("pos").alias("depth"), F.min_by("owner", "pos").alias("owner"))
    return first.orderBy("depth", "name").limit(most)


def overriding(methods: DataFrame, chains: DataFrame) -> DataFrame:
    """checkout, owner, side, name, ancestor: methods that an ancestor defines too (the nearest)."""
    links = C.exploded(chains)
    own = links.where("owner = fqn AND owner_side = side").select("checkout", "fqn", "side", F.col("pos").alias("own_pos"))
    mine = methods.select("checkout", F.col("owner").alias("fqn"), "side", "name").distinct()
    above = mine.join(links, ["checkout", "fqn", "side"]).join(own, ["checkout", "fqn", "side"]).where("pos > own_pos")
    hit = above.join(methods.select("checkout", "owner", F.col("side").alias("owner_side"), "name").distinct(), ["checkout", "owner", "owner_side", "name"])
    return hit.groupBy("checkout", F.col("fqn").alias("owner"), "side", "name").agg(F.min_by(F.col("owner"), "pos").alias("ancestor"))
