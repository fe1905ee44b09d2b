"""Receiver typing: an ordered cascade of evidence for what a call is sent to.

Each rung gives rows (call_id, fqn, side, via, agreeing, total, bound); the
first rung that names a type wins.  Every rung is a join on keys of the call's
own file or scope, so calls are never paired with one another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carnelian.functions.scalars import camelize, share
from carnelian.operators import chains as C
from carnelian.plans.lineage import cut

RUNGS = ("self", "const", "local:new", "local:const", "literal", "local:rescue", "sig", "finder", "chain", "chain:name", "receiver_name")
#: Class methods of a model that return the model.
FINDERS = ("find", "find_by", "find_by!", "find_or_create_by", "find_or_create_by!", "find_or_initialize_by", "create", "create!", "first", "last", "take", "first!", "last!", "take!", "build")
MOST_HOPS = 4


def _rung(df: DataFrame, rung: str, agreeing=None, total=None, bound: bool = False, side: str = "instance") -> DataFrame:
    return df.select("call_id", "fqn", (F.col("side") if "side" in df.columns else F.lit(side)).alias("side"), F.lit(rung).alias("via"), (agreeing if agreeing is not None else F.lit(1)).cast("int").alias("agreeing"), (total if total is not None else F.lit(1)).cast("int").alias("total"), F.lit(bound).alias("bound"))


def settle_values(assigns: DataFrame, scopes: DataFrame, names: DataFrame, chains: DataFrame, methods: DataFrame) -> DataFrame:
    """assign_id, fqn, side, rule: what each write makes.

    assigns: assign_id, checkout, oid, target, shape, value, nesting, singleton, line, col."""
    rows = assigns.join(scopes.select("checkout", F.col("path").alias("nesting"), "scopes"), ["checkout", "nesting"], "left").withColumn("scopes", F.coalesce("scopes", F.array().cast("array<string>")))
    constant = rows.where(F.col("shape").isin("new", "const", "rescued", "const_call")).withColumn("written", F.regexp_replace("value", r"\.[^.:]+$", ""))
    found = cut(C.resolve_constant(constant.select("assign_id", "checkout", "shape", "value", "written", "scopes"), names, chains).where("fqn IS NOT NULL"))
    made = found.where(F.col("shape").isin("new", "rescued")).select("assign_id", "fqn", F.lit("instance").alias("side"), F.when(F.col("shape") == "new", "local:new").otherwise("local:rescue").alias("rule"))
    held = found.where("shape = 'const'").select("assign_id", "fqn", F.lit("class").alias("side"), F.lit("local:const").alias("rule"))
    literal = rows.where("shape = 'literal'").select("assign_id", F.col("value").alias("fqn"), F.lit("instance").alias("side"), F.lit("literal").alias("rule"))
    called = found.where("shape = 'const_call'").withColumn("name", F.regexp_extract("value", r"\.([^.:]+)$", 1))
    sig = C.lookup(called.select("assign_id", "checkout", "fqn", F.lit("class").alias("side"), "name"), chains, methods).where("sig_returns IS NOT NULL")
    by_sig = cut(_returned(sig, names).select("assign_id", "fqn", F.lit("instance").alias("side"), F.lit("sig").alias("rule")))
    finder = called.where(F.col("name").isin(*FINDERS)).join(by_sig.select("assign_id"), "assign_id", "left_anti").select("assign_id", "fqn", F.lit("instance").alias("side"), F.lit("finder").alias("rule"))
    own = rows.where("shape = 'self_call' AND size(scopes) > 0").select("assign_id", "checkout", F.element_at("scopes", 1).alias("fqn"), F.when(F.col("singleton"), "class").otherwise("instance").alias("side"), F.col("value").alias("name"))
    by_own = _returned(C.lookup(own, chains, methods).where("sig_returns IS NOT NULL"), names).select("assign_id", "fqn", F.lit("instance").alias("side"), F.lit("sig").alias("rule"))
    return cut(reduce(DataFrame.unionByName, [made, held, literal, by_sig, finder, by_own]))


def _returned(landed: DataFrame, names: DataFrame) -> DataFrame:
    """landed with fqn replaced by the class its signature names, as written or within the owner's namespaces."""
    from carnelian.functions.scalars import prefixes, qualify, whole_name

    keys = [c for c in landed.columns if c != "fqn"]
    around = F.concat(F.array("owner"), F.reverse(prefixes(F.col("owner"))), F.array(F.lit("")))
    tries = landed.select(*keys, F.posexplode(around).alias("at", "scope")).withColumn("fqn", F.when(F.col("sig_returns").startswith("::"), whole_name(F.col("sig_returns"))).otherwise(qualify(F.col("scope"), F.col("sig_returns"))))
    hit = tries.join(names.select("checkout", "fqn"), ["checkout", "fqn"], "left_semi")
    return hit.groupBy(*keys).agg(F.min_by("fqn", "at").alias("fqn"))


def follow_same(assigns: DataFrame, settled: DataFrame) -> DataFrame:
    """settled with writes that copy another local: the last write of it before, at most MOST_HOPS on."""
    copies = assigns.where("shape = 'same'").select("assign_id", "checkout", "oid", "value", "nesting", "line", "col")
    writes = assigns.select("checkout", "oid", "nesting", F.col("target").alias("value"), F.col("assign_id").alias("from_id"), F.struct("line", "col").alias("at"))
    before = cut(copies.join(writes, ["checkout", "oid", "nesting", "value"]).where(F.col("at") < F.struct("line", "col")).groupBy("assign_id").agg(F.max_by("from_id", "at").alias("from_id")))
    out, at = settled, before
    for _ in range(MOST_HOPS):
        out = out.unionByName(at.join(settled.withColumnRenamed("assign_id", "from_id"), "from_id").select("assign_id", "fqn", "side", "rule"))
        at = cut(at.join(before.select(F.col("assign_id").alias("from_id"), F.col("from_id").alias("next")), "from_id").select("assign_id", F.col("next").alias("from_id")))
    return cut(out.dropDuplicates(["assign_id"]))


def type_receivers(calls: DataFrame, assigns: DataFrame, reaching: DataFrame, scopes: DataFrame, names: DataFrame, chains: DataFrame, methods: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """call_id, fqn, side, via, agreeing, total, bound, confidence of every call that some rung types.

    calls: call_id, checkout, oid and the columns of the calls table."""
    rows = calls.join(scopes.select("checkout", F.col("path").alias("nesting"), "scopes"), ["checkout", "nesting"], "left").withColumn("scopes", F.coalesce("scopes", F.array().cast("array<string>")))
    in_scope = rows.where(F.col("recv").isin("implicit", "self", "super") & (F.size("scopes") > 0))
    own = _rung(in_scope.withColumns({"fqn": F.element_at("scopes", 1), "side": F.when(F.col("singleton"), "class").otherwise("instance")}), "self", bound=True)
    main = _rung(rows.where((F.col("recv") == "implicit") & (F.size("scopes") == 0)).withColumns({"fqn": F.lit("Object"), "side": F.lit("instance")}), "self", bound=True)

    const = C.resolve_constant(rows.where("recv = 'const'").select("call_id", "checkout", F.col("recv_text").alias("written"), "scopes"), names, chains).where("fqn IS NOT NULL")
    if aliases is not None:
        const = const.join(aliases.select("checkout", "fqn", "namespace"), ["checkout", "fqn"], "left").withColumn("fqn", F.coalesce("namespace", "fqn"))
    # a constant that holds a value has no type of its own
    const = const.join(names.where("kind <> 'constant'").select("checkout", "fqn"), ["checkout", "fqn"], "left_semi")
    by_const = cut(_rung(const, "const", side="class"))

    settled = follow_same(assigns, settle_values(assigns, scopes, names, chains, methods))
    ids = assigns.select("assign_id", "checkout", "oid", "target", "nesting", F.col("line").alias("write_line"), F.col("col").alias("write_col"))
    local = rows.where("recv = 'local'").select("call_id", "checkout", "oid", F.col("recv_line").alias("read_line"), F.col("recv_col").alias("read_col"))
    reach = local.join(reaching, ["oid", "read_line", "read_col"]).join(ids.select("assign_id", "checkout", "oid", "write_line", "write_col"), ["checkout", "oid", "write_line", "write_col"], "left").select("call_id", "assign_id")
    ivar = rows.where("recv = 'ivar'").select("call_id", "checkout", "nesting", F.col("recv_text").alias("target")).join(ids.where(F.col("target").startswith("@")).select("assign_id", "checkout", "nesting", "target"), ["checkout", "nesting", "target"]).select("call_id", "assign_id")
    voted = cut(_vote(reach.unionByName(ivar), settled))

    literal = _rung(rows.where(F.col("recv") == "other").where(F.col("recv_text").isin("String", "Symbol", "Integer", "Float", "Array", "Hash", "Regexp", "Range", "Proc")).withColumn("fqn", F.col("recv_text")), "literal")
    chained = _chains(rows, own.unionByName(by_const).unionByName(voted), chains, methods, names)
    known = own.unionByName(main).unionByName(by_const).unionByName(voted).unionByName(literal).unionByName(chained)
    agreed = cut(_by_return_vote(rows, known, methods, names))
    guess = _by_name(rows, names, methods)
    rungs = [own, main, by_const, voted, literal, chained, agreed, guess]
    ordered = reduce(DataFrame.unionByName, [r.withColumn("rung", F.lit(k)) for k, r in enumerate(rungs)])
    best = ordered.groupBy("call_id").agg(F.min_by(F.struct("fqn", "side", "via", "agreeing", "total", "bound"), F.struct("rung", "via", "fqn")).alias("r")).select("call_id", "r.*")
    return best.withColumn("confidence", share(F.col("agreeing"), F.col("total")))


def _vote(reach: DataFrame, settled: DataFrame) -> DataFrame:
    """The type that most reaching writes make; ties go to the first by name."""
    votes = reach.join(settled, "assign_id", "left")
    total = votes.groupBy("call_id").agg(F.count("*").alias("total"))
    each = votes.where("fqn IS NOT NULL").groupBy("call_id", "fqn", "side").agg(F.count("*").alias("n"), F.min("rule").alias("rule"))
    best = each.groupBy("call_id").agg(F.min_by(F.struct("fqn", "side", "rule", "n"), F.struct(-F.col("n"), F.col("fqn"), F.col("side"))).alias("b"))
    return best.join(total, "call_id").select("call_id", "b.fqn", "b.side", F.col("b.rule").alias("via"), F.col("b.n").cast("int").alias("agreeing"), F.col("total").cast("int").alias("total"), F.lit(False).alias("bound"))


def _chains(rows: DataFrame, known: DataFrame, chains: DataFrame, methods: DataFrame, names: DataFrame) -> DataFrame:
    """A call on a call: what the inner one lands on says what it returns, MOST_HOPS deep."""
    place = rows.select(F.col("call_id").alias("inner_id"), "checkout", "oid", F.col("name").alias("inner"), F.col("line").alias("recv_line"), F.col("col").alias("recv_col"))
    outer = rows.where("recv = 'other' AND recv_line IS NOT NULL").select("call_id", "checkout", "oid", "recv_line", "recv_col").join(place, ["checkout", "oid", "recv_line", "recv_col"])
    out, at = None, known
    for _ in range(2):
        asked = outer.join(at.select(F.col("call_id").alias("inner_id"), "fqn", "side"), "inner_id").select("call_id", "checkout", "fqn", "side", F.col("inner").alias("name"))
        made = asked.where("side = 'class' AND name = 'new'").select("call_id", "fqn")
        sig = _returned(C.lookup(asked, chains, methods).where("sig_returns IS NOT NULL"), names).select("call_id", "fqn")
        declared = cut(made.unionByName(sig).dropDuplicates(["call_id"]))
        finder = asked.where((F.col("side") == "class") & F.col("name").isin(*FINDERS)).select("call_id", "fqn").join(declared, "call_id", "left_anti")
        step = cut(_rung(declared.unionByName(finder).dropDuplicates(["call_id"]), "chain"))
        out = step if out is None else out.unionByName(step)
        at = step
    return out.dropDuplicates(["call_id"])


def _by_return_vote(rows: DataFrame, known: DataFrame, methods: DataFrame, names: DataFrame) -> DataFrame:
    """A call on a call that nothing types: the class that all methods of the inner name return, as sure as they agree."""
    place = rows.select(F.col("call_id").alias("inner_id"), "checkout", "oid", F.col("name").alias("inner"), F.col("line").alias("recv_line"), F.col("col").alias("recv_col"))
    outer = rows.where("recv = 'other' AND recv_line IS NOT NULL").select("call_id", "checkout", "oid", "recv_line", "recv_col").join(place, ["checkout", "oid", "recv_line", "recv_col"])
    untyped = outer.join(known.select(F.col("call_id").alias("inner_id")), "inner_id", "left_anti")
    vote = C.return_vote(methods).select("checkout", F.col("name").alias("inner"), "returns", "agreeing", "total")
    found = untyped.join(vote, ["checkout", "inner"]).join(names.where("kind = 'class'").select("checkout", F.col("fqn").alias("returns")), ["checkout", "returns"], "left_semi")
    return _rung(found.withColumnRenamed("returns", "fqn"), "chain:name", F.col("agreeing"), F.col("total"))


def _by_name(rows: DataFrame, names: DataFrame, methods: DataFrame) -> DataFrame:
    """widget.save: the class of that name, if it answers; other classes of the name are rivals."""
    word = F.regexp_replace("recv_text", "^@+", "")
    asked = rows.where(F.col("recv").isin("local", "ivar") & F.col("recv_text").isNotNull()).select("call_id", "checkout", "name", camelize(word).alias("leaf"))
    classes = names.where("kind = 'class'").select("checkout", "fqn", F.element_at(F.split("fqn", "::"), -1).alias("leaf"))
    answers = methods.where("side = 'instance'").select("checkout", F.col("owner").alias("fqn"), "name").distinct()
    hit = asked.join(classes, ["checkout", "leaf"]).join(answers, ["checkout", "fqn", "name"], "left_semi")
    one = hit.groupBy("call_id").agg(F.count("*").alias("n"), F.min("fqn").alias("fqn"))
    return _rung(one, "receiver_name", total=F.col("n") + 1)
