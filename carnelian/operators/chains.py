"""Ancestor chains, and lookups along them.

Chains are made a checkout at a time: order and cycles decide the result, and a
checkout's namespace is bounded by its source, so each is one group of one
task.  Lookups are joins of exploded chains with methods, by name first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carnelian.functions.scalars import qualify

CHAIN = "checkout string, fqn string, side string, chain array<struct<owner: string, side: string>>, unresolved array<string>"


class Graph:
    """Names of one checkout with their ordered edges."""

    def __init__(self, kinds: dict[str, str], superclass: dict[str, str | None], unknown: dict[str, list[str]], mixins: dict[str, list[tuple[str, str]]]):
        """mixins: by owner, (relation, target) in order; unknown: spellings that nothing was found for."""
        self.kinds, self.superclass, self.unknown, self.mixins = kinds, superclass, unknown, mixins
        self.done: dict[str, list[str]] = {}
        self.truncated: dict[str, set[str]] = {}

    def parent(self, name: str) -> str | None:
        if self.superclass.get(name):
            return self.superclass[name]
        return "Object" if self.kinds.get(name) == "class" and name not in ("Object", "BasicObject") and name not in self.unknown else None

    def instance(self, name: str, busy: tuple[str, ...] = ()) -> list[str]:
        """Prepends, itself, includes, then the superclass's chain.

        A name that is asked for while it is being made has no chain; chains of
        names on a cycle depend on where one begins, so they aren't remembered."""
        if name in busy:
            return []
        if name in self.done:
            return self.done[name]
        inner = (*busy, name)
        above = self.parent(name)
        parent = self.instance(above, inner) if above and above != name else []
        prepends: list[str] = []
        includes: list[str] = []
        for relation, target in self.mixins.get(name, ()):
            if relation not in ("include", "prepend"):
                continue
            ids = self.instance(target, inner) or ([target] if target not in inner else [])
            if relation == "prepend":
                if any(i not in prepends for i in ids):
                    prepends = [*ids, *(p for p in prepends if p not in set(ids))]
            else:
                held = {*prepends, *includes, *parent}
                includes = [*(i for i in ids if i not in held), *includes]
        chain = [*prepends, name, *includes, *parent]
        if not self._cyclic(name):
            self.done[name] = chain
        return chain

    def _cyclic(self, name: str) -> bool:
        seen, stack = set(), [name]
        while stack:
            at = stack.pop()
            for to in [self.parent(at), *(t for _, t in self.mixins.get(at, ()))]:
                if to == name:
                    return True
                if to and to not in seen:
                    seen.add(to)
                    stack.append(to)
        return False

    def superclasses(self, name: str) -> list[str]:
        out, at = [], name
        while at and at not in out:
            out.append(at)
            at = self.parent(at)
        return out

    def class_side(self, name: str) -> list[tuple[str, str]]:
        """Singleton prepends, own singleton, extends (last first) and concerns' ClassMethods of each superclass; then Class or Module."""
        out: list[tuple[str, str]] = []
        for at in self.superclasses(name):
            mixed = self.mixins.get(at, ())
            for relation, target in reversed([m for m in mixed if m[0] == "singleton_prepend"]):
                out += [(o, "instance") for o in self.instance(target)]
            out.append((at, "class"))
            for relation, target in reversed([m for m in mixed if m[0] == "extend"]):
                out += [(o, "instance") for o in self.instance(target)] if target != at else [(at, "instance")]
            if self.kinds.get(at) == "class" or at != name:
                for module in self.instance(at):
                    if module != at and f"{module}::ClassMethods" in self.kinds and self.kinds.get(module) == "module" and module not in self.superclasses(at):
                        out += [(o, "instance") for o in self.instance(f"{module}::ClassMethods")]
        tail = "Class" if self.kinds.get(name) == "class" else "Module"
        if tail in self.kinds:
            out += [(o, "instance") for o in self.instance(tail)]
        return list(dict.fromkeys(out))

    def unresolved(self, chain: list[str]) -> list[str]:
        return list(dict.fromkeys(u for name in chain for u in self.unknown.get(name, ())))


def _kernel(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("n")
    kinds = {r.fqn: r.kind for r in rows.itertuples() if r.what == "name"}
    superclass: dict = {}
    unknown: dict = {}
    mixins: dict = {}
    for r in rows.itertuples():
        if r.what == "superclass":
            if isinstance(r.target, str) and r.target != r.fqn:
                superclass[r.fqn] = r.target
            else:
                unknown.setdefault(r.fqn, []).append(r.written)
        elif r.what == "edge":
            if isinstance(r.target, str):
                mixins.setdefault(r.fqn, []).append((r.kind, r.target))
            elif r.kind in ("include", "prepend"):
                unknown.setdefault(r.fqn, []).append(r.written)
    graph, out = Graph(kinds, superclass, unknown, mixins), []
    checkout = rows["checkout"].iloc[0]
    for name in kinds:
        chain = graph.instance(name)
        missing = graph.unresolved(chain)
        out.append((checkout, name, "instance", [{"owner": o, "side": "instance"} for o in chain], missing))
        out.append((checkout, name, "class", [{"owner": o, "side": s} for o, s in graph.class_side(name)], missing))
    return pd.DataFrame(out, columns=["checkout", "fqn", "side", "chain", "unresolved"])


def linearize(names: DataFrame, edges: DataFrame, superclasses: DataFrame) -> DataFrame:
    """checkout, fqn, side, chain, unresolved for every name.

    names: checkout, fqn, kind; edges: checkout, owner, relation, target, resolved, ord;
    superclasses: checkout, owner, superclass, written."""
    one = names.select("checkout", F.lit("name").alias("what"), "fqn", F.when(F.col("kind") == "constant", "constant").otherwise(F.col("kind")).alias("kind"), F.lit(None).cast("string").alias("target"), F.lit("").alias("written"), F.lit(0).cast("bigint").alias("n"))
    two = superclasses.select("checkout", F.lit("superclass").alias("what"), F.col("owner").alias("fqn"), F.lit("").alias("kind"), F.col("superclass").alias("target"), "written", F.lit(0).cast("bigint").alias("n"))
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("checkout", "owner").orderBy("ord")).cast("bigint")
    three = edges.where(F.col("relation").isin("include", "prepend", "extend", "singleton_prepend")).withColumn("n", place).select("checkout", F.lit("edge").alias("what"), F.col("owner").alias("fqn"), F.col("relation").alias("kind"), F.col("resolved").alias("target"), F.col("target").alias("written"), "n")
    return one.unionByName(two).unionByName(three).groupBy("checkout").applyInPandas(_kernel, CHAIN)


def exploded(chains: DataFrame) -> DataFrame:
    """checkout, fqn, side, pos, owner, owner_side"""
    return chains.select("checkout", "fqn", "side", F.posexplode("chain").alias("pos", "link")).select("checkout", "fqn", "side", "pos", F.col("link.owner").alias("owner"), F.col("link.side").alias("owner_side"))


def ancestors(chains: DataFrame, fqn: str) -> DataFrame:
    return exploded(chains.where((F.col("fqn") == fqn) & (F.col("side") == "instance"))).select("checkout", "pos", "owner").orderBy("checkout", "pos")


def inherits(pairs: DataFrame, chains: DataFrame) -> DataFrame:
    """pairs (checkout, fqn, ancestor) of which the second is in the chain of the first."""
    links = exploded(chains.where("side = 'instance'")).select("checkout", "fqn", F.col("owner").alias("ancestor"))
    return pairs.join(links.distinct(), ["checkout", "fqn", "ancestor"], "left_semi")


def includers(chains: DataFrame, names: DataFrame) -> DataFrame:
    """checkout, module, classes: every class whose chain holds the module."""
    modules = names.where("kind = 'module'").select("checkout", F.col("fqn").alias("owner"))
    classes = names.where("kind = 'class'").select("checkout", "fqn")
    held = exploded(chains.where("side = 'instance'")).join(modules, ["checkout", "owner"], "left_semi").join(classes, ["checkout", "fqn"], "left_semi")
    return held.groupBy("checkout", F.col("owner").alias("module")).agg(F.array_sort(F.collect_set("fqn")).alias("classes"))


def mixers(edges: DataFrame, names: DataFrame) -> DataFrame:
    """checkout, module, mixer: classes that mix the module in, themselves or by other modules."""
    from carnelian.plans.lineage import cut

    mixed = edges.where(F.col("relation").isin("include", "prepend", "extend") & F.col("resolved").isNotNull()).select("checkout", F.col("resolved").alias("module"), F.col("owner").alias("mixer")).distinct()
    reach = cut(mixed)
    while True:
        more = reach.join(mixed.select("checkout", F.col("module").alias("mixer"), F.col("mixer").alias("next")), ["checkout", "mixer"]).select("checkout", "module", F.col("next").alias("mixer"))
        fresh = cut(more.distinct().join(reach, ["checkout", "module", "mixer"], "left_anti"))
        if fresh.isEmpty():
            break
        reach = cut(reach.unionByName(fresh))
    return reach.join(names.where("kind = 'class'").select("checkout", F.col("fqn").alias("mixer")), ["checkout", "mixer"], "left_semi").select("checkout", "module", "mixer")


def lookup(asked: DataFrame, chains: DataFrame, methods: DataFrame, after_owner: bool = False) -> DataFrame:
    """asked (checkout, fqn, side, name[, from_pos]) with the method that it lands on.

    methods: checkout, owner, side, name, is_rbi, ord, and whatever is wanted of a
    landing.  Source is preferred to stubs along the whole chain; then the
    nearest owner; then the definition that is read last.  after_owner: only
    what stands behind fqn itself, as for super, or behind the owner in a column
    named after."""
    keys = [c for c in asked.columns]
    extra = [c for c in methods.columns if c not in ("checkout", "owner", "side", "name", "is_rbi", "ord")]
    # an owner's last definition is found before anything is joined, so that a
    # name which is defined often doesn't multiply rows
    named = methods.join(asked.select("name").distinct(), "name", "left_semi")
    last = named.groupBy("checkout", "owner", F.col("side").alias("owner_side"), "name", "is_rbi").agg(F.max_by(F.struct(F.lit(0).alias("_"), *extra), "ord").alias("landing"))
    links = exploded(chains)
    rows = asked.join(links, ["checkout", "fqn", "side"])
    if after_owner:
        behind = F.col("after") if "after" in keys else F.col("fqn")
        place = links.select("checkout", "fqn", "side", F.col("owner").alias("_own"), F.col("pos").alias("own_pos"))
        rows = rows.withColumn("_own", behind).join(place, ["checkout", "fqn", "side", "_own"]).where("pos > own_pos").drop("own_pos", "_own")
    found = rows.join(last, ["checkout", "owner", "owner_side", "name"])
    best = found.groupBy(*keys).agg(F.min_by(F.struct("owner", "owner_side", "landing"), F.struct("is_rbi", "pos")).alias("b"))
    return best.select(*keys, "b.owner", "b.owner_side", *[F.col(f"b.landing.{c}").alias(c) for c in extra])


def resolve_constant(refs: DataFrame, names: DataFrame, chains: DataFrame) -> DataFrame:
    """refs (key columns, checkout, written, scopes) with fqn, via, scopes_tried, confidence.

    The head: each scope's own name, then the innermost scope's ancestors', then
    the top level.  Later segments: the parent's own, else its ancestors', where
    a name of Object counts only on Object itself."""
    keys = [c for c in refs.columns if c not in ("written", "scopes")]
    rows = refs.withColumn("_id", F.xxhash64(*keys, "written", "scopes"))
    rows = rows.withColumn("rooted", F.col("written").startswith("::")).withColumn("parts", F.split(F.regexp_replace("written", "^::", ""), "::"))
    known = names.select("checkout", "fqn")
    links = exploded(chains.where("side = 'instance'"))
    head = F.element_at("parts", 1)
    own = rows.where("NOT rooted").select("_id", "checkout", "parts", F.posexplode("scopes").alias("at", "scope")).select("_id", "checkout", qualify(F.col("scope"), head).alias("fqn"), F.col("at").alias("ord"), F.lit("lexical").alias("via"))
    inner = rows.where("NOT rooted AND size(scopes) > 0").select("_id", "checkout", "parts", F.element_at("scopes", 1).alias("inner"), F.size("scopes").alias("depth"))
    above = inner.join(links.select("checkout", F.col("fqn").alias("inner"), "pos", "owner"), ["checkout", "inner"]).where("owner <> inner")
    above = above.select("_id", "checkout", qualify(F.col("owner"), head).alias("fqn"), (F.col("depth") + F.col("pos")).alias("ord"), F.when(F.col("owner") == "Object", "root").otherwise("ancestor").alias("via"))
    top = rows.select("_id", "checkout", head.alias("fqn"), F.lit(1 << 20).alias("ord"), F.lit("root").alias("via"))
    tried = own.unionByName(above).unionByName(top)
    hit = tried.join(known, ["checkout", "fqn"], "left_semi").groupBy("_id").agg(F.min_by(F.struct("fqn", "via", "ord"), "ord").alias("hit"))
    distinct_before = tried.join(hit.select("_id", F.col("hit.ord").alias("until")), "_id").where("ord <= until").groupBy("_id").agg(F.count_distinct("fqn").alias("scopes_tried"))
    at = rows.join(hit, "_id", "left").join(distinct_before, "_id", "left").select(*keys, "written", "_id", "parts", F.col("hit.fqn").alias("fqn"), F.col("hit.via").alias("via"), "scopes_tried")
    depth = at.agg(F.max(F.size("parts"))).first()[0] or 1
    for n in range(2, depth + 1):
        asked = at.where((F.size("parts") >= n) & F.col("fqn").isNotNull()).select("_id", "checkout", F.col("fqn").alias("parent"), F.element_at("parts", n).alias("segment"))
        direct = asked.select("_id", "checkout", F.lit(-1).alias("pos"), qualify(F.col("parent"), F.col("segment")).alias("fqn"))
        inherited = asked.join(links.select("checkout", F.col("fqn").alias("parent"), "pos", "owner"), ["checkout", "parent"]).where("owner <> parent AND owner <> 'Object'").select("_id", "checkout", "pos", qualify(F.col("owner"), F.col("segment")).alias("fqn"))
        step = direct.unionByName(inherited).join(known, ["checkout", "fqn"], "left_semi").groupBy("_id").agg(F.min_by("fqn", "pos").alias("found"))
        at = at.join(step, "_id", "left").withColumn("via", F.when(F.size("parts") >= n, "path").otherwise(F.col("via"))).withColumn("fqn", F.when(F.size("parts") >= n, F.col("found")).otherwise(F.col("fqn"))).drop("found")
    return at.select(*keys, "written", "fqn", F.when(F.col("fqn").isNotNull(), F.col("via")).alias("via"), F.coalesce("scopes_tried", F.lit(0)).alias("scopes_tried"), F.when(F.col("fqn").isNotNull(), 1.0).otherwise(0.0).alias("confidence"))


def return_vote(methods: DataFrame) -> DataFrame:
    """checkout, name, returns, agreeing, total: the class that all declaring instance methods of a name return.

    One vote for each owner; a class method that declares another class objects."""
    votes = methods.where("side = 'instance'").groupBy("checkout", "name", "owner").agg(F.max_by("sig_returns", "ord").alias("returns"))
    counted = votes.groupBy("checkout", "name").agg(F.count("returns").alias("agreeing"), F.count("*").alias("total"), F.count_distinct("returns").alias("classes"), F.max("returns").alias("returns"))
    objections = methods.where("side = 'class' AND sig_returns IS NOT NULL").select("checkout", "name", F.col("sig_returns").alias("other")).distinct()
    agreed = counted.where("classes = 1")
    against = agreed.join(objections, ["checkout", "name"]).where("other <> returns").select("checkout", "name").distinct()
    return agreed.join(against, ["checkout", "name"], "left_anti").select("checkout", "name", "returns", "agreeing", "total")
