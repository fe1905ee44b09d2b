"""What a checkout depends on: lockfiles, declared requirements, and where gems are."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnelian.extract.facts import literal_names
from carnelian.extract.ruby import Node, parse
from carnelian.functions.scalars import version_key
from carnelian.plans.lineage import cut
from carnelian.sources.rows import read_rows

LOCKED = "name string, version string, source string, remote string"
REQUIRED = "name string, requirements array<string>"


def lockfile(source: bytes) -> list[dict]:
    """Specs of a Gemfile.lock with the section that they are in."""
    out, section, remote = [], "", None
    for line in source.decode("utf-8", "replace").split("\n"):
        if line and not line.startswith(" "):
            section, remote = line.strip(), None
        elif m := re.match(r"  remote: (.+)$", line):
            remote = m[1].strip()
        elif (m := re.match(r"    ([^\s(]+) \(([^)]+)\)$", line)) and section in ("GEM", "GIT", "PATH", "PLUGIN SOURCE"):
            out.append({"name": m[1], "version": re.sub(r"-(x86|x64|arm|aarch|java|universal|mingw).*$", "", m[2]), "source": section.lower(), "remote": remote})
    return out


def declared(source: bytes) -> list[dict]:
    """gem and add_dependency calls of a Gemfile or gemspec."""
    tree, _ = parse(source)
    out = []

    def walk(node: Node) -> None:
        if node.kind == "call" and node.name in ("gem", "add_dependency", "add_runtime_dependency", "add_development_dependency"):
            names = [n for a in node.args or [] for n in (literal_names([a]) or [])]
            if names:
                out.append({"name": names[0], "requirements": [n for n in names[1:] if re.match(r"(~>|[<>=!]=?|\d)", n)]})
        for child in node.children():
            walk(child)

    walk(tree)
    return out


def locked_gems(files: DataFrame) -> DataFrame:
    return read_rows(files.where(F.col("path").rlike(r"(^|/)Gemfile\.lock$")), LOCKED, lockfile)


def declared_gems(files: DataFrame) -> DataFrame:
    return read_rows(files.where(F.col("path").rlike(r"(^|/)Gemfile$|\.gemspec$")), REQUIRED, declared)


def meets(version: Column, requirement: Column) -> Column:
    """Whether a version column meets a requirement column ("~> 2.1", ">= 1", "1.0")."""
    op = F.when(requirement.rlike("^[0-9]"), "=").otherwise(F.regexp_extract(requirement, r"^([~<>=!]+)", 1))
    want = F.trim(F.regexp_replace(requirement, r"^[~<>=!]+", ""))
    have, least = version_key(version), version_key(want)
    parts = F.split(want, r"\.")
    n = F.greatest(F.size(parts) - 1, F.lit(1))
    bumped = F.concat(F.slice(parts, 1, n - 1), F.array((F.try_element_at(parts, n).cast("bigint") + 1).cast("string")))
    below = version_key(F.array_join(bumped, "."))
    return (
        F.when(op == "=", have == least).when(op == "!=", have != least).when(op == ">", have > least).when(op == "<", have < least)
        .when(op == ">=", have >= least).when(op == "<=", have <= least).when(op == "~>", (have >= least) & (have < below)).otherwise(F.lit(False))
    )


def resolve(required: DataFrame, installed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """checkout, name, version, root: for each required gem the highest installed version that meets all
    requirements, and so on through the dependencies of what was chosen, to the closure.

    required: checkout, name, requirements.  installed: name, version, root.
    dependencies: root, name, requirements."""
    wanted = required.select("checkout", "name", "requirements")
    chosen = None
    while True:
        all_of = wanted.groupBy("checkout", "name").agg(F.flatten(F.collect_list("requirements")).alias("requirements"))
        fits = all_of.join(installed, "name").where(F.forall("requirements", lambda r: meets(F.col("version"), r)))
        best = cut(fits.groupBy("checkout", "name").agg(F.max_by(F.struct("version", "root"), version_key(F.col("version"))).alias("b")).select("checkout", "name", "b.version", "b.root"))
        more = best.select("checkout", "root").join(dependencies, "root").select("checkout", "name", "requirements")
        fresh = more.distinct().join(wanted, ["checkout", "name", "requirements"], "left_anti")
        if chosen is not None and fresh.isEmpty():
            return best
        wanted = cut(wanted.unionByName(fresh))
        chosen = best


def locate(gems: DataFrame, directories: DataFrame, checkouts: DataFrame) -> DataFrame:
    """checkout, name, root, reason: the directory of each gem, inside the checkout first; a reason where there is none.

    directories: name, version, root."""
    inside = checkouts.select(F.col("root").alias("checkout"))
    found = gems.join(directories, ["name", "version"], "left").join(F.broadcast(inside), "checkout")
    rank = F.when(F.col("root").startswith(F.concat("checkout", F.lit("/"))), 0).when(F.col("root").isNotNull(), 1).otherwise(2)
    best = found.groupBy("checkout", "name", "version").agg(F.min_by("root", F.struct(rank, "root")).alias("root"))
    return best.withColumn("reason", F.when(F.col("root").isNull(), "not installed"))
