"""Relational reads over fact tables: mentions, posting lists, counts, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carnelian.functions.scalars import last_segment, under
from carnelian.schema import LAYERS

#: Rows of one blob's facts in all its files from which they are dealt to more than one task.
ROWS_OF_A_PART = 20_000_000


def layer(kind: Column) -> Column:
    """Load order by a checkout's kind."""
    out = F.lit(None).cast("int")
    for name, at in LAYERS.items():
        out = F.when(kind == name, at).otherwise(out)
    return out


def posting_list(calls: DataFrame) -> DataFrame:
    """call_name: how often each blob calls each name, and how often it only names it as a symbol."""
    return calls.groupBy("oid", "name").agg(F.count("*").alias("calls"), F.count_if(F.col("symbol")).alias("symbols"))


def in_files(facts: DataFrame, files: DataFrame) -> DataFrame:
    """facts beside every file that has their blob.

    There are as many rows as facts times files of a blob, far more than are read,
    so tasks are dealt by what they make: a blob with many facts in many files goes
    to several, and small shuffled partitions aren't put together.  A merge join
    leaves a blob's rows together, each fact with its files in the same order,
    which columnar files store in a fraction of the space."""
    made = facts.groupBy("oid").agg(F.count("*").alias("facts")).join(files.groupBy("oid").agg(F.count("*").alias("files")), "oid")
    parts = F.ceil(F.col("facts") * F.col("files") / ROWS_OF_A_PART).cast("int")
    large = F.broadcast(made.select("oid", parts.alias("parts")).where("parts > 1"))  # the rows made bound their number
    parts = F.coalesce("parts", F.lit(1))
    one = facts.join(large, "oid", "left").withColumn("part", F.pmod(F.xxhash64(*facts.columns), parts).cast("int"))
    all_ = files.join(large, "oid", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = [df.drop("parts").repartition(tasks, "oid", "part") for df in (one, all_)]
    return dealt[0].join(dealt[1].hint("merge"), ["oid", "part"]).drop("part")


def mentions(defs: DataFrame, const_refs: DataFrame, files: DataFrame, name: str | None = None) -> DataFrame:
    """Definitions and constant references (of one name, or of all), where each stands."""
    d = defs.select("oid", "name", F.lit("def").alias("what"), "line", "col")
    r = const_refs.select("oid", "name", F.lit("ref").alias("what"), "line", "col")
    both = d.unionByName(r)
    both = both.where(F.col("name") == name) if name is not None else both
    return in_files(both, files.select("oid", "checkout", "path")).select("checkout", "path", "name", "what", "line", "col")


def files_calling(call_name: DataFrame, files: DataFrame, names: list[str]) -> DataFrame:
    """Paths of files that call any of the names."""
    return call_name.where(F.col("name").isin(names)).join(files, "oid").select("checkout", "path").distinct()


def files_calling_page(call_name: DataFrame, files: DataFrame, name: str, after: str, rows: int) -> DataFrame:
    """The page of the first rows blobs after a key; a blob's paths are never parted."""
    mapped = call_name.where((F.col("name") == name) & (F.col("oid") > after)).join(files.select("oid"), "oid", "left_semi")
    page = mapped.select("oid").distinct().orderBy("oid").limit(rows)
    return page.join(files, "oid").select("oid", "checkout", "path")


def calls_name(call_name: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """One row: whether any mapped file calls the name."""
    found = call_name.where(F.col("name") == name).join(files.select("oid"), "oid", "left_semi").limit(1)
    return found.agg((F.count("*") > 0).alias("called"))


def written_calls(call_name: DataFrame, files: DataFrame, names: list[str], cap: int, aside: Column) -> DataFrame:
    """For each name, calls written out in all files and in those that aren't set aside, up to the cap."""
    written = F.col("calls") - F.col("symbols")
    rows = call_name.where(F.col("name").isin(names)).join(files, "oid")
    return rows.groupBy("name").agg(F.least(F.sum(written), F.lit(cap)).alias("total"), F.least(F.sum(F.when(~aside, written).otherwise(0)), F.lit(cap)).alias("outside"))


def top_checkout(call_name: DataFrame, files: DataFrame, kind: str, checkouts: DataFrame) -> DataFrame:
    """For each name, the checkout of a kind that calls it most; ties go to the first root."""
    own = files.join(F.broadcast(checkouts.where(F.col("kind") == kind).select(F.col("root").alias("checkout"))), "checkout")
    sums = call_name.join(own, "oid").groupBy("name", "checkout").agg(F.sum("calls").alias("n")).where("n > 0")
    best = sums.groupBy("name").agg(F.max(F.struct(F.col("n"))).alias("top"))
    return sums.join(best, "name").where(F.col("n") == F.col("top.n")).groupBy("name").agg(F.min("checkout").alias("checkout"), F.first("n").alias("n"))


def const_refs_ending(const_refs: DataFrame, files: DataFrame, leaf: str) -> DataFrame:
    """References whose last segment is leaf."""
    # the ending is looked at first: names are split only where they can be meant
    found = const_refs.where(F.col("name").endswith(leaf)).where(last_segment(F.col("name")) == leaf).select("oid", "name", "line", "col")
    return in_files(found, files.select("oid", "checkout", "path")).select("checkout", "path", "name", "line", "col")


def const_refs_named(const_refs: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """References to any of the names (a column name), each once."""
    return const_refs.join(names.select("name").distinct(), "name", "left_semi").join(files, "oid").select("checkout", "path", "name", "line", "col").distinct()


def _placed(facts: DataFrame, files: DataFrame, checkouts: DataFrame) -> DataFrame:
    if "layer" in files.columns:  # files of a composed application say their own
        return facts.join(files, "oid")
    roots = F.broadcast(checkouts.select(F.col("root").alias("checkout"), layer(F.col("kind")).alias("layer")))
    return facts.join(files, "oid").join(roots, "checkout")


def declarations(defs: DataFrame, files: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Classes, modules and constants with the order in which they are read."""
    rows = _placed(defs.where(F.col("kind").isin("class", "module", "constant")), files, checkouts)
    return rows.withColumn("ord", F.struct("layer", "checkout", "path", "line", "col"))


def methods(defs: DataFrame, files: DataFrame, checkouts: DataFrame, name: str | None = None) -> DataFrame:
    rows = defs.where(F.col("kind") == "method")
    rows = rows.where(F.col("name") == name) if name is not None else rows
    return _placed(rows, files, checkouts).withColumn("ord", F.struct("layer", "checkout", "path", "line", "col"))


def edges(ancestry: DataFrame, files: DataFrame, checkouts: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """Ancestry rows with their order; by default all that place something (no dynamic or macro rows)."""
    chosen = F.col("relation").isin(relations) if relations else ~F.col("relation").isin("dynamic", "macro", "load_hooks")
    return _placed(ancestry.where(chosen), files, checkouts).withColumn("ord", F.struct("layer", "checkout", "path", "line", "col"))


def dynamic_markers(ancestry: DataFrame, compiled: DataFrame, files: DataFrame) -> DataFrame:
    """First line of each (path, owner) that makes methods at run time, and of partly compiled classes."""
    made = ancestry.where(F.col("relation") == "dynamic").join(files, "oid").select("path", F.array_join("owner", "::").alias("owner"), "line")
    return made.unionAll(compiled.select("path", "owner", "line")).groupBy("path", "owner").agg(F.min("line").alias("line"))


def body_calls(body_call: DataFrame, name: str) -> DataFrame:
    """Distinct calls of a macro by body and literal arguments."""
    return body_call.where(F.col("name") == name).select("nesting", "args").distinct()


def symbols_named(defs: DataFrame, query: str, limit: int) -> DataFrame:
    """Definitions whose name holds the query in any case, the shortest names first."""
    found = defs.where(F.contains(F.lower("name"), F.lit(query.lower()))).select("name", "kind").distinct()
    return found.orderBy(F.length("name"), "name", "kind").limit(limit)


def status(checkouts: DataFrame, files: DataFrame) -> DataFrame:
    """Files and distinct blobs of every checkout, empty ones too."""
    counted = files.groupBy("checkout").agg(F.count("*").alias("files"), F.count_distinct("oid").alias("blobs"))
    return checkouts.join(counted, checkouts["root"] == counted["checkout"], "left").select("root", "kind", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("blobs", F.lit(0)).alias("blobs"))


def totals(defs: DataFrame, call_name: DataFrame, files: DataFrame) -> DataFrame:
    """what, n: rows of each kind in all."""
    one = lambda df, c, name: df.agg(F.coalesce(c, F.lit(0)).cast("bigint").alias("n")).select(F.lit(name).alias("what"), "n")
    return one(files, F.count("*"), "files").unionByName(one(files, F.count_distinct("oid"), "blobs")).unionByName(one(defs, F.count("*"), "defs")).unionByName(one(call_name, F.sum("calls"), "calls"))


def tree_roots(root: str, checkouts: DataFrame, gem_use: DataFrame) -> DataFrame:
    """The checkouts that a tree is built from: itself, its gems, and the standard library."""
    gems = gem_use.where(F.col("checkout") == root).select(F.col("gem_root").alias("root")).distinct()
    own = checkouts.where((F.col("root") == root) | F.col("kind").isin("stdlib", "core"))
    return own.unionByName(checkouts.join(gems, "root", "left_semi")).distinct().withColumn("layer", layer(F.col("kind")))


def visible_files(files: DataFrame, roots: DataFrame, hidden: DataFrame) -> DataFrame:
    """Files of the roots without what a bundled gem hides (checkout, path)."""
    return files.join(F.broadcast(roots.select(F.col("root").alias("checkout"))), "checkout", "left_semi").join(hidden, ["checkout", "path"], "left_anti")


def owning_checkout(paths: DataFrame, checkouts: DataFrame) -> DataFrame:
    """For each path the deepest root above it.

    A path's own prefixes are joined to the roots by equality, so no range join is made."""
    parts = F.split("path", "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    found = above.join(checkouts.select("root"), "root")
    return found.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def app_for_gem(gem_use: DataFrame, checkouts: DataFrame) -> DataFrame:
    """For each gem the app indexed last that uses it."""
    joined = gem_use.join(checkouts.select(F.col("root").alias("checkout"), "indexed_at"), "checkout")
    return joined.groupBy("gem_root").agg(F.max_by("checkout", F.struct("indexed_at", "checkout")).alias("checkout"))


def digest(files: DataFrame, value: Column, by: str = "checkout") -> DataFrame:
    """Order-independent digest of each group: the wrapping sum of its rows' 64-bit values.

    A value is taken as unsigned, and sums are decimals, so nothing overflows."""
    modulus = F.lit(str(1 << 64)).cast("decimal(20,0)")
    wide = F.when(value < 0, value.cast("decimal(20,0)") + modulus).otherwise(value.cast("decimal(20,0)")).cast("decimal(28,0)")
    return files.groupBy(by).agg((F.sum(wide) % modulus).cast("decimal(20,0)").alias("digest"))


def constant_spellings(names: DataFrame, const_refs: DataFrame) -> DataFrame:
    """References that some spelling of a full name could be (fqn, oid, name, nesting, line, col)."""
    from carnelian.functions.scalars import spellings, whole_name

    written = names.select("fqn", F.explode(spellings(F.col("fqn"))).alias("spelling"))
    return const_refs.withColumn("spelling", whole_name(F.col("name"))).join(written, "spelling").drop("spelling")


def gems_of_path(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files of each root by prefix, for roots that are few enough to be broadcast."""
    return files.join(F.broadcast(roots), under(roots["root"], files["path"]))


def last_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the one that is read last."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
