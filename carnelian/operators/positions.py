"""Questions at a place in a file: what stands there, where it is defined, what else names it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most files that are searched for an instance variable of a class.
MOST_FILES = 64


def under(asked: DataFrame, defs: DataFrame, consts: DataFrame, calls: DataFrame, assigns: DataFrame) -> DataFrame:
    """asked (checkout, path, line, col) with the fact whose name stands there, else the nearest on the line.

    The fact tables carry checkout and path.  Of facts at one distance the order
    is variable, definition, constant, call."""
    one = lambda df, what, name, rank: df.select("checkout", "path", F.lit(what).alias("what"), F.col(name).alias("name"), F.col("line").alias("at_line"), F.col("col").alias("at_col"), F.lit(rank).alias("rank"))
    every = one(assigns, "variable", "target", 0).unionByName(one(defs, "definition", "name", 1)).unionByName(one(consts.withColumn("leaf", F.element_at(F.split("name", "::"), -1)), "constant", "leaf", 2)).unionByName(one(calls, "call", "name", 3))
    rows = asked.join(every, ["checkout", "path"]).where("line = at_line")
    end = F.col("at_col") + F.length("name")
    far = F.when((F.col("col") >= F.col("at_col")) & (F.col("col") < end), 0).otherwise(F.least(F.abs(F.col("col") - F.col("at_col")), F.abs(F.col("col") - end)))
    best = rows.groupBy("checkout", "path", "line", "col").agg(F.min_by(F.struct("what", "name", "at_line", "at_col"), F.struct(far, "rank", "at_col")).alias("f"))
    return asked.join(best, ["checkout", "path", "line", "col"], "left").select("checkout", "path", "line", "col", "f.what", "f.name", F.col("f.at_line").alias("at_line"), F.col("f.at_col").alias("at_col"))


def definitions_at(found: DataFrame, answers: DataFrame, constants: DataFrame, names: DataFrame, reaching: DataFrame) -> DataFrame:
    """found (of under) with what defines it: writes of a variable, sites of a constant, the method that a call lands on.

    reaching: checkout, path and the reaching columns."""
    keys = ["checkout", "path", "line", "col", "what", "name"]
    call = found.where("what = 'call'").join(answers.select("checkout", "path", F.col("line").alias("at_line"), F.col("col").alias("at_col"), F.col("name"), "status", "def_path", "def_line", "confidence"), ["checkout", "path", "at_line", "at_col", "name"])
    sites = names.select("checkout", "fqn", F.explode("sites").alias("site"))
    const = found.where("what = 'constant'").join(constants.select("checkout", "path", F.col("line").alias("at_line"), F.col("col").alias("at_col"), "fqn", "confidence"), ["checkout", "path", "at_line", "at_col"]).join(sites, ["checkout", "fqn"], "left").select(*keys, F.when(F.col("fqn").isNotNull(), "resolved").otherwise("residue").alias("status"), F.col("site.path").alias("def_path"), F.col("site.line").alias("def_line"), "confidence")
    own = found.where("what = 'definition'").select(*keys, F.lit("resolved").alias("status"), F.col("path").alias("def_path"), F.col("at_line").alias("def_line"), F.lit(1.0).alias("confidence"))
    local = found.where("what = 'variable'").join(reaching.select("checkout", "path", F.col("read_line").alias("at_line"), F.col("read_col").alias("at_col"), "write_line"), ["checkout", "path", "at_line", "at_col"], "left").select(*keys, F.lit("resolved").alias("status"), F.col("path").alias("def_path"), F.coalesce("write_line", "at_line").alias("def_line"), F.lit(1.0).alias("confidence"))
    return call.select(*keys, "status", "def_path", "def_line", "confidence").unionByName(const).unionByName(own).unionByName(local).distinct()


def variable_mentions(assigns: DataFrame, calls: DataFrame, reaching: DataFrame, placed: DataFrame) -> DataFrame:
    """checkout, variable, owner, path, line, col, what of instance and class variables, over the files of their class.

    A local's mentions are its writes and the reads that they reach, in one file."""
    at = placed.select("checkout", F.col("path").alias("nesting"), F.col("fqn").alias("owner"))
    writes = assigns.where(F.col("target").startswith("@")).select("checkout", "path", "nesting", F.col("target").alias("variable"), "line", "col", F.lit("write").alias("what"))
    reads = calls.where("recv = 'ivar'").select("checkout", "path", "nesting", F.col("recv_text").alias("variable"), F.col("recv_line").alias("line"), F.col("recv_col").alias("col"), F.lit("read").alias("what"))
    both = writes.unionByName(reads).join(at, ["checkout", "nesting"])
    rank = F.dense_rank().over(Window.partitionBy("checkout", "owner").orderBy("path"))
    return both.withColumn("n", rank).where(F.col("n") <= MOST_FILES).select("checkout", "owner", "variable", "path", "line", "col", "what").distinct()


def local_mentions(assigns: DataFrame, reaching: DataFrame) -> DataFrame:
    """checkout, path, variable, line, col, what of locals."""
    writes = assigns.where(~F.col("target").startswith("@")).select("checkout", "path", F.col("target").alias("variable"), "line", "col")
    reads = writes.join(reaching.select("checkout", "path", F.col("write_line").alias("line"), F.col("write_col").alias("col"), "read_line", "read_col"), ["checkout", "path", "line", "col"])
    return writes.withColumn("what", F.lit("write")).unionByName(reads.select("checkout", "path", "variable", F.col("read_line").alias("line"), F.col("read_col").alias("col"), F.lit("read").alias("what"))).distinct()


def hover(found: DataFrame, docs: DataFrame, methods: DataFrame) -> DataFrame:
    """found (of definitions_at) with the comment and the signature of what it leads to."""
    text = docs.select("checkout", F.col("path").alias("def_path"), F.col("line").alias("def_line"), "doc").dropDuplicates(["checkout", "def_path", "def_line"])
    written = F.transform("params", lambda p: F.concat(F.when(p["kind"] == "rest", "*").when(p["kind"] == "keyrest", "**").when(p["kind"] == "block", "&").otherwise(""), p["name"], F.when(p["kind"].isin("key", "keyreq"), ":").otherwise("")))
    sig = methods.select("checkout", F.col("path").alias("def_path"), F.col("line").alias("def_line"), F.concat("owner", F.when(F.col("side") == "class", ".").otherwise("#"), "name", F.lit("("), F.array_join(written, ", "), F.lit(")")).alias("signature")).dropDuplicates(["checkout", "def_path", "def_line"])
    return found.join(text, ["checkout", "def_path", "def_line"], "left").join(sig, ["checkout", "def_path", "def_line"], "left")


def requires(files: DataFrame) -> DataFrame:
    """checkout, path, line, how, wanted of literal require, require_relative and load."""
    lines = files.select("checkout", "path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("n", "text"))
    pattern = r"""^\s*(require|require_relative|load|autoload)\b[\s(]+(?::\w+\s*,\s*)?["']([^"'#]+)["']"""
    rows = lines.select("checkout", "path", (F.col("n") + 1).alias("line"), F.regexp_extract("text", pattern, 1).alias("how"), F.regexp_extract("text", pattern, 2).alias("wanted"))
    return rows.where("how <> ''")


def resolve_requires(wanted: DataFrame, files: DataFrame, load_path: DataFrame) -> DataFrame:
    """wanted (of requires) with the file that each names, and its status.

    require_relative and names with ./ or ../ are one place beside the file; any
    other walks the load path (checkout, ord, dir, kind) in order, a Ruby file
    before a native one.  Two hits before the standard library are ambiguous."""
    here = F.regexp_replace("path", r"[^/]+$", "")
    beside = (F.col("how") == "require_relative") | F.col("wanted").rlike(r"^\.{1,2}/")
    with_end = F.when(F.col("wanted").rlike(r"\.(rb|so)$") | (F.col("how") == "load"), F.col("wanted")).otherwise(F.concat("wanted", F.lit(".rb")))
    folded = lambda c: F.regexp_replace(F.regexp_replace(c, r"(^|/)\./", "$1"), r"[^/]+/\.\./", "")
    keys = ["checkout", "path", "line", "how", "wanted"]
    known = files.select("checkout", F.col("path").alias("file"))
    one = wanted.where(beside).withColumn("file", folded(folded(F.concat(here, with_end)))).join(known, ["checkout", "file"], "left_semi").select(*keys, "file", F.lit(1).alias("hits"))
    walk = wanted.where(~beside).join(load_path, "checkout").withColumn("file", F.when(F.col("dir") == "", with_end).otherwise(F.concat("dir", F.lit("/"), with_end))).join(known, ["checkout", "file"], "left_semi")
    far = walk.groupBy(*keys).agg(F.min_by("file", "ord").alias("file"), F.count_if(F.col("kind") != "stdlib").alias("own"), F.count("*").alias("n")).select(*keys, "file", F.when(F.col("own") > 0, F.col("own")).otherwise(F.lit(1)).cast("int").alias("hits"))
    found = one.unionByName(far)
    return wanted.join(found, keys, "left").withColumn("status", F.when(F.col("file").isNull(), "residue").when(F.col("hits") > 1, "ambiguous").otherwise("resolved")).drop("hits")


def workspace_symbols(defs: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Definitions whose name holds the query in any case, with their places, the shortest first."""
    rows = defs.where(F.contains(F.lower("name"), F.lit(query.lower())))
    return rows.select("name", "kind", "checkout", "path", "line", "col").orderBy(F.length("name"), "name", "path", "line", "col").limit(limit)


def implementations(chains: DataFrame, methods: DataFrame, owner: str, name: str | None = None) -> DataFrame:
    """Classes below an owner; with a name, those that define it themselves."""
    from carnelian.operators.chains import exploded

    below = exploded(chains.where("side = 'instance'")).where((F.col("owner") == owner) & (F.col("fqn") != owner)).select("checkout", "fqn").distinct()
    if name is None:
        return below
    return below.join(methods.where(F.col("name") == name).select("checkout", F.col("owner").alias("fqn"), "path", "line"), ["checkout", "fqn"])
