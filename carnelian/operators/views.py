"""Templates: which a render reaches, and what their variables are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carnelian.functions.scalars import camelize, underscore

TEMPLATE = r"^(.*/)?(_?[\w\-]+)\.(?:(\w+)\.)?(erb|haml|slim|rabl|jbuilder)$"
#: Most partials within partials that are followed.
MOST_DEPTH = 3


def templates(files: DataFrame) -> DataFrame:
    """checkout, path, dir (below app/views), name, format of template files."""
    rows = files.where(F.col("path").rlike(r"(^|/)app/views/") & F.col("path").rlike(TEMPLATE))
    below = F.regexp_replace("path", r"^(.*/)?app/views/", "")
    return rows.select("checkout", "path", F.regexp_replace(F.regexp_extract(below, TEMPLATE, 1), "/$", "").alias("dir"), F.regexp_extract(below, TEMPLATE, 2).alias("name"), F.regexp_extract(below, TEMPLATE, 3).alias("format"))


def renderings(files: DataFrame) -> DataFrame:
    """checkout, path, line, wanted of literal render calls, a partial's name with its underscore."""
    lines = files.select("checkout", "path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("n", "text"))
    found = F.regexp_extract("text", r"""\brender[\s(]+(?:(partial|template|action):\s*)?:?["']?([\w/\-]+)["']?""", 2)
    how = F.regexp_extract("text", r"""\brender[\s(]+(?:(partial|template|action):\s*)?:?["']?([\w/\-]+)["']?""", 1)
    rows = lines.select("checkout", "path", (F.col("n") + 1).alias("line"), found.alias("raw"), how.alias("how")).where("raw <> ''")
    in_view = F.col("path").rlike(r"(^|/)app/views/") & (F.col("how") == "") | (F.col("how") == "partial")
    leaf = F.element_at(F.split("raw", "/"), -1)
    head = F.regexp_replace("raw", r"[^/]+$", "")
    return rows.select("checkout", "path", "line", F.when(in_view, F.concat(head, F.lit("_"), leaf)).otherwise(F.col("raw")).alias("wanted"))


def rendered(renderings_: DataFrame, templates_: DataFrame) -> DataFrame:
    """renderings with the templates that each reaches: as written, else beside the renderer."""
    from_controller = F.regexp_replace(F.regexp_extract("path", r"app/controllers/(.*)_controller\.rb$", 1), "/$", "")
    from_view = F.regexp_extract("path", r"app/views/(?:(.*)/)?[^/]+$", 1)
    home = F.when(F.col("path").rlike("app/controllers/"), from_controller).otherwise(from_view)
    split = renderings_.withColumn("home", home).withColumn("in_dir", F.regexp_replace(F.regexp_extract("wanted", r"^(.*/)?([^/]+)$", 1), "/$", "")).withColumn("name", F.element_at(F.split("wanted", "/"), -1))
    dir_ = F.when(F.col("in_dir") != "", F.col("in_dir")).otherwise(F.col("home"))
    return split.withColumn("dir", dir_).join(templates_.select("checkout", "dir", "name", F.col("path").alias("template")), ["checkout", "dir", "name"]).select("checkout", "path", "line", "wanted", "template")


def actions_of(templates_: DataFrame, methods: DataFrame) -> DataFrame:
    """checkout, template, controller, action: the action that a template's place and name stand for."""
    named = templates_.where(~F.col("name").startswith("_")).select("checkout", F.col("path").alias("template"), F.concat(camelize(F.col("dir")), F.lit("Controller")).alias("owner"), "name")
    return named.join(methods.where("side = 'instance'").select("checkout", "owner", "name").distinct(), ["checkout", "owner", "name"], "left_semi").select("checkout", "template", F.col("owner").alias("controller"), F.col("name").alias("action"))


def reached_from(rendered_: DataFrame, actions: DataFrame) -> DataFrame:
    """checkout, template, controller: through which controllers a template is shown, partials in partials too."""
    at = actions.select("checkout", "template", "controller").unionByName(rendered_.where(F.col("path").rlike("app/controllers/")).select("checkout", "template", F.concat(camelize(F.regexp_extract("path", r"app/controllers/(.*)_controller\.rb$", 1)), F.lit("Controller")).alias("controller"))).distinct()
    for _ in range(MOST_DEPTH):
        more = at.withColumnRenamed("template", "path").join(rendered_.select("checkout", "path", "template"), ["checkout", "path"]).select("checkout", "template", "controller")
        at = at.unionByName(more).distinct()
    return at


def view_variables(calls: DataFrame, reached: DataFrame, writes: DataFrame) -> DataFrame:
    """call_id, fqn, agreeing, total: what an instance variable in a template is, by the writes of the controllers that show it.

    calls: call_id, checkout, path, recv, recv_text.  writes: checkout, owner, target, fqn (null where untyped)."""
    asked = calls.where("recv = 'ivar' AND path RLIKE 'app/views/'").select("call_id", "checkout", F.col("path").alias("template"), F.col("recv_text").alias("target"))
    each = asked.join(reached.withColumnRenamed("controller", "owner"), ["checkout", "template"]).join(writes, ["checkout", "owner", "target"])
    total = each.groupBy("call_id").agg(F.count("*").alias("total"))
    votes = each.where("fqn IS NOT NULL").groupBy("call_id", "fqn").agg(F.count("*").alias("agreeing"))
    best = votes.groupBy("call_id").agg(F.min_by(F.struct("fqn", "agreeing"), F.struct(-F.col("agreeing"), F.col("fqn"))).alias("b"))
    return best.join(total, "call_id").select("call_id", "b.fqn", F.col("b.agreeing").alias("agreeing"), "total")


def sidecar_class(templates_: DataFrame, names: DataFrame) -> DataFrame:
    """checkout, path, fqn of component templates that stand beside their class."""
    rows = templates_.select("checkout", "path", camelize(F.concat_ws("/", F.nullif("dir", F.lit("")), "name")).alias("fqn"))
    return rows.join(names.where("kind = 'class'").select("checkout", "fqn"), ["checkout", "fqn"], "left_semi")


def helpers(names: DataFrame, files: DataFrame) -> DataFrame:
    """checkout, module of app/helpers files: modules that every template can call."""
    paths = files.where(F.col("path").rlike(r"(^|/)app/helpers/.*_helper\.rb$")).select("checkout", camelize(F.regexp_extract("path", r"app/helpers/(.*)\.rb$", 1)).alias("fqn"))
    return names.where("kind = 'module'").select("checkout", "fqn").join(paths, ["checkout", "fqn"], "left_semi").withColumnRenamed("fqn", "module")


def conventional_path(fqn):
    """The path that an autoloader reads a constant from."""
    return F.concat(underscore(fqn), F.lit(".rb"))
