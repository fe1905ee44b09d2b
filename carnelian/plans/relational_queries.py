"""Oracle-checked queries: driver tables projected onto fact schemas, put
through the engine's operators.  The SQL beside each works on the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.functions import scalars as S
from carnelian.operators import relational as R

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- projections ------------------------------------------------------------
def files(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("checkout"), F.concat(F.lit("lib/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".rb")).alias("path"), S.git_oid(F.col("text")).alias("oid"))


def call_name(spark, sf_dir) -> DataFrame:
    """A posting list of documents' words.  Equal texts are one blob: counts are over all copies, divided by their number, so that no text is shuffled."""
    d = table(spark, sf_dir, "documents").select(S.git_oid(F.col("text")).alias("oid"), "text")
    tokens = d.select("oid", F.explode(F.split(F.lower("text"), "[^a-z0-9_]+")).alias("name")).where("name <> ''")
    counted = tokens.groupBy("oid", "name").agg(F.count("*").alias("n"))
    copies = d.groupBy("oid").agg(F.count("*").alias("copies"))
    once = counted.join(copies, "oid").select("oid", "name", F.expr("n div copies").alias("calls"))
    return once.withColumn("symbols", F.floor(F.col("calls") / 3))


def checkouts(spark, sf_dir) -> DataFrame:
    n = F.substring("source", 4, 10).cast("int")
    kind = F.when(n < 10, "repo").when(n < 18, "gem").when(n == 18, "stdlib").otherwise("core")
    return table(spark, sf_dir, "documents").select("source").distinct().select(F.col("source").alias("root"), kind.alias("kind"), (n * 10).cast("bigint").alias("indexed_at"))


def gem_use(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), (k % 10).cast("string")).alias("checkout"), F.concat(F.lit("src"), (10 + k % 8).cast("string")).alias("gem_root"), F.col("n_name").alias("name"))


def part_files(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), (k % 20).cast("string")).alias("checkout"), F.concat(F.lit("lib/s"), k.cast("string"), F.lit(".rb")).alias("path"), F.concat(F.lit("b"), (k % 50).cast("string")).alias("oid"))


def part_defs(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(F.lit("class"), F.lit("module"), F.lit("method"), F.lit("constant")), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("b"), (k % 50).cast("string")).alias("oid"), F.replace("p_type", F.lit(" "), F.lit("::")).alias("name"), kind.alias("kind"), F.array(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("nesting"), F.col("p_size").alias("line"), (k % 80).cast("int").alias("col"))


def line_refs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("b"), (F.col("l_suppkey") % 50).cast("string")).alias("oid"),
        F.concat(F.lit("P"), (F.col("l_partkey") % 97).cast("string"), F.lit("::Q"), F.col("l_linenumber").cast("string")).alias("name"),
        F.col("l_linenumber").alias("line"), (F.col("l_orderkey") % 100).cast("int").alias("col"),
    )


_OID = "sha1(CAST('blob ' || octet_length(encode(text)) AS BLOB) || '\\x00'::BLOB || encode(text))"
_FILES = f"files AS (SELECT source AS checkout, 'lib/' || lang || '/d' || doc_id || '.rb' AS path, {_OID} AS oid FROM documents)"
_CALLS = f"""call_name AS (SELECT oid, name, count(*) AS calls, CAST(count(*) // 3 AS BIGINT) AS symbols
  FROM (SELECT oid, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS name FROM (SELECT DISTINCT {_OID} AS oid, text FROM documents))
  WHERE name <> '' GROUP BY oid, name)"""
_CHECKOUTS = """checkouts AS (SELECT source AS root, CASE WHEN n < 10 THEN 'repo' WHEN n < 18 THEN 'gem' WHEN n = 18 THEN 'stdlib' ELSE 'core' END AS kind, CAST(n * 10 AS BIGINT) AS indexed_at
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS n FROM documents))"""
_GEM_USE = "gem_use AS (SELECT 'src' || (n_nationkey % 10) AS checkout, 'src' || (10 + n_nationkey % 8) AS gem_root, n_name AS name FROM nation)"
_PFILES = "files AS (SELECT 'src' || (s_suppkey % 20) AS checkout, 'lib/s' || s_suppkey || '.rb' AS path, 'b' || (s_suppkey % 50) AS oid FROM supplier)"
_DEFS = "defs AS (SELECT 'b' || (p_partkey % 50) AS oid, replace(p_type, ' ', '::') AS name, ['class', 'module', 'method', 'constant'][CAST(p_size % 4 + 1 AS INTEGER)] AS kind, replace(p_brand, '#', '_') AS nest, p_size AS line, CAST(p_partkey % 80 AS INTEGER) AS col FROM part)"
_REFS = "refs AS (SELECT 'b' || (l_suppkey % 50) AS oid, 'P' || (l_partkey % 97) || '::Q' || l_linenumber AS name, l_linenumber AS line, CAST(l_orderkey % 100 AS INTEGER) AS col FROM lineitem)"
_LAYER = "CASE kind WHEN 'core' THEN 0 WHEN 'stdlib' THEN 1 WHEN 'gem' THEN 2 WHEN 'repo' THEN 3 END"


# -- scans ------------------------------------------------------------------
@query(f"SELECT doc_id, {_OID} AS oid FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.git_oid(F.col("text")).alias("oid"))


@query("""SELECT page_id, CASE WHEN e IN ('rb','rake','gemspec','ru','jbuilder','rbi') THEN 'ruby' WHEN e = 'erb' THEN 'erb' WHEN e = 'haml' THEN 'haml' WHEN e = 'rabl' THEN 'rabl' END AS reader
FROM (SELECT page_id, ['rb','erb','txt','haml','rbi','md','rake'][CAST(page_id % 7 + 1 AS INTEGER)] AS e FROM pages) WHERE e NOT IN ('txt', 'md')""")
def index_predicate(spark, sf_dir):
    from carnelian.sources.readers import is_indexed, reader_of

    ending = F.element_at(F.array(*[F.lit(x) for x in ("rb", "erb", "txt", "haml", "rbi", "md", "rake")]), (F.col("page_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("app/p"), F.col("page_id").cast("string"), F.lit("."), ending).alias("path"))
    return rows.where(is_indexed(F.col("path"))).select("page_id", reader_of(F.col("path")).alias("reader"))


@query(f"WITH {_FILES}, seen AS (SELECT DISTINCT {_OID} AS oid FROM documents WHERE doc_id % 3 = 0) SELECT DISTINCT oid FROM files WHERE oid NOT IN (SELECT oid FROM seen)")
def incremental_load(spark, sf_dir):
    from carnelian.operators.extraction import unknown_blobs

    f = files(spark, sf_dir)
    known = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(S.git_oid(F.col("text")).alias("oid")).distinct()
    return unknown_blobs(f, f.select("oid"), known).select("oid")


# -- reads over the store -----------------------------------------------------
@query(f"WITH {_PFILES}, {_DEFS}, {_REFS} SELECT checkout, path, m.name AS name, what, line, col FROM (SELECT oid, name, 'def' AS what, line, col FROM defs UNION ALL SELECT oid, name, 'ref', line, col FROM refs) m JOIN files USING (oid)")
def name_mentions(spark, sf_dir):
    return R.mentions(part_defs(spark, sf_dir), line_refs(spark, sf_dir), part_files(spark, sf_dir))


@query(f"WITH {_FILES}, {_CALLS} SELECT DISTINCT checkout, path FROM call_name JOIN files USING (oid) WHERE name IN ('scum', 'the', 'token')")
def files_calling_any(spark, sf_dir):
    return R.files_calling(call_name(spark, sf_dir), files(spark, sf_dir), ["scum", "the", "token"])


@query(f"WITH {_FILES}, {_CALLS}, page AS (SELECT DISTINCT oid FROM call_name WHERE name = 'the' AND oid > '4' ORDER BY oid LIMIT 25) SELECT oid, checkout, path FROM page JOIN files USING (oid)")
def files_calling_page(spark, sf_dir):
    return R.files_calling_page(call_name(spark, sf_dir), files(spark, sf_dir), "the", "4", 25)


@query(f"WITH {_FILES}, {_CALLS} SELECT count(*) > 0 AS called FROM (SELECT 1 FROM call_name WHERE name = 'password' AND oid IN (SELECT oid FROM files) LIMIT 1)")
def calls_name(spark, sf_dir):
    return R.calls_name(call_name(spark, sf_dir), files(spark, sf_dir), "password")


@query(f"WITH {_FILES}, {_CALLS} SELECT name, least(CAST(sum(calls - symbols) AS BIGINT), 500) AS total, least(CAST(sum(CASE WHEN path LIKE 'lib/en/%' THEN 0 ELSE calls - symbols END) AS BIGINT), 500) AS outside FROM call_name JOIN files USING (oid) WHERE name IN ('the', 'la', 'de', 'idiot', 'token') GROUP BY name")
def written_calls(spark, sf_dir):
    return R.written_calls(call_name(spark, sf_dir), files(spark, sf_dir), ["the", "la", "de", "idiot", "token"], 500, F.col("path").startswith("lib/en/")).select("name", F.col("total").cast("bigint").alias("total"), F.col("outside").cast("bigint").alias("outside"))


@query(f"WITH {_FILES}, {_CALLS}, {_CHECKOUTS}, s AS (SELECT name, checkout, CAST(sum(calls) AS BIGINT) AS n FROM call_name JOIN files USING (oid) JOIN checkouts ON root = checkout WHERE kind = 'gem' GROUP BY name, checkout) SELECT name, min(checkout) AS checkout, n FROM s JOIN (SELECT name, max(n) AS n FROM s GROUP BY name) USING (name, n) GROUP BY name, n")
def top_gem_by_calls(spark, sf_dir):
    return R.top_checkout(call_name(spark, sf_dir), files(spark, sf_dir), "gem", checkouts(spark, sf_dir))


@query(f"WITH {_PFILES}, {_REFS} SELECT checkout, path, name, line, col FROM refs JOIN files USING (oid) WHERE string_split(name, '::')[-1] = 'Q3'")
def const_refs_ending(spark, sf_dir):
    return R.const_refs_ending(line_refs(spark, sf_dir), part_files(spark, sf_dir), "Q3")


@query(f"WITH {_PFILES}, {_REFS} SELECT DISTINCT checkout, path, name, line, col FROM refs JOIN files USING (oid) WHERE name IN (SELECT 'P' || r_regionkey || '::Q2' FROM region)")
def const_refs_named(spark, sf_dir):
    wanted = table(spark, sf_dir, "region").select(F.concat(F.lit("P"), F.col("r_regionkey").cast("string"), F.lit("::Q2")).alias("name"))
    return R.const_refs_named(line_refs(spark, sf_dir), part_files(spark, sf_dir), wanted)


@query(f"WITH {_PFILES}, {_DEFS}, {_CHECKOUTS} SELECT d.name, d.kind, checkout, path, line, col, CASE c.kind WHEN 'core' THEN 0 WHEN 'stdlib' THEN 1 WHEN 'gem' THEN 2 ELSE 3 END AS layer FROM defs d JOIN files USING (oid) JOIN checkouts c ON root = checkout WHERE d.kind IN ('class','module','constant')")
def declarations_in_order(spark, sf_dir):
    # a row's place in the order is its layer, checkout, path, line and column
    rows = R.declarations(part_defs(spark, sf_dir), part_files(spark, sf_dir), checkouts(spark, sf_dir))
    return rows.select("name", "kind", "ord.checkout", "ord.path", "ord.line", "ord.col", "ord.layer")


@query(f"WITH {_PFILES}, {_DEFS}, {_CHECKOUTS}, m AS (SELECT d.name, checkout, path, line, col, CASE c.kind WHEN 'core' THEN 0 WHEN 'stdlib' THEN 1 WHEN 'gem' THEN 2 ELSE 3 END AS layer, nest FROM defs d JOIN files USING (oid) JOIN checkouts c ON root = checkout WHERE d.kind = 'method') SELECT name, nest AS owner, checkout, path, line, col FROM (SELECT *, row_number() OVER (PARTITION BY name, nest ORDER BY layer DESC, checkout DESC, path DESC, line DESC, col DESC) AS r FROM m) WHERE r = 1")
def last_definition_wins(spark, sf_dir):
    rows = R.methods(part_defs(spark, sf_dir), part_files(spark, sf_dir), checkouts(spark, sf_dir)).withColumn("owner", F.element_at("nesting", 1))
    return R.last_wins(rows, ["name", "owner"], ["layer", "checkout", "path", "line", "col"]).select("name", "owner", "checkout", "path", "line", "col")


@query(f"WITH {_PFILES} SELECT path, owner, min(line) AS line FROM (SELECT path, owner, line FROM (SELECT 'b' || (p_partkey % 50) AS oid, replace(p_brand, '#', '_') || '::' || p_type AS owner, p_size AS line FROM part WHERE p_size % 3 = 0) JOIN files USING (oid) UNION ALL SELECT 'lib/s' || n_nationkey || '.rb', n_name, n_regionkey FROM nation) GROUP BY path, owner")
def dynamic_markers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("b"), (F.col("p_partkey") % 50).cast("string")).alias("oid"), F.when(F.col("p_size") % 3 == 0, "dynamic").otherwise("include").alias("relation"), F.array(F.replace("p_brand", F.lit("#"), F.lit("_")), F.col("p_type")).alias("owner"), F.col("p_size").alias("line"))
    compiled = table(spark, sf_dir, "nation").select(F.concat(F.lit("lib/s"), F.col("n_nationkey").cast("string"), F.lit(".rb")).alias("path"), F.col("n_name").alias("owner"), F.col("n_regionkey").alias("line"))
    return R.dynamic_markers(p, compiled, part_files(spark, sf_dir))


@query("SELECT DISTINCT event_type AS name, CAST(user_id % 10 AS VARCHAR) AS nesting, props AS args FROM events WHERE event_type = 'view' OR event_type = 'click'")
def body_calls_deduped(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.array((F.col("user_id") % 10).cast("string")).alias("nesting"), F.array("props").alias("args"))
    one = lambda n: R.body_calls(e, n).select(F.lit(n).alias("name"), F.element_at("nesting", 1).alias("nesting"), F.element_at("args", 1).alias("args"))
    return one("view").unionByName(one("click"))


@query("SELECT name, kind FROM (SELECT DISTINCT replace(p_type, ' ', '::') AS name, ['class', 'module', 'method', 'constant'][CAST(p_size % 4 + 1 AS INTEGER)] AS kind FROM part) WHERE contains(lower(name), 'an') ORDER BY length(name), name, kind LIMIT 20")
def symbol_search(spark, sf_dir):
    return R.symbols_named(part_defs(spark, sf_dir), "AN", 20)


@query(f"WITH {_FILES}, {_CHECKOUTS} SELECT root, kind, count(path) AS files, count(DISTINCT oid) AS blobs FROM checkouts LEFT JOIN files ON checkout = root AND path LIKE '%7.rb' GROUP BY root, kind")
def checkout_status(spark, sf_dir):
    return R.status(checkouts(spark, sf_dir), files(spark, sf_dir).where(F.col("path").endswith("7.rb")))


@query(f"WITH {_FILES}, {_CHECKOUTS} SELECT root, kind, count(path) AS files, count(DISTINCT oid) AS blobs FROM checkouts LEFT JOIN files ON checkout = root GROUP BY root, kind")
def checkout_status_whole(spark, sf_dir):
    return R.status(checkouts(spark, sf_dir), files(spark, sf_dir))


@query(f"WITH {_FILES}, {_CALLS} SELECT 'files' AS what, count(*) AS n FROM files UNION ALL SELECT 'blobs', count(DISTINCT oid) FROM files UNION ALL SELECT 'defs', count(*) FROM part UNION ALL SELECT 'calls', CAST(sum(calls) AS BIGINT) FROM call_name")
def store_totals(spark, sf_dir):
    return R.totals(part_defs(spark, sf_dir), call_name(spark, sf_dir), files(spark, sf_dir))


@query(f"WITH {_PFILES}, {_CHECKOUTS}, {_GEM_USE}, roots AS (SELECT root FROM checkouts WHERE root = 'src3' OR kind IN ('stdlib', 'core') UNION SELECT gem_root FROM gem_use WHERE checkout = 'src3') SELECT checkout, path FROM files WHERE checkout IN (SELECT root FROM roots) AND NOT EXISTS (SELECT 1 FROM nation WHERE 'lib/s' || n_nationkey || '.rb' = path AND 'src' || (n_nationkey % 20) = checkout)")
def visible_tree_files(spark, sf_dir):
    k = F.col("n_nationkey")
    hidden = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), (k % 20).cast("string")).alias("checkout"), F.concat(F.lit("lib/s"), k.cast("string"), F.lit(".rb")).alias("path"))
    roots = R.tree_roots("src3", checkouts(spark, sf_dir), gem_use(spark, sf_dir))
    return R.visible_files(part_files(spark, sf_dir), roots, hidden).select("checkout", "path")


@query("WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), r AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS root FROM p, unnest([1, 2]) AS u(n)) SELECT path, (SELECT root FROM r WHERE path = root OR starts_with(path, root || '/') ORDER BY length(root) DESC LIMIT 1) AS root FROM p")
def owning_checkout(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    parts = F.split("path", "/")
    roots = paths.select(F.explode(F.array(F.array_join(F.slice(parts, 1, 1), "/"), F.array_join(F.slice(parts, 1, 2), "/"))).alias("root")).distinct()
    return R.owning_checkout(paths, roots)


@query(f"WITH {_CHECKOUTS}, {_GEM_USE} SELECT gem_root, arg_max(checkout, (indexed_at, checkout)) AS checkout FROM gem_use JOIN checkouts ON root = checkout GROUP BY gem_root")
def app_for_gem(spark, sf_dir):
    return R.app_for_gem(gem_use(spark, sf_dir), checkouts(spark, sf_dir))


@query("SELECT source AS checkout, CAST(sum(CAST(('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 12)) AS HUGEINT)) % 18446744073709551616::HUGEINT AS VARCHAR) AS digest FROM documents GROUP BY source")
def surface_keys(spark, sf_dir):
    value = F.conv(F.substring(F.sha1(F.col("doc_id").cast("string").cast("binary")), 1, 12), 16, 10).cast("bigint")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("checkout"), value.alias("v"))
    return R.digest(rows, F.col("v")).select("checkout", F.col("digest").cast("string").alias("digest"))


@query("WITH n AS (SELECT DISTINCT 'N' || (n_regionkey) || '::' || 'A' || (n_nationkey % 7) || '::B' AS fqn FROM nation), s AS (SELECT fqn, unnest(['B', string_split(fqn, '::')[2] || '::B', fqn]) AS spelling FROM n), r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' || (user_id % 7) || '::B' ELSE '::N' || (user_id % 5) || '::A' || (user_id % 7) || '::B' END AS name FROM events) SELECT fqn, event_id AS line FROM r JOIN s ON regexp_replace(name, '^::', '') = spelling")
def constant_spellings(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_regionkey").cast("string"), F.lit("::A"), (F.col("n_nationkey") % 7).cast("string"), F.lit("::B")).alias("fqn")).distinct()
    u = lambda k: (F.col("user_id") % k).cast("string")
    written = F.when(F.col("event_id") % 3 == 0, "B").when(F.col("event_id") % 3 == 1, F.concat(F.lit("A"), u(7), F.lit("::B"))).otherwise(F.concat(F.lit("::N"), u(5), F.lit("::A"), u(7), F.lit("::B")))
    refs = table(spark, sf_dir, "events").select(written.alias("name"), F.col("event_id").alias("line"))
    return R.constant_spellings(n, refs).select("fqn", "line")


# -- places and partial counts ---------------------------------------------------
@query(r"""SELECT doc_id, CAST(length(head) + length(regexp_replace(head, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS INTEGER) AS col FROM (SELECT doc_id, left(text, 20) AS head FROM documents WHERE text IS NOT NULL)""")
def utf16_columns(spark, sf_dir):
    """The UTF-16 column after the first 20 characters of each text."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", S.utf16_column(F.col("text"), F.octet_length(F.left("text", F.lit(20))) + 1).alias("col"))


@query("SELECT source, lang, n - coalesce(less, 0) AS n FROM (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL) LEFT JOIN (SELECT source, lang, count(*) AS less FROM documents JOIN labels USING (doc_id) GROUP BY ALL) USING (source, lang) WHERE n - coalesce(less, 0) <> 0")
def counts_without_labelled(spark, sf_dir):
    """Counts by source and language, less those of labelled documents."""
    from carnelian.operators.incremental import subtract

    d = table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    count = lambda df: df.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return subtract(count(d), count(d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")), ["source", "lang"], ["n"])
