"""Oracle-checked graph, join, aggregate, scalar and incremental queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carnelian.functions import scalars as S
from carnelian.operators import chains as C
from carnelian.operators import incremental as I
from carnelian.operators import references as P
from carnelian.operators import relational as R
from carnelian.plans import relational_queries as Q

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- a namespace from the star schema: customers are classes below their nation's
# class, which is below its region's; market segments and nations' parity are mixins
def star_names(spark, sf_dir):
    one = lambda t, c, kind: Q.table(spark, sf_dir, t).select(F.lit("tpch").alias("checkout"), c.alias("fqn"), F.lit(kind).alias("kind"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = one("customer", name("C", "c_custkey"), "class").unionByName(one("nation", name("N", "n_nationkey"), "class")).unionByName(one("region", name("R", "r_regionkey"), "class"))
    mixins = Q.table(spark, sf_dir, "customer").select(F.lit("tpch").alias("checkout"), F.concat(F.lit("M"), F.lower("c_mktsegment")).alias("fqn"), F.lit("module").alias("kind")).distinct()
    core = spark.createDataFrame([("tpch", "Object", "class"), ("tpch", "Meven", "module"), ("tpch", "Modd", "module")], "checkout string, fqn string, kind string")
    return rows.unionByName(mixins).unionByName(core)


def star_superclasses(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = Q.table(spark, sf_dir, "customer").select(name("C", "c_custkey").alias("owner"), name("N", "c_nationkey").alias("superclass"))
    b = Q.table(spark, sf_dir, "nation").select(name("N", "n_nationkey").alias("owner"), name("R", "n_regionkey").alias("superclass"))
    return a.unionByName(b).select(F.lit("tpch").alias("checkout"), "owner", "superclass", F.col("superclass").alias("written"))


def star_edges(spark, sf_dir):
    c = Q.table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("owner"), F.lit("include").alias("relation"), F.concat(F.lit("M"), F.lower("c_mktsegment")).alias("target"))
    n = Q.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("owner"), F.lit("prepend").alias("relation"), F.when(F.col("n_nationkey") % 2 == 0, "Meven").otherwise("Modd").alias("target"))
    return c.unionByName(n).select(F.lit("tpch").alias("checkout"), "owner", "relation", "target", F.col("target").alias("resolved"), F.lit(1).alias("ord"))


def star_chains(spark, sf_dir):
    return C.linearize(star_names(spark, sf_dir), star_edges(spark, sf_dir), star_superclasses(spark, sf_dir))


_PARITY = "'M' || CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END"
_CHAIN = f"""chain AS (SELECT c_custkey, c_nationkey, 'C' || c_custkey AS fqn, ['C' || c_custkey, 'M' || lower(c_mktsegment), {_PARITY}, 'N' || n_nationkey, 'R' || n_regionkey, 'Object'] AS chain FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@query(f"WITH {_CHAIN} SELECT fqn, array_to_string(chain, ' < ') AS chain FROM chain")
def ancestor_chains(spark, sf_dir):
    rows = star_chains(spark, sf_dir).where("side = 'instance' AND fqn RLIKE '^C[0-9]'")
    return rows.select("fqn", F.array_join(F.transform("chain", lambda x: x["owner"]), " < ").alias("chain"))


@query("SELECT 'C' || c_custkey AS fqn, 'C' || c_custkey || '.,N' || n_nationkey || '.,R' || n_regionkey || '.,Object.' AS chain FROM customer JOIN nation ON n_nationkey = c_nationkey")
def class_side_chains(spark, sf_dir):
    rows = star_chains(spark, sf_dir).where("side = 'class' AND fqn RLIKE '^C[0-9]'")
    return rows.select("fqn", F.array_join(F.transform("chain", lambda x: F.concat(x["owner"], F.when(x["side"] == "class", ".").otherwise("#"))), ",").alias("chain"))


@query("SELECT module, count(*) AS classes, min(fqn) AS first FROM (SELECT 'M' || lower(c_mktsegment) AS module, 'C' || c_custkey AS fqn FROM customer UNION ALL SELECT " + _PARITY + ", 'C' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT " + _PARITY + ", 'N' || n_nationkey FROM nation) GROUP BY module")
def includers(spark, sf_dir):
    rows = C.includers(star_chains(spark, sf_dir), star_names(spark, sf_dir))
    return rows.select("module", F.size("classes").cast("bigint").alias("classes"), F.element_at("classes", 1).alias("first"))


def _mixers_closure(spark, sf_dir, which):
    k = F.col("p_partkey")
    e = Q.table(spark, sf_dir, "part").where(which).select(F.lit("t").alias("checkout"), F.lit("include").alias("relation"), F.concat(F.lit("P"), (k % 40).cast("string")).alias("resolved"), F.concat(F.when(k % 3 == 0, "K").otherwise("P"), ((k % 40) + 1 + F.col("p_size") % 2).cast("string")).alias("owner"))
    names = e.select("checkout", F.col("owner").alias("fqn"), F.when(F.col("owner").startswith("K"), "class").otherwise("module").alias("kind")).distinct()
    return C.mixers(e, names).select("module", "mixer")


@query("WITH e AS (SELECT 'P' || (p_partkey % 40) AS module, CASE WHEN p_partkey % 3 = 0 THEN 'K' ELSE 'P' END || ((p_partkey % 40) + 1 + p_size % 2) AS mixer FROM part WHERE p_partkey % 40 < 30), r AS (SELECT DISTINCT module, mixer FROM e), rec AS (WITH RECURSIVE t AS (SELECT module, mixer FROM r UNION SELECT t.module, r.mixer FROM t JOIN r ON r.module = t.mixer) SELECT * FROM t) SELECT module, mixer FROM rec WHERE mixer LIKE 'K%'")
def mixers_closure(spark, sf_dir):
    return _mixers_closure(spark, sf_dir, F.col("p_partkey") % 40 < 30)


@query("WITH e AS (SELECT 'P' || (p_partkey % 40) AS module, CASE WHEN p_partkey % 3 = 0 THEN 'K' ELSE 'P' END || ((p_partkey % 40) + 1 + p_size % 2) AS mixer FROM part), r AS (SELECT DISTINCT module, mixer FROM e), rec AS (WITH RECURSIVE t AS (SELECT module, mixer FROM r UNION SELECT t.module, r.mixer FROM t JOIN r ON r.module = t.mixer) SELECT * FROM t) SELECT module, mixer FROM rec WHERE mixer LIKE 'K%'")
def mixers_closure_whole(spark, sf_dir):
    return _mixers_closure(spark, sf_dir, F.lit(True))


# -- methods: a brand's name on suppliers' classes of nations
def star_methods(spark, sf_dir):
    """A part is a method of the class of nation, region, segment or customer that its size picks."""
    k = F.col("p_partkey")
    owner = F.when(k % 4 == 0, F.concat(F.lit("N"), (k % 25).cast("string"))).when(k % 4 == 1, F.concat(F.lit("R"), (k % 5).cast("string"))).when(k % 4 == 2, F.when(k % 8 == 2, "Meven").otherwise("Modd")).otherwise("Object")
    return Q.table(spark, sf_dir, "part").select(F.lit("tpch").alias("checkout"), owner.alias("owner"), F.lit("instance").alias("side"), F.concat(F.lit("m"), (F.col("p_size") % 12).cast("string")).alias("name"), (k % 11 == 0).alias("is_rbi"), k.alias("ord"), k.alias("part"))


_METHODS = "meth AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'N' || (p_partkey % 25) WHEN 1 THEN 'R' || (p_partkey % 5) WHEN 2 THEN CASE WHEN p_partkey % 8 = 2 THEN 'Meven' ELSE 'Modd' END ELSE 'Object' END AS owner, 'm' || (p_size % 12) AS name, p_partkey % 11 = 0 AS is_rbi, p_partkey AS part FROM part)"


@query(f"WITH {_CHAIN}, {_METHODS}, link AS (SELECT fqn, unnest(chain) AS owner, generate_subscripts(chain, 1) - 1 AS pos FROM chain), hit AS (SELECT fqn, name, is_rbi, pos, max(part) AS part, any_value(owner) AS owner FROM link JOIN meth USING (owner) GROUP BY fqn, name, is_rbi, pos), r AS (SELECT *, row_number() OVER (PARTITION BY fqn, name ORDER BY is_rbi, pos) AS n FROM hit) SELECT fqn, name, owner, part FROM r WHERE n = 1")
def method_lookup(spark, sf_dir):
    asked = star_names(spark, sf_dir).where("fqn RLIKE '^C[0-9]'").select("checkout", "fqn", F.lit("instance").alias("side")).join(star_methods(spark, sf_dir).select("name").distinct(), how="cross")
    return C.lookup(asked, star_chains(spark, sf_dir), star_methods(spark, sf_dir)).select("fqn", "name", "owner", "part")


@query(f"WITH {_CHAIN}, {_METHODS}, nat AS (SELECT 'N' || n_nationkey AS fqn, [{_PARITY}, 'N' || n_nationkey, 'R' || n_regionkey, 'Object'] AS chain FROM nation), link AS (SELECT fqn, unnest(chain) AS owner, generate_subscripts(chain, 1) - 1 AS pos FROM nat), hit AS (SELECT fqn, name, is_rbi, pos, max(part) AS part, any_value(owner) AS owner FROM link JOIN meth USING (owner) WHERE pos > 1 GROUP BY fqn, name, is_rbi, pos), r AS (SELECT *, row_number() OVER (PARTITION BY fqn, name ORDER BY is_rbi, pos) AS n FROM hit) SELECT fqn, name, owner, part FROM r WHERE n = 1")
def super_lookup(spark, sf_dir):
    asked = star_names(spark, sf_dir).where("fqn RLIKE '^N[0-9]'").select("checkout", "fqn", F.lit("instance").alias("side")).join(star_methods(spark, sf_dir).select("name").distinct(), how="cross")
    return C.lookup(asked, star_chains(spark, sf_dir), star_methods(spark, sf_dir), after_owner=True).select("fqn", "name", "owner", "part")


@query(f"WITH {_METHODS}, d AS (SELECT DISTINCT owner, name FROM meth) SELECT d.name, 'N' || n_nationkey AS owner FROM d JOIN nation ON d.owner = 'N' || n_nationkey WHERE EXISTS (SELECT 1 FROM d e WHERE e.name = d.name AND e.owner IN ('R' || n_regionkey, 'Object'))")
def overrides(spark, sf_dir):
    m = star_methods(spark, sf_dir)
    return P.overriding(m, star_chains(spark, sf_dir)).where("owner RLIKE '^N[0-9]'").select("name", "owner")


@query("WITH v AS (SELECT 'm' || (p_size % 12) AS name, p_brand AS owner, arg_max(CASE WHEN p_partkey % 3 = 0 THEN p_type END, p_partkey) FILTER (WHERE p_partkey % 3 = 0) AS r0, arg_max(p_partkey % 3 = 0, p_partkey) AS declared FROM part GROUP BY 1, 2), w AS (SELECT name, owner, CASE WHEN declared THEN 'T' || (length(r0) % 2) END AS r FROM v) SELECT name, max(r) AS returns, count(r) AS agreeing, count(*) AS total FROM w GROUP BY name HAVING count(DISTINCT r) = 1")
def return_vote(spark, sf_dir):
    returns = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("T"), (F.length("p_type") % 2).cast("string")))
    # the vote of an owner is its last definition's: an undeclared one abstains
    m = Q.table(spark, sf_dir, "part").select(F.lit("t").alias("checkout"), F.concat(F.lit("m"), (F.col("p_size") % 12).cast("string")).alias("name"), F.col("p_brand").alias("owner"), F.lit("instance").alias("side"), F.struct(returns.alias("r")).alias("s"), F.col("p_partkey").alias("ord"))
    last = m.groupBy("checkout", "name", "owner", "side").agg(F.max_by("s", "ord").alias("s"), F.max("ord").alias("ord")).select("checkout", "name", "owner", "side", F.col("s.r").alias("sig_returns"), "ord")
    return C.return_vote(last).select("name", "returns", "agreeing", "total")


# -- constants ------------------------------------------------------------------
@query("""WITH n AS (SELECT DISTINCT 'N' || n_regionkey AS fqn FROM nation UNION SELECT DISTINCT 'N' || n_regionkey || '::A' || (n_nationkey % 7) FROM nation UNION SELECT 'A3' UNION SELECT 'A4'),
r AS (SELECT event_id, 'N' || (user_id % 6) AS scope, 'A' || (event_id % 8) AS written FROM events)
SELECT event_id, coalesce(a.fqn, b.fqn) AS fqn, CASE WHEN a.fqn IS NOT NULL THEN 'lexical' WHEN b.fqn IS NOT NULL THEN 'root' END AS via
FROM r LEFT JOIN n a ON a.fqn = scope || '::' || written LEFT JOIN n b ON b.fqn = written""")
def constant_lookup(spark, sf_dir):
    nation = Q.table(spark, sf_dir, "nation")
    r, a = F.concat(F.lit("N"), F.col("n_regionkey").cast("string")), F.concat(F.lit("A"), (F.col("n_nationkey") % 7).cast("string"))
    names = nation.select(r.alias("fqn")).unionByName(nation.select(F.concat(r, F.lit("::"), a).alias("fqn"))).unionByName(spark.createDataFrame([("A3",), ("A4",)], "fqn string")).distinct().select(F.lit("t").alias("checkout"), "fqn")
    refs = Q.table(spark, sf_dir, "events").select("event_id", F.lit("t").alias("checkout"), F.concat(F.lit("A"), (F.col("event_id") % 8).cast("string")).alias("written"), F.array(F.concat(F.lit("N"), (F.col("user_id") % 6).cast("string"))).alias("scopes"))
    chains = names.select("checkout", "fqn", F.lit("instance").alias("side"), F.array(F.struct(F.col("fqn").alias("owner"), F.lit("instance").alias("side"))).alias("chain"), F.array().cast("array<string>").alias("unresolved"))
    return C.resolve_constant(refs, names, chains).select("event_id", "fqn", "via")


# -- references: a line is a call on its part's brand of a method named by its quantity
def _refs(spark, sf_dir):
    k = F.col("l_partkey")
    tier = F.when(k % 5 == 0, "confirmed").when(k % 5 < 3, "possible").otherwise("excluded")
    why = F.when(k % 5 == 3, "different_owner").when(k % 5 == 4, F.when(k % 2 == 0, "no_such_method").otherwise("arity"))
    return Q.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("q"), (F.col("l_suppkey") % 9).cast("string")).alias("query"), tier.alias("tier"), why.alias("why"), F.when(tier == "possible", (k % 4).cast("int")).alias("proximity"), F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_linenumber").alias("line"), k.cast("int").alias("col"))


@query("WITH r AS (SELECT 'q' || (l_suppkey % 9) AS query, CASE WHEN l_partkey % 5 = 0 THEN 'c' WHEN l_partkey % 5 < 3 THEN 'p' ELSE 'x' END AS t, l_partkey % 5 AS k, l_partkey % 2 AS h FROM lineitem) SELECT query, count(*) FILTER (t = 'c') AS confirmed, count(*) FILTER (t = 'p') AS possible, count(*) FILTER (t = 'x') AS excluded, count(*) FILTER (k = 3) AS different_owner, count(*) FILTER (k = 4 AND h = 0) AS no_such_method, count(*) FILTER (k = 4 AND h = 1) AS arity FROM r GROUP BY query")
def tier_counts(spark, sf_dir):
    return P.counts(_refs(spark, sf_dir), ["query"])


@query("WITH r AS (SELECT 'q' || (l_suppkey % 9) AS query, CASE WHEN l_partkey % 5 = 0 THEN 0 WHEN l_partkey % 5 < 3 THEN 1 ELSE 2 END AS t, 'f' || l_orderkey AS path, l_linenumber AS line, CAST(l_partkey AS INTEGER) AS col, l_partkey % 4 AS p FROM lineitem) SELECT query, path, line, col FROM r ORDER BY t, CASE WHEN t = 1 THEN p ELSE 0 END, path, line, col LIMIT 50")
def best_references(spark, sf_dir):
    return P.best(_refs(spark, sf_dir), 50).select("query", "path", "line", "col")


@query("SELECT CAST(a AS INTEGER) AS agreeing, CAST(t AS INTEGER) AS total, CASE WHEN t = 0 THEN 0.0 ELSE round(a / t, 2) END AS confidence FROM (SELECT DISTINCT l_linenumber % 4 AS a, CAST(l_quantity AS INTEGER) % 8 AS t FROM lineitem)")
def confidence(spark, sf_dir):
    rows = Q.table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).cast("int").alias("agreeing"), (F.col("l_quantity").cast("int") % 8).cast("int").alias("total")).distinct()
    return rows.withColumn("confidence", S.share(F.col("agreeing"), F.col("total")))


_ARITY = "SELECT p_partkey, n, n >= req AND (opt > 0 OR n = req OR (key > 0 AND n = req + 1)) AS fits FROM (SELECT p_partkey, p_size % 4 AS req, p_size % 3 AS opt, p_partkey % 2 AS key FROM part) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS n)"


@query(_ARITY)
def arity_check(spark, sf_dir):
    many = lambda kind, n: F.array_repeat(F.struct(F.lit(kind).alias("kind"), F.lit("x").alias("name")), n.cast("int"))
    rows = Q.table(spark, sf_dir, "part").select("p_partkey", F.concat(many("req", F.col("p_size") % 4), many("opt", F.col("p_size") % 3), many("key", F.col("p_partkey") % 2)).alias("params"), F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("n"))
    return rows.select("p_partkey", "n", S.accepts(F.col("params"), F.col("n")).alias("fits"))


# -- joins by kind ----------------------------------------------------------------
@query("SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, lag(event_id, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_write FROM events")
def as_of_last_write(spark, sf_dir):
    e = Q.table(spark, sf_dir, "events")
    reads = e.select("user_id", "ts", "event_id", F.lit(None).cast("bigint").alias("purchase"))
    writes = e.select("user_id", "ts", "event_id", F.col("event_id").alias("written"))
    last = P.last_write_before(reads.drop("purchase"), writes, ["user_id"], ["ts", "event_id"]).select("event_id", "last_write")
    m = e.select("event_id", F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)).alias("m"))
    return last.join(m, "event_id")


def _enclosing_method(spark, sf_dir, which):
    k = F.col("l_orderkey")
    defs = Q.table(spark, sf_dir, "lineitem").where(which).select(F.lit("t").alias("checkout"), F.col("l_suppkey").cast("string").alias("path"), F.lit("method").alias("kind"), F.concat(F.lit("m"), k.cast("string")).alias("name"), (k % 200).cast("int").alias("line"), (k % 200 + F.col("l_linenumber") * 7).cast("int").alias("end_line"))
    calls = Q.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"), F.lit("t").alias("checkout"), (F.col("o_custkey") % 100 + 1).cast("string").alias("path"), (F.col("o_orderkey") % 250).cast("int").alias("line"))
    return P.enclosing(calls, defs).select("call", "def_name", "def_line")


@query("WITH d AS (SELECT l_suppkey AS f, l_orderkey % 200 AS a, l_orderkey % 200 + l_linenumber * 7 AS b, l_orderkey AS name FROM lineitem WHERE l_linenumber <= 3), c AS (SELECT o_orderkey AS call, o_custkey % 100 + 1 AS f, o_orderkey % 250 AS line FROM orders), h AS (SELECT call, line, name, a, b, row_number() OVER (PARTITION BY call ORDER BY b - a, -a, 'm' || name) AS r FROM c JOIN d USING (f) WHERE line BETWEEN a AND b) SELECT call, 'm' || name AS def_name, CAST(a AS INTEGER) AS def_line FROM h WHERE r = 1")
def enclosing_method(spark, sf_dir):
    return _enclosing_method(spark, sf_dir, F.expr("l_linenumber <= 3"))


@query("WITH d AS (SELECT l_suppkey AS f, l_orderkey % 200 AS a, l_orderkey % 200 + l_linenumber * 7 AS b, l_orderkey AS name FROM lineitem), c AS (SELECT o_orderkey AS call, o_custkey % 100 + 1 AS f, o_orderkey % 250 AS line FROM orders), h AS (SELECT call, line, name, a, b, row_number() OVER (PARTITION BY call ORDER BY b - a, -a, 'm' || name) AS r FROM c JOIN d USING (f) WHERE line BETWEEN a AND b) SELECT call, 'm' || name AS def_name, CAST(a AS INTEGER) AS def_line FROM h WHERE r = 1")
def enclosing_method_whole(spark, sf_dir):
    return _enclosing_method(spark, sf_dir, F.lit(True))


def _nearest_by_directory(spark, sf_dir, which):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    a = Q.table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    b = a.where(which).select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("other")).distinct()
    # candidates are the few roots of a checkout
    return a.join(F.broadcast(b)).groupBy("page_id").agg(F.max(S.shared_dirs(F.col("path"), F.col("other"))).alias("shared"))


@query("WITH a AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages), b AS (SELECT DISTINCT p[1:2] AS q FROM a WHERE page_id % 10 = 0) SELECT page_id, max(CASE WHEN p[1] = q[1] THEN 1 ELSE 0 END) AS shared FROM a, b GROUP BY page_id")
def nearest_by_directory(spark, sf_dir):
    return _nearest_by_directory(spark, sf_dir, F.expr("page_id % 10 = 0"))


@query("WITH a AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages), b AS (SELECT DISTINCT p[1:2] AS q FROM a) SELECT page_id, max(CASE WHEN p[1] = q[1] THEN 1 ELSE 0 END) AS shared FROM a, b GROUP BY page_id")
def nearest_by_directory_whole(spark, sf_dir):
    return _nearest_by_directory(spark, sf_dir, F.lit(True))


@query("WITH s AS (SELECT DISTINCT p_type[1:2] || '*' AS shape, '^' || p_type[1:2] || '.+$' AS re FROM part UNION SELECT '*' || p_name[-1:], '^.+' || p_name[-1:] || '$' FROM part) SELECT DISTINCT shape, name FROM s, (SELECT DISTINCT p_type AS name FROM part UNION SELECT p_name FROM part) WHERE regexp_matches(name, re)")
def shape_match(spark, sf_dir):
    p = Q.table(spark, sf_dir, "part")
    names = p.select(F.col("p_type").alias("name")).unionByName(p.select(F.col("p_name").alias("name"))).distinct()
    shapes = p.select(F.concat(F.substring("p_type", 1, 2), F.lit("*")).alias("shape")).unionByName(p.select(F.concat(F.lit("*"), F.substring("p_name", -1, 1)).alias("shape"))).distinct()
    # shapes are few; names are matched against each
    return names.join(F.broadcast(shapes), S.shape_matches(F.col("shape"), F.col("name"))).select("shape", "name").distinct()


def _candidate_callers(spark, sf_dir, which):
    from carnelian.operators.dead import inside_candidates

    k = F.col("l_orderkey")
    ident = k * 10 + F.col("l_linenumber")
    rows = Q.table(spark, sf_dir, "lineitem").where(which).select(ident.alias("query"), F.lit("t").alias("checkout"), F.col("l_suppkey").cast("string").alias("path"), (k % 200).alias("line"), (k % 200 + 9).alias("end_line"), F.lit("single-caller").alias("tier"))
    rows = rows.withColumn("caller", F.struct("path", ((F.col("query") * 7) % 200).alias("line")))
    return inside_candidates(rows).groupBy(F.col("query").alias("id")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT l_suppkey AS f, l_orderkey % 200 AS a, l_orderkey % 200 + 9 AS b, l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_linenumber = 1), c AS (SELECT id, f, (id * 7) % 200 AS ln FROM s) SELECT c.id AS id, count(*) AS n FROM c JOIN s ON s.f = c.f AND c.ln BETWEEN s.a AND s.b AND s.id <> c.id GROUP BY c.id")
def candidate_callers(spark, sf_dir):
    return _candidate_callers(spark, sf_dir, F.expr("l_linenumber = 1"))


@query("WITH s AS (SELECT l_suppkey AS f, l_orderkey % 200 AS a, l_orderkey % 200 + 9 AS b, l_orderkey * 10 + l_linenumber AS id FROM lineitem), c AS (SELECT id, f, (id * 7) % 200 AS ln FROM s) SELECT c.id AS id, count(*) AS n FROM c JOIN s ON s.f = c.f AND c.ln BETWEEN s.a AND s.b AND s.id <> c.id GROUP BY c.id")
def candidate_callers_whole(spark, sf_dir):
    return _candidate_callers(spark, sf_dir, F.lit(True))


# -- dead code ----------------------------------------------------------------------
def _dead_tiers(spark, sf_dir, which):
    from carnelian.operators.dead import tier_of

    live = F.col("l_suppkey") % 2 == 0
    part = lambda n, name: F.count_if(live & (F.col("l_linenumber") % 3 == n)).alias(name)
    rows = Q.table(spark, sf_dir, "lineitem").where(which).groupBy(F.col("l_partkey").alias("q")).agg(part(0, "written"), part(1, "supers"), part(2, "symbols"))
    return rows.select("q", tier_of(F.col("written"), F.col("supers"), F.col("symbols")).alias("tier"))


@query("WITH r AS (SELECT l_partkey AS q, count(*) FILTER (l_linenumber % 3 = 0 AND l_suppkey % 2 = 0) AS written, count(*) FILTER (l_linenumber % 3 = 1 AND l_suppkey % 2 = 0) AS supers, count(*) FILTER (l_linenumber % 3 = 2 AND l_suppkey % 2 = 0) AS symbols FROM lineitem WHERE l_quantity > 40 GROUP BY q) SELECT q, CASE WHEN written = 0 AND supers = 0 AND symbols = 0 THEN 'unreferenced' WHEN written = 0 AND supers = 0 THEN 'convention-only' WHEN written = 0 THEN 'super-only' WHEN written = 1 AND supers = 0 THEN 'single-caller' END AS tier FROM r")
def dead_tiers(spark, sf_dir):
    return _dead_tiers(spark, sf_dir, F.expr("l_quantity > 40"))


@query("WITH r AS (SELECT l_partkey AS q, count(*) FILTER (l_linenumber % 3 = 0 AND l_suppkey % 2 = 0) AS written, count(*) FILTER (l_linenumber % 3 = 1 AND l_suppkey % 2 = 0) AS supers, count(*) FILTER (l_linenumber % 3 = 2 AND l_suppkey % 2 = 0) AS symbols FROM lineitem GROUP BY q) SELECT q, CASE WHEN written = 0 AND supers = 0 AND symbols = 0 THEN 'unreferenced' WHEN written = 0 AND supers = 0 THEN 'convention-only' WHEN written = 0 THEN 'super-only' WHEN written = 1 AND supers = 0 THEN 'single-caller' END AS tier FROM r")
def dead_tiers_whole(spark, sf_dir):
    return _dead_tiers(spark, sf_dir, F.lit(True))


@query("SELECT tier, confidence, kind, count(*) AS n FROM (SELECT l_returnflag AS tier, l_linestatus AS confidence, CASE WHEN l_linenumber = 1 THEN 'method' ELSE 'constant' END AS kind FROM lineitem) GROUP BY GROUPING SETS ((tier), (confidence), (kind))")
def dead_summary(spark, sf_dir):
    from carnelian.operators.dead import summary

    rows = Q.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tier"), F.col("l_linestatus").alias("confidence"), F.when(F.col("l_linenumber") == 1, "method").otherwise("constant").alias("kind"))
    return summary(rows)


# -- scalars ------------------------------------------------------------------------
@query("SELECT DISTINCT p_type AS name, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1:1]) || w[2:]), '') AS camel, replace(lower(p_type), ' ', '_') AS snake FROM part")
def naming(spark, sf_dir):
    snake = F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))
    rows = Q.table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), S.camelize(snake).alias("camel")).distinct()
    return rows.select("name", "camel", S.underscore(F.col("camel")).alias("snake"))


@query("SELECT DISTINCT path, apart FROM (SELECT d || '/' || e || '/x.rb' AS path, CASE WHEN d IN ('spec', 'test') THEN true WHEN d IN ('lib', 'app') THEN false ELSE e IN ('spec', 'test') END AS apart FROM (SELECT ['lib', 'spec', 'test', 'app', 'doc'][CAST(p_size % 5 + 1 AS INTEGER)] AS d, ['a', 'spec', 'lib', 'test'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS e FROM part))")
def test_directories(spark, sf_dir):
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), n.cast("int") + 1)
    path = F.concat(pick(("lib", "spec", "test", "app", "doc"), F.col("p_size") % 5), F.lit("/"), pick(("a", "spec", "lib", "test"), F.col("p_partkey") % 4), F.lit("/x.rb"))
    return Q.table(spark, sf_dir, "part").select(path.alias("path")).distinct().withColumn("apart", S.in_tests(F.col("path")))


@query("SELECT DISTINCT v, (a, b, c) >= (2, 3, 0) AND a < 3 AS ok, (a, b, c) > (1, 9, 0) AS above FROM (SELECT a || '.' || b || '.' || c AS v, a, b, c FROM (SELECT CAST(p_size % 4 AS INTEGER) AS a, CAST(p_partkey % 12 AS INTEGER) AS b, CAST(p_partkey % 3 AS INTEGER) AS c FROM part))")
def gem_versions(spark, sf_dir):
    v = F.concat_ws(".", (F.col("p_size") % 4).cast("string"), (F.col("p_partkey") % 12).cast("string"), (F.col("p_partkey") % 3).cast("string"))
    rows = Q.table(spark, sf_dir, "part").select(v.alias("v")).distinct()
    return rows.select("v", S.satisfies(F.col("v"), "~>", "2.3").alias("ok"), S.satisfies(F.col("v"), ">", "1.9.0").alias("above"))


@query("SELECT DISTINCT n_name AS word, CASE WHEN regexp_matches(lower(n_name), '(ss|sh|ch|x)$') THEN lower(n_name) || 'es' WHEN regexp_matches(lower(n_name), '([^aeiouy]|qu)y$') THEN regexp_replace(lower(n_name), 'y$', 'ies') WHEN regexp_matches(lower(n_name), '(a)$') AND regexp_matches(lower(n_name), '[ti]a$') THEN lower(n_name) WHEN regexp_matches(lower(n_name), 's$') THEN lower(n_name) WHEN regexp_matches(lower(n_name), '[ti]um$') THEN regexp_replace(lower(n_name), 'um$', 'a') ELSE lower(n_name) || 's' END AS plural FROM nation")
def inflection(spark, sf_dir):
    return Q.table(spark, sf_dir, "nation").select(F.col("n_name").alias("word"), S.plural(F.lower("n_name")).alias("plural")).distinct()


@query("SELECT DISTINCT t, CASE t WHEN 'string' THEN 'String' WHEN 'bigint' THEN 'Integer' WHEN 'jsonb' THEN 'Hash' WHEN 'money' THEN 'BigDecimal' END AS class FROM (SELECT ['string', 'bigint', 'jsonb', 'money', 'boolean'][CAST(p_size % 5 + 1 AS INTEGER)] AS t FROM part)")
def column_classes(spark, sf_dir):
    t = F.element_at(F.array(*[F.lit(x) for x in ("string", "bigint", "jsonb", "money", "boolean")]), (F.col("p_size") % 5).cast("int") + 1)
    return Q.table(spark, sf_dir, "part").select(t.alias("t")).distinct().withColumn("class", S.column_class(F.col("t")))


# -- incremental ----------------------------------------------------------------------
@query("SELECT source AS checkout, 'd' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 5 = 1 THEN 'removed' ELSE 'moved' END AS change FROM documents WHERE doc_id % 5 IN (0, 1, 2)")
def file_map_delta(spark, sf_dir):
    d = Q.table(spark, sf_dir, "documents").select(F.col("source").alias("checkout"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id")
    stored = d.where("doc_id % 5 <> 0").select("checkout", "path", F.col("doc_id").cast("string").alias("oid"))
    scanned = d.where("doc_id % 5 <> 1").select("checkout", "path", F.when(F.col("doc_id") % 5 == 2, "new").otherwise(F.col("doc_id").cast("string")).alias("oid"))
    return I.map_delta(stored, scanned).select("checkout", "path", "change")


@query("SELECT source AS checkout, 'd' || doc_id AS path, CASE WHEN doc_id % 10 = 3 THEN 'edit' ELSE CAST(doc_id AS VARCHAR) END AS oid FROM documents WHERE doc_id % 10 <> 4")
def query_overlay(spark, sf_dir):
    d = Q.table(spark, sf_dir, "documents").select(F.col("source").alias("checkout"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").cast("string").alias("oid"), "doc_id")
    edits = d.where("doc_id % 10 IN (3, 4)").select("checkout", "path", F.when(F.col("doc_id") % 10 == 3, "edit").alias("oid"))
    return I.overlay(d.select("checkout", "path", "oid"), edits)


@query("SELECT source AS checkout, count(*) AS changes, count(*) > 32 AS stale FROM documents WHERE doc_id % 5 IN (0, 1, 2, 3) AND (CAST(substr(source, 4) AS INTEGER) < 10 OR doc_id % 2 = 0) GROUP BY source")
def freshness_probe(spark, sf_dir):
    rows = Q.table(spark, sf_dir, "documents").where("doc_id % 5 IN (0, 1, 2, 3) AND (cast(substring(source, 4) AS int) < 10 OR doc_id % 2 = 0)")
    return I.freshness(rows.select(F.col("source").alias("checkout")))


_DAY = "CAST(CAST(ts AS DATE) AS DATE)"


@query(f"SELECT {_DAY} AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING {_DAY} >= (SELECT max({_DAY}) FROM events) - 90")
def usage_counters(spark, sf_dir):
    e = Q.table(spark, sf_dir, "events")
    today = e.agg(F.max(F.to_date("ts")).alias("d")).first().d
    return I.prune_usage(I.usage_daily(e, ["event_type"]), F.lit(today))


@query("SELECT event_type, CASE WHEN value < 1 THEN '<1ms' WHEN value < 10 THEN '<10ms' WHEN value < 100 THEN '<100ms' WHEN value < 1000 THEN '<1s' WHEN value < 10000 THEN '<10s' ELSE '>=10s' END AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def latency_buckets(spark, sf_dir):
    return I.latency_histogram(Q.table(spark, sf_dir, "events"), F.col("value"), ["event_type"])


@query("WITH h AS (SELECT event_type, CASE WHEN value < 1 THEN 0 WHEN value < 10 THEN 1 WHEN value < 100 THEN 2 WHEN value < 1000 THEN 3 WHEN value < 10000 THEN 4 ELSE 5 END AS b, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY b) AS running, sum(n) OVER (PARTITION BY event_type) AS total FROM h) SELECT event_type, ['<1ms', '<10ms', '<100ms', '<1s', '<10s', '>=10s'][min(b) + 1] AS bucket FROM r WHERE running >= ceil(total * 0.9) GROUP BY event_type")
def latency_percentile(spark, sf_dir):
    h = I.latency_histogram(Q.table(spark, sf_dir, "events"), F.col("value"), ["event_type"])
    order = F.array_position(F.array(*[F.lit(x) for x in ("<1ms", "<10ms", "<100ms", "<1s", "<10s", ">=10s")]), F.col("bucket"))
    return I.histogram_quantile(h, ["event_type"], order, 0.9)


@query("WITH mx AS (SELECT max(ts) AS now FROM events), u AS (SELECT event_id, ts FROM events WHERE user_id % 3 <> 0) SELECT event_id FROM u, mx WHERE ts < now - INTERVAL 14 DAY")
def blob_retention(spark, sf_dir):
    e = Q.table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("t")).first().t
    ident = F.col("event_id").cast("string")
    loose = I.stamp_unmapped(e.select(ident.alias("oid")), e.where("user_id % 3 = 0").select(ident.alias("oid")), e.select(ident.alias("oid"), F.col("ts").alias("recorded_at")), F.lit(now))
    return I.collectable(loose, F.lit(now)).select(F.col("oid").cast("bigint").alias("event_id"))


@query(f"WITH {Q._CHECKOUTS}, {Q._GEM_USE}, disk AS (SELECT root FROM checkouts WHERE CAST(substr(root, 4) AS INTEGER) % 3 <> 0) SELECT root, kind FROM checkouts WHERE root NOT IN (SELECT root FROM disk) OR (kind = 'gem' AND root NOT IN (SELECT gem_root FROM gem_use WHERE checkout IN (SELECT d.root FROM disk d JOIN checkouts c USING (root) WHERE c.kind = 'repo')))")
def reachability_garbage(spark, sf_dir):
    c = Q.checkouts(spark, sf_dir)
    disk = c.where("cast(substring(root, 4) AS int) % 3 <> 0").select("root")
    return I.garbage(c, disk, Q.gem_use(spark, sf_dir)).select("root", "kind")


@query("SELECT checkout, name, round(c * CASE WHEN o = 0 THEN 1.0 ELSE r / o END, 2) AS confidence FROM (SELECT 'R' || n_regionkey AS checkout, n_name AS name, 0.5 AS c, n_regionkey AS r, 4 AS o FROM nation)")
def partial_answers(spark, sf_dir):
    n = Q.table(spark, sf_dir, "nation").select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("checkout"), F.col("n_name").alias("name"), F.lit(0.5).alias("confidence"), F.col("n_regionkey").alias("read"), F.lit(4).alias("of"))
    return I.coverage(n.select("checkout", "read", "of").distinct(), n.select("checkout", "name", "confidence"))
