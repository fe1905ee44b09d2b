"""Queries over the program that the tables make, through the whole engine, and SQL that says what it should find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.api import Index
from carnelian.operators import chains as C
from carnelian.operators import dead, positions
from carnelian.operators import references as P
from carnelian.plans import program

QUERIES: dict = {}
ORACLES: dict = {}
_indexes: dict[tuple[str, str], Index] = {}

#: Rows of the tables as the program names them.
_ROWS = f"""
WITH reg AS (SELECT r_regionkey AS r, 'lib/regions/region' || r_regionkey || '.rb' AS path FROM region),
nat AS (SELECT n_nationkey AS n, n_regionkey AS r, 'app/models/nation' || n_nationkey || '.rb' AS path FROM nation),
sup AS (SELECT s_suppkey AS s, s_nationkey AS n, n_regionkey AS r, {program.SHIPS_TO} AS m, 'app/models/supplier' || s_suppkey || '.rb' AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey),
als AS (SELECT n_nationkey AS n, 'lib/aliases/alias' || n_nationkey || '.rb' AS path FROM nation),
place AS (SELECT 'app/models/place.rb' AS path)"""

#: Every call in the body of a method: path, line, col, name, recv, recv_text, argc.
_CALLS = """
call AS (
  SELECT path, 7 AS line, 5 AS col, 'name' AS name, 'implicit' AS recv, CAST(NULL AS VARCHAR) AS recv_text, 0 AS argc FROM place
  UNION ALL SELECT path, 9, 5, 'new', 'implicit', NULL, 0 FROM nat
  UNION ALL SELECT path, 13, 5, 'region_key', 'implicit', NULL, 0 FROM nat
  UNION ALL SELECT path, 3, 5, 'name', 'implicit', NULL, 0 FROM sup
  UNION ALL SELECT path, 4, 14 + length('Nation' || m), 'new', 'const', 'Nation' || m, 0 FROM sup
  UNION ALL SELECT path, 5, 11, 'describe', 'local', 'place', 0 FROM sup
  UNION ALL SELECT path, 6, 5, 'rate', 'implicit', NULL, 1 FROM sup
  UNION ALL SELECT path, 6, 10, 'build', 'const', 'Away', 1 FROM als
  UNION ALL SELECT path, 10, 11, 'describe', 'local', 'thing', 0 FROM als)"""

_REFERENCES = """
ref AS (
  SELECT 'Nation' || q.n || '#describe' AS query, sup.path, 5 AS line, CASE WHEN q.n = m THEN 'confirmed' ELSE 'excluded' END AS tier, CASE WHEN q.n = m THEN 'lands on it' ELSE 'different_owner' END AS why FROM sup, nat q
  UNION ALL SELECT 'Place#describe', path, 5, 'excluded', 'different_owner' FROM sup
  UNION ALL SELECT owner || '#describe', als.path, 10, 'possible', 'untyped receiver' FROM als, (SELECT 'Nation' || n AS owner FROM nat UNION ALL SELECT 'Place') q
  UNION ALL SELECT 'Place#name', path, 7, 'confirmed', 'lands on it' FROM place
  UNION ALL SELECT 'Place#name', path, 3, 'confirmed', 'lands on it' FROM sup
  UNION ALL SELECT 'Region' || q.r || '#region_key', nat.path, 13, CASE WHEN q.r = nat.r THEN 'confirmed' ELSE 'excluded' END, CASE WHEN q.r = nat.r THEN 'lands on it' ELSE 'different_owner' END FROM nat, reg q)"""

_DEAD = """
dead AS (
  SELECT 'Place#unused_here' AS query, path, 10 AS line, 12 AS end_line FROM place
  UNION ALL SELECT 'Region' || r || '#shared_' || r, path, 6, 8 FROM reg
  UNION ALL SELECT 'Alias' || n || '.make', path, 5, 7 FROM als
  UNION ALL SELECT 'Alias' || n || '.guess', path, 9, 11 FROM als
  UNION ALL SELECT 'Supplier' || s || '#ship', path, 2, 7 FROM sup
  UNION ALL SELECT 'Supplier' || s || '#idle_' || s, path, 13, 15 FROM sup)"""


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the program of one scale factor, made once for a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(spark, program.scan(spark, sf_dir))
    return _indexes[key]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(index(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return register


def _in_methods(df: DataFrame) -> DataFrame:
    """Without the calls that a class body makes itself."""
    return df.where("name NOT IN ('include', 'attr_reader')")


def _dotted(chain: str):
    return F.array_join(F.transform(chain, lambda x: F.concat(x["owner"], F.when(x["side"] == "class", ".").otherwise("#"))), " ")


@query(
    f"""{_ROWS}
SELECT path, x.name, x.kind, x.owner, x.singleton, x.line, x.end_line FROM (
  SELECT path, unnest([{{'name': 'Place', 'kind': 'class', 'owner': '', 'singleton': false, 'line': 1, 'end_line': 13}}, {{'name': 'name', 'kind': 'method', 'owner': 'Place', 'singleton': false, 'line': 2, 'end_line': 4}},
    {{'name': 'describe', 'kind': 'method', 'owner': 'Place', 'singleton': false, 'line': 6, 'end_line': 8}}, {{'name': 'unused_here', 'kind': 'method', 'owner': 'Place', 'singleton': false, 'line': 10, 'end_line': 12}}]) AS x FROM place
  UNION ALL SELECT path, unnest([{{'name': 'Region' || r, 'kind': 'module', 'owner': '', 'singleton': false, 'line': 1, 'end_line': 9}}, {{'name': 'region_key', 'kind': 'method', 'owner': 'Region' || r, 'singleton': false, 'line': 2, 'end_line': 4}},
    {{'name': 'shared_' || r, 'kind': 'method', 'owner': 'Region' || r, 'singleton': false, 'line': 6, 'end_line': 8}}]) FROM reg
  UNION ALL SELECT path, unnest([{{'name': 'Nation' || n, 'kind': 'class', 'owner': '', 'singleton': false, 'line': 1, 'end_line': 16}}, {{'name': 'LIMIT', 'kind': 'constant', 'owner': 'Nation' || n, 'singleton': false, 'line': 4, 'end_line': 4}},
    {{'name': 'code', 'kind': 'method', 'owner': 'Nation' || n, 'singleton': false, 'line': 6, 'end_line': 6}}, {{'name': 'build', 'kind': 'method', 'owner': 'Nation' || n, 'singleton': true, 'line': 8, 'end_line': 10}},
    {{'name': 'describe', 'kind': 'method', 'owner': 'Nation' || n, 'singleton': false, 'line': 12, 'end_line': 15}}]) FROM nat
  UNION ALL SELECT path, unnest([{{'name': 'Supplier' || s, 'kind': 'class', 'owner': '', 'singleton': false, 'line': 1, 'end_line': 16}}, {{'name': 'ship', 'kind': 'method', 'owner': 'Supplier' || s, 'singleton': false, 'line': 2, 'end_line': 7}},
    {{'name': 'rate', 'kind': 'method', 'owner': 'Supplier' || s, 'singleton': false, 'line': 9, 'end_line': 11}}, {{'name': 'idle_' || s, 'kind': 'method', 'owner': 'Supplier' || s, 'singleton': false, 'line': 13, 'end_line': 15}}]) FROM sup
  UNION ALL SELECT path, unnest([{{'name': 'Alias' || n, 'kind': 'module', 'owner': '', 'singleton': false, 'line': 1, 'end_line': 12}}, {{'name': 'Home', 'kind': 'constant', 'owner': 'Alias' || n, 'singleton': false, 'line': 2, 'end_line': 2}},
    {{'name': 'Away', 'kind': 'constant', 'owner': 'Alias' || n, 'singleton': false, 'line': 3, 'end_line': 3}}, {{'name': 'make', 'kind': 'method', 'owner': 'Alias' || n, 'singleton': true, 'line': 5, 'end_line': 7}},
    {{'name': 'guess', 'kind': 'method', 'owner': 'Alias' || n, 'singleton': true, 'line': 9, 'end_line': 11}}]) FROM als)"""
)
def program_definitions(ix):
    return ix.placed_facts("defs").select("path", "name", "kind", F.array_join("nesting", "::").alias("owner"), "singleton", "line", "end_line")


@query(f"{_ROWS} SELECT 'Place' AS fqn, 'class' AS kind UNION ALL SELECT 'Region' || r, 'module' FROM reg UNION ALL SELECT 'Nation' || n, 'class' FROM nat UNION ALL SELECT 'Nation' || n || '::LIMIT', 'constant' FROM nat UNION ALL SELECT 'Supplier' || s, 'class' FROM sup UNION ALL SELECT 'Alias' || n || x.rest, x.kind FROM als, (SELECT unnest([{{'rest': '', 'kind': 'module'}}, {{'rest': '::Home', 'kind': 'constant'}}, {{'rest': '::Away', 'kind': 'constant'}}]) AS x)")
def program_names(ix):
    return ix.own_names.select("fqn", "kind")


@query(f"{_ROWS} SELECT 'Nation' || n AS owner, 'include' AS relation, 'Region' || r AS target, 'Region' || r AS resolved FROM nat UNION ALL SELECT 'Nation' || n, 'superclass', 'Place', 'Place' FROM nat UNION ALL SELECT 'Supplier' || s, 'superclass', 'Nation' || n, 'Nation' || n FROM sup")
def program_edges(ix):
    return ix.edges.select("owner", "relation", "target", "resolved")


@query(
    f"""{_ROWS},
above AS (SELECT 'Place' AS fqn, '' AS below, '' AS class_below UNION ALL SELECT 'Nation' || n, 'Nation' || n || '# Region' || r || '# ', 'Nation' || n || '. ' FROM nat
  UNION ALL SELECT 'Supplier' || s, 'Supplier' || s || '# Nation' || n || '# Region' || r || '# ', 'Supplier' || s || '. Nation' || n || '. ' FROM sup)
SELECT fqn, 'instance' AS side, below || 'Place# Object# BasicObject#' AS chain FROM above
UNION ALL SELECT fqn, 'class', class_below || 'Place. Object. BasicObject. Class# Module# Object# BasicObject#' FROM above
UNION ALL SELECT name, 'instance', name || '#' FROM (SELECT 'Region' || r AS name FROM reg UNION ALL SELECT 'Alias' || n FROM als) UNION ALL SELECT name, 'class', name || '. Module# Object# BasicObject#' FROM (SELECT 'Region' || r AS name FROM reg UNION ALL SELECT 'Alias' || n FROM als)"""
)
def program_chains(ix):
    own = ix.own_names.where("kind <> 'constant'").select("checkout", "fqn")
    return ix.chains.join(own, ["checkout", "fqn"], "left_semi").select("fqn", "side", _dotted("chain").alias("chain"))


@query(f"{_ROWS}, {_CALLS} SELECT * FROM call")
def program_calls(ix):
    return _in_methods(ix.placed_facts("calls")).select("path", "line", "col", "name", "recv", "recv_text", "argc")


@query(
    f"""{_ROWS}
SELECT path, 1 AS line, 'Place' AS written, 'Place' AS fqn, 'root' AS via FROM nat UNION ALL SELECT path, 2, 'Region' || r, 'Region' || r, 'root' FROM nat UNION ALL SELECT path, 14, 'LIMIT', 'Nation' || n || '::LIMIT', 'lexical' FROM nat
UNION ALL SELECT path, 1, 'Nation' || n, 'Nation' || n, 'root' FROM sup UNION ALL SELECT path, 4, 'Nation' || m, 'Nation' || m, 'root' FROM sup
UNION ALL SELECT path, 10, 'LIMIT', 'Nation' || n || '::LIMIT', 'ancestor' FROM sup UNION ALL SELECT path, 14, 'Region' || r, 'Region' || r, 'root' FROM sup
UNION ALL SELECT path, 2, 'Nation' || n, 'Nation' || n, 'root' FROM als UNION ALL SELECT path, 3, 'Home', 'Alias' || n || '::Home', 'lexical' FROM als UNION ALL SELECT path, 6, 'Away', 'Alias' || n || '::Away', 'lexical' FROM als"""
)
def program_constants(ix):
    return ix.constants().select("path", "line", "written", "fqn", "via")


@query(
    f"""{_ROWS}
SELECT path, 7 AS line, 'name' AS name, 'Place' AS fqn, 'instance' AS side, 'self' AS via FROM place UNION ALL SELECT path, 9, 'new', 'Nation' || n, 'class', 'self' FROM nat UNION ALL SELECT path, 13, 'region_key', 'Nation' || n, 'instance', 'self' FROM nat
UNION ALL SELECT path, 3, 'name', 'Supplier' || s, 'instance', 'self' FROM sup UNION ALL SELECT path, 4, 'new', 'Nation' || m, 'class', 'const' FROM sup
UNION ALL SELECT path, 5, 'describe', 'Nation' || m, 'instance', 'local:new' FROM sup UNION ALL SELECT path, 6, 'rate', 'Supplier' || s, 'instance', 'self' FROM sup
UNION ALL SELECT path, 6, 'build', 'Nation' || n, 'class', 'const' FROM als"""
)
def program_receivers(ix):
    return ix.receivers.join(_in_methods(ix.calls).select("call_id", "path", "line", "name"), "call_id").select("path", "line", "name", "fqn", "side", "via")


@query(
    f"""{_ROWS}
SELECT path, 7 AS line, 'name' AS name, 'resolved' AS status, 'Place' AS owner, 'app/models/place.rb' AS def_path, 2 AS def_line FROM place
UNION ALL SELECT path, 9, 'new', 'residue', NULL, NULL, NULL FROM nat UNION ALL SELECT path, 13, 'region_key', 'resolved', 'Region' || r, 'lib/regions/region' || r || '.rb', 2 FROM nat
UNION ALL SELECT path, 3, 'name', 'resolved', 'Place', 'app/models/place.rb', 2 FROM sup UNION ALL SELECT path, 4, 'new', 'residue', NULL, NULL, NULL FROM sup
UNION ALL SELECT path, 5, 'describe', 'resolved', 'Nation' || m, 'app/models/nation' || m || '.rb', 12 FROM sup UNION ALL SELECT path, 6, 'rate', 'resolved', 'Supplier' || s, path, 9 FROM sup
UNION ALL SELECT path, 6, 'build', 'resolved', 'Nation' || n, 'app/models/nation' || n || '.rb', 8 FROM als UNION ALL SELECT path, 10, 'describe', 'residue', NULL, NULL, NULL FROM als"""
)
def program_answers(ix):
    return _in_methods(ix.answers()).select("path", "line", "name", "status", "owner", "def_path", "def_line")


def _asked(ix) -> DataFrame:
    asked = ix.methods.where("name IN ('describe', 'name', 'region_key') AND side = 'instance'")
    return ix.references_of(asked.select(F.concat("owner", F.lit("#"), "name").alias("query"), "owner", "side", "name"))


@query(f"{_ROWS}, {_REFERENCES} SELECT * FROM ref")
def program_references(ix):
    return _asked(ix).select("query", "path", "line", "tier", "why")


@query(
    f"""{_ROWS}, {_REFERENCES}
SELECT query, count(*) FILTER (tier = 'confirmed') AS confirmed, count(*) FILTER (tier = 'possible') AS possible, count(*) FILTER (tier = 'excluded') AS excluded, count(*) FILTER (why = 'different_owner') AS different_owner FROM ref GROUP BY query"""
)
def program_reference_counts(ix):
    return P.counts(_asked(ix), ["query"]).select("query", "confirmed", "possible", "excluded", "different_owner")


@query(f"{_ROWS} SELECT 'Nation' || m || '#describe' AS query, path, 'ship' AS caller, 2 AS def_line, CAST(1 AS BIGINT) AS calls FROM sup")
def program_call_hierarchy(ix):
    confirmed = _asked(ix).where("tier = 'confirmed' AND name = 'describe'")
    return P.call_hierarchy(confirmed, ix.placed_facts("defs")).select("query", "path", "caller", "def_line", "calls")


@query(f"{_ROWS}, {_DEAD} SELECT *, 'unreferenced' AS tier, 'clear' AS confidence FROM dead")
def program_dead_methods(ix):
    return ix.dead_methods().select("query", "path", "line", "end_line", "tier", "confidence")


@query(f"{_ROWS}, {_DEAD} SELECT CAST(NULL AS VARCHAR) AS confidence, CAST(NULL AS VARCHAR) AS kind, 'unreferenced' AS tier, count(*) AS n FROM dead UNION ALL SELECT 'clear', NULL, NULL, count(*) FROM dead UNION ALL SELECT NULL, 'method', NULL, count(*) FROM dead")
def program_dead_summary(ix):
    return dead.summary(ix.dead_methods().withColumn("kind", F.lit("method")))


@query(f"{_ROWS} SELECT 'Alias' || n AS fqn, 'module' AS kind, 'unreferenced' AS tier, path FROM als UNION ALL SELECT 'Supplier' || s, 'class', 'unreferenced', path FROM sup")
def program_dead_constants(ix):
    return ix.dead_constants().select("fqn", "kind", "tier", "path")


@query(f"{_ROWS} SELECT 'Nation' || n AS owner, 'instance' AS side, 'describe' AS name, 'Place' AS ancestor FROM nat")
def program_overrides(ix):
    return P.overriding(ix.methods, ix.chains).select("owner", "side", "name", "ancestor")


@query(f"{_ROWS} SELECT 'Region' || r AS module, 'Nation' || n AS class FROM nat UNION ALL SELECT 'Region' || r, 'Supplier' || s FROM sup")
def program_includers(ix):
    return C.includers(ix.chains, ix.names).select("module", F.explode("classes").alias("class"))


@query(f"{_ROWS} SELECT path, 4 AS line, 5 AS col, 'place' AS target, 'new' AS shape, 'Nation' || m AS value FROM sup")
def program_assignments(ix):
    return ix.placed_facts("assigns").select("path", "line", "col", "target", "shape", "value")


@query(f"{_ROWS} SELECT path, 5 AS read_line, 4 AS write_line FROM sup UNION ALL SELECT path, 6, 2 FROM sup UNION ALL SELECT path, 7, 6 FROM reg UNION ALL SELECT path, 10, 9 FROM als")
def program_reaching_writes(ix):
    return ix.placed_facts("reaching").select("path", "read_line", "write_line")


@query(f"{_ROWS} SELECT 'Nation' || n AS fqn, path, 12 AS line FROM nat")
def program_implementations(ix):
    return positions.implementations(ix.chains, ix.methods, "Place", "describe").select("fqn", "path", "line")


@query(f"{_ROWS} SELECT 'rate' AS name, 0 AS depth, 'Supplier1' AS owner FROM sup WHERE s = 1 UNION ALL SELECT 'region_key', 2, 'Region' || r FROM sup WHERE s = 1")
def program_completion(ix):
    return P.complete(ix.chains, ix.methods, "Supplier1", "instance", "r").select("name", "depth", "owner")


@query(f"{_ROWS} SELECT 'Region' || r AS name, 'module' AS kind, path, 1 AS line FROM reg UNION ALL SELECT 'region_key', 'method', path, 2 FROM reg")
def program_workspace_symbols(ix):
    return positions.workspace_symbols(ix.placed_facts("defs"), "region").select("name", "kind", "path", "line")


@query(f"{_ROWS} SELECT path, 0 AS parse_errors FROM sup UNION ALL SELECT path, 0 FROM nat UNION ALL SELECT path, 0 FROM reg UNION ALL SELECT path, 0 FROM als UNION ALL SELECT path, 0 FROM place")
def program_blobs(ix):
    return ix.wide.join(ix.files, "oid").select("path", "parse_errors")


@query(f"{_ROWS} SELECT 'Alias' || n || rest AS fqn, 'Nation' || n AS namespace FROM als, (SELECT unnest(['::Home', '::Away']) AS rest)")
def program_aliases(ix):
    return ix.aliases.where("fqn <> namespace").select("fqn", "namespace")


@query(
    f"""{_ROWS},
candidate AS (SELECT *, row_number() OVER (ORDER BY owner) AS place FROM (SELECT 'Nation' || n AS owner, path AS def_path, 12 AS def_line FROM nat UNION ALL SELECT 'Place', path, 6 FROM place))
SELECT als.path, owner, def_path, def_line FROM als, candidate WHERE place <= {P.MOST_CANDIDATES}"""
)
def program_residue(ix):
    """Candidates of the calls that nothing types: a top-k report for each call."""
    asked = ix.calls.where("name = 'describe'").join(ix.receivers.select("call_id"), "call_id", "left_anti").withColumn("typed", F.lit(False))
    found = P.residue(asked, ix.methods, ix.chains).select("call_id", "owner", F.col("path").alias("def_path"), F.col("line").alias("def_line"))
    return found.join(ix.calls.select("call_id", "path"), "call_id").select("path", "owner", "def_path", "def_line")
