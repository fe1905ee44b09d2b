"""Secret scan by corpus-wide ownership frequency, with DataFrame functions only.

Candidates are the matches of four patterns.  Splitting a text at a pattern and
extracting its matches gives the stretches between matches and the matches in
turn; the running sum of their lengths is where each match stands, in code
points.  The hash of every candidate value is counted over distinct
repositories and owners of the whole corpus: a value that more than MOST_OWNERS
owners or MOST_REPOSITORIES repositories hold is a widely copied example, any
other is specific to its owner and looks live.  In a table of documents the
owner is the source, and a repository is what one source has in one language,
so that a value which a single owner copies through its repositories is an
example as well.  Base kinds are reported in any
case, with the verdict beside them; the method adds spans of kind "key" (long
mixed tokens) where the value is specific to its owner.

Owners are counted in two steps: distinct (value, repository, owner) first, so
that a value which a third of all rows hold is a row for each of its owners
after the partial step.  The join back to documents is on the value, of
owner-specific values only, and is left to the engine's splitting of skewed
partitions.  What runs over the matches of a text goes block by block, each of
the square root of their number, since adding to an array copies it.

Defined cases: a null or empty text has no spans; a null owner or repository
counts as one owner or repository of its own; rows repeated in the input come
out repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carnelian.llm.frames import documents, fresh, stored

_WORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The kinds in order, their patterns, the group that is the value, and its least length.
KINDS = (
    ("assign", rf"""({"|".join(map(_either_case, _WORDS))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
#: The method's own kind: long tokens with digits and letters of either case.
KEY = ("key", "[A-Za-z0-9+/_-]{24,}", 0, 24)
KEY_SHAPE = ("[0-9].*[0-9].*[0-9]", "[a-z]", "[A-Z]")
MOST_OWNERS, MOST_REPOSITORIES = 1, 3
MASK = "[SECRET]"

_SPAN = "struct<start: int, kind: int, stop: int, value: bigint>"


def _none(kind: str = _SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, carry: Column, step, kind: str) -> Column:
    """All that step(carry, item) makes, in order; it gives struct(carry, made: array<kind>)."""
    both = lambda c, out: F.struct(c.alias("carry"), out.alias("out"))
    one = lambda done, x: _let(step(done["carry"], x), lambda r: both(r["carry"], F.concat(done["out"], r["made"])))
    block_of = lambda done, block: _let(F.aggregate(block, both(done["carry"], _none(kind)), one), lambda r: both(r["carry"], F.array_append(done["out"], r["out"])))

    def run(listed: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(listed))).cast("int"))
        firsts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(listed)), width)
        blocks = F.transform(firsts, lambda first: F.slice(listed, first, width))
        return F.flatten(F.aggregate(blocks, both(carry, _none(f"array<{kind}>")), block_of)["out"])

    return _let(items, run)


def _made(carry: Column, good: Column, item: Column, kind: str) -> Column:
    return F.struct(carry.alias("carry"), F.when(good, F.array(item)).otherwise(_none(kind)).alias("made"))


def spans(text: Column, kind: int, pattern: str, group: int, least: int, shape: tuple = ()) -> Column:
    """array<start, kind, stop, value> of the leftmost matches that don't overlap, without those whose value is shorter than least or lacks a shape."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    # the stretch after the last match has nothing beside it, and makes nothing
    steps = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(found, F.length).alias("size"), values.alias("value"))

    def step(at: Column, x: Column) -> Column:
        begin = at + x["gap"]
        stop = begin + x["size"]
        here = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), F.xxhash64(x["value"]).alias("value"))
        good = reduce(Column.__and__, [x["value"].rlike(p) for p in shape], F.length(x["value"]) >= least)
        return _made(stop, good, here, _SPAN)

    return F.when(text.rlike(pattern), running(steps, F.lit(0), step, _SPAN)).otherwise(_none())


def beside(base: Column, keys: Column) -> Column:
    """The keys (by start, apart from one another) that overlap no base span (by start), and the base spans, by start.

    A key waits until the next span begins: a base span that begins before the key ends puts it out."""
    nothing = F.lit(None).cast(_SPAN)
    state = lambda stop, waits: F.struct(stop.alias("stop"), waits.alias("waits"))

    def step(done: Column, s: Column) -> Column:
        is_key, waits = s["kind"] == len(KINDS), done["waits"]
        kept = F.when(waits.isNotNull() & (waits["stop"] <= s["start"]), F.array(waits)).otherwise(_none())
        after_key = F.struct(state(done["stop"], F.when(done["stop"] <= s["start"], s).otherwise(nothing)).alias("carry"), kept.alias("made"))
        after_base = F.struct(state(F.greatest(done["stop"], s["stop"]), nothing).alias("carry"), F.concat(kept, F.array(s)).alias("made"))
        at_end = F.struct(done.alias("carry"), F.when(waits.isNotNull(), F.array(waits)).otherwise(_none()).alias("made"))
        return F.when(s["kind"] > len(KINDS), at_end).when(is_key, after_key).otherwise(after_base)

    end = F.array(F.struct(F.lit(2147483647).alias("start"), F.lit(len(KINDS) + 1).alias("kind"), F.lit(2147483647).alias("stop"), F.lit(0).cast("bigint").alias("value"))).cast(f"array<{_SPAN}>")
    # of spans that begin together a base one comes first
    every = F.array_sort(F.concat(base, keys, end))
    return F.when(F.size(keys) > 0, F.array_sort(running(every, state(F.lit(0), nothing), step, _SPAN))).otherwise(base)


def _owner(owner) -> Column:
    return owner if isinstance(owner, Column) else F.col(owner).cast("string")


def repository_of(*columns: str) -> Column:
    """One name for the values of several columns; nulls are values of their own."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))


def candidates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner="source", repository=None) -> DataFrame:
    """id, owner, repository, row, base spans by start and kind, key spans.

    owner, repository: a column or its name; a repository is by default what an owner has in one language."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = F.array_sort(F.concat(*[spans(text, k, pattern, group, least) for k, (_, pattern, group, least) in enumerate(KINDS)]))
    keys = spans(text, len(KINDS), *KEY[1:], KEY_SHAPE)
    repository = repository_of("source", "lang") if repository is None else repository
    return df.select(
        F.col(id_column).alias("id"),
        _owner(owner).alias("owner"),
        _owner(repository).alias("repository"),
        F.xxhash64(F.col(id_column), F.col(text_column)).alias("row"),
        base.alias("base"),
        F.when(_mixed(text), keys).otherwise(_none()).alias("keys"),
    )


def _mixed(text: Column) -> Column:
    """A token of a key's length with a digit in it; cheap beside the spans themselves."""
    return text.rlike("[A-Za-z+/_-]*[0-9][A-Za-z0-9+/_-]{12,}|[A-Za-z0-9+/_-]{12,}[0-9]")


def judged(found: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """found with live: its spans (of any kind, in the same shape) whose value is specific to an owner."""
    each = found.select("id", "row", "owner", "repository", F.explode(F.concat("base", "keys")).alias("span")).withColumn("value", F.col("span.value"))
    held = each.select("value", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repository", F.lit("\0")).alias("repository")).distinct()
    counted = held.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    specific = counted.where((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)).select("value")
    live = each.join(specific, "value").groupBy("id", "row").agg(F.array_sort(F.collect_set("span")).alias("live"))
    live = live.withColumnsRenamed({"id": "id_", "row": "row_"})
    out = found.join(live, F.col("id").eqNullSafe(F.col("id_")) & (F.col("row") == F.col("row_")), "left")
    return out.select("id", "row", "owner", "base", "keys", F.coalesce("live", _none()).alias("live"))


def _listed(column: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in (*KINDS, KEY)])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(column: Column, kind: int) -> Column:
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("bigint")


def find_secrets(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner="source", repository=None) -> DataFrame:
    """id, row, base spans, all spans, live spans, for every row of df."""
    found = stored(candidates(df, id_column, text_column, owner, repository))
    out = judged(found)
    keys = F.filter("live", lambda s: s["kind"] == len(KINDS))
    return out.select("id", "row", "base", beside(F.col("base"), keys).alias("spans"), "live")


def _masked(text: Column, found: Column, mask: str) -> Column:
    """text with the mask for the spans; of spans that overlap the first counts.

    To find a place in a text takes a walk from its start, so a block's stretch is cut out first."""
    shape = "struct<start: int, stop: int>"

    def step(at: Column, s: Column) -> Column:
        return _made(F.greatest(at, s["stop"]), s["start"] >= at, F.struct(s["start"].alias("start"), s["stop"].alias("stop")), shape)

    def cut(cuts: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(cuts))).cast("int"))
        stop_of = lambda k: F.when(k > 0, F.element_at(cuts, F.greatest(k, F.lit(1)))["stop"]).otherwise(F.lit(0))
        stretch = lambda a, b: F.substring(text, a + 1, b - a)

        def block(first: Column) -> Column:
            start, last = stop_of(first), F.least(first + width, F.size(cuts))
            pieces = lambda here: F.transform(F.sequence(first + 1, last), lambda k: F.concat(F.substring(here, stop_of(k - 1) - start + 1, F.element_at(cuts, k)["start"] - stop_of(k - 1)), F.lit(mask)))
            return F.array_join(_let(stretch(start, stop_of(last)), pieces), "")

        firsts = F.sequence(F.lit(0), F.size(cuts) - 1, width)
        return F.concat(F.array_join(F.transform(firsts, block), ""), stretch(stop_of(F.size(cuts)), F.length(text)))

    return _let(running(found, F.lit(0), step, shape), cut)


def mask_secrets(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner="source", repository=None, mask: str = MASK) -> DataFrame:
    """df with MASK for every owner-specific span of its texts; examples stay.  No row goes, columns stay as they are."""
    id_, row, live = fresh(df, "_id", "_row", "_live")
    found = find_secrets(df, id_column, text_column, owner, repository)
    marks = found.where(F.size("live") > 0).select(F.col("id").alias(id_), F.col("row").alias(row), F.col("live").alias(live)).distinct()
    own = F.xxhash64(df[id_column], df[text_column])
    both = df.join(marks, own.eqNullSafe(F.col(row)) & df[id_column].eqNullSafe(F.col(id_)), "left")
    text = df[text_column]

    masked = F.when(F.col(live).isNotNull(), _masked(text, F.col(live), mask)).otherwise(text)
    return both.select(*[masked.alias(c) if c == text_column else df[c] for c in df.columns])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    counts = [_count(F.col("base"), k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("live").cast("bigint").alias("n_live"))


QUERIES = {"op6_secret_scan": op6_secret_scan}


def _oracle() -> str:
    """The same by string functions: where a match stands is what is before it, piece by piece."""
    quoted = lambda p: p.replace("'", "''")

    def kind(number: int, pattern: str, group: int, least: int, shape: tuple = ()) -> str:
        shaped = "".join(f" AND regexp_matches(value, '{p}')" for p in shape)
        return f"""SELECT doc_id, source, lang, {number} AS kind, CAST(len(array_to_string(gap[1:i], '')) + len(array_to_string(found[1:i - 1], '')) AS INTEGER) AS start, value, found[i] AS matched
  FROM (SELECT doc_id, source, lang, i, gap, found, regexp_extract_all(t, '{quoted(pattern)}', {group})[i] AS value FROM (SELECT doc_id, source, lang, t, string_split_regex(t, '{quoted(pattern)}') AS gap, regexp_extract_all(t, '{quoted(pattern)}') AS found FROM text), unnest(range(1, len(found) + 1)) AS u(i)) WHERE len(value) >= {least}{shaped}"""

    base = " UNION ALL ".join(kind(k, p, g, n) for k, (_, p, g, n) in enumerate(KINDS))
    names = ", ".join(f"'{k[0]}'" for k in (*KINDS, KEY))
    return f"""
WITH text AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
base AS (SELECT *, start + len(matched) AS stop FROM ({base})),
keys AS (SELECT *, start + len(matched) AS stop FROM ({kind(len(KINDS), KEY[1], KEY[2], KEY[3], KEY_SHAPE)})),
every AS (SELECT * FROM base UNION ALL SELECT * FROM keys),
own AS (SELECT value FROM every GROUP BY value HAVING count(DISTINCT coalesce(source, chr(1))) <= {MOST_OWNERS} AND count(DISTINCT coalesce(source, chr(1)) || chr(2) || coalesce(lang, chr(1))) <= {MOST_REPOSITORIES}),
live AS (SELECT DISTINCT doc_id, kind, start, stop FROM every WHERE value IN (SELECT value FROM own)),
shown AS (SELECT doc_id, kind, start, stop FROM base UNION ALL SELECT doc_id, kind, start, stop FROM live l WHERE kind = {len(KINDS)} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = l.doc_id AND l.start < b.stop AND b.start < l.stop)),
listed AS (SELECT doc_id, [{names}][kind + 1] || ':' || start || ':' || stop AS s, start, kind FROM shown),
counted AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex FROM base GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce((SELECT string_agg(s, ',' ORDER BY start, kind) FROM listed l WHERE l.doc_id = t.doc_id AND kind < {len(KINDS)}), '')) AS base_sha256,
  coalesce((SELECT string_agg(s, ',' ORDER BY start, kind) FROM listed l WHERE l.doc_id = t.doc_id), '') AS spans,
  (SELECT count(*) FROM live l WHERE l.doc_id = t.doc_id) AS n_live
FROM text t LEFT JOIN counted c ON c.doc_id = t.doc_id
"""


ORACLES = {"op6_secret_scan": _oracle()}
