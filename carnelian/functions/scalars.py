"""Scalar functions as column expressions: they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def git_oid(content: Column) -> Column:
    """Git's hash of a blob: SHA-1 over "blob <length>", a zero byte and the bytes."""
    content = content.cast("binary")
    head = F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.lit(b"\0"), content))


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def qualify(scope: Column, name: Column) -> Column:
    """scope::name; the top level and Object are the same scope."""
    return F.when((scope == "") | (scope == "Object") | scope.isNull(), name).otherwise(F.concat(scope, F.lit("::"), name))


def whole_name(name: Column) -> Column:
    """A leading :: or Object:: is no part of a full name."""
    return F.regexp_replace(name, r"^(?:::)?(?:Object::)?", "")


def prefixes(name: Column) -> Column:
    """Every enclosing namespace of a full name, outermost first, without the name itself."""
    parts = F.split(name, "::")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "::"))
    )


def spellings(name: Column) -> Column:
    """Ways to write a full name from some scope: its suffixes, shortest first."""
    parts = F.split(name, "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "::"))


def scopes(nesting: Column) -> Column:
    """Full names of the scopes of a written nesting (innermost first), innermost first."""
    outer = F.reverse(nesting)
    built = F.aggregate(
        outer,
        F.array().cast("array<string>"),
        lambda done, name: F.concat(F.array(F.when(F.size(done) == 0, whole_name(name)).otherwise(F.when(name.startswith("::"), whole_name(name)).otherwise(F.concat(F.element_at(done, 1), F.lit("::"), name)))), done),
    )
    return built


def camelize(name: Column) -> Column:
    """some/long_name to Some::LongName."""
    return F.array_join(F.transform(F.split(name, "/"), lambda part: F.array_join(F.transform(F.split(part, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")), "::")


def underscore(name: Column) -> Column:
    """Some::LongName to some/long_name."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "::", "/"), r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z\d])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(spaced, "-", "_"))


#: English inflection, the later rule first; what matches first is applied.
PLURALS = (
    (r"(quiz)$", "$1zes"), (r"^(oxen)$", "$1"), (r"^(ox)$", "$1en"), (r"^(m|l)ice$", "$1ice"), (r"^(m|l)ouse$", "$1ice"),
    (r"(matr|vert|ind)(?:ix|ex)$", "$1ices"), (r"(x|ch|ss|sh)$", "$1es"), (r"([^aeiouy]|qu)y$", "$1ies"), (r"(hive)$", "$1s"),
    (r"(?:([^f])fe|([lr])f)$", "$1$2ves"), (r"sis$", "ses"), (r"([ti])a$", "$1a"), (r"([ti])um$", "$1a"),
    (r"(buffal|tomat)o$", "$1oes"), (r"(bu)s$", "$1ses"), (r"(alias|status)$", "$1es"), (r"(octop|vir)i$", "$1i"),
    (r"(octop|vir)us$", "$1i"), (r"^(ax|test)is$", "$1es"), (r"s$", "s"), (r"$", "s"),
)
SINGULARS = (
    (r"(database)s$", "$1"), (r"(quiz)zes$", "$1"), (r"(matr)ices$", "$1ix"), (r"(vert|ind)ices$", "$1ex"), (r"^(ox)en", "$1"),
    (r"(alias|status)(es)?$", "$1"), (r"(octop|vir)(us|i)$", "$1us"), (r"^(a)x[ie]s$", "$1xis"), (r"(cris|test)(is|es)$", "$1is"),
    (r"(shoe)s$", "$1"), (r"(o)es$", "$1"), (r"(bus)(es)?$", "$1"), (r"^(m|l)ice$", "$1ouse"), (r"(x|ch|ss|sh)es$", "$1"),
    (r"(m)ovies$", "$1ovie"), (r"(s)eries$", "$1eries"), (r"([^aeiouy]|qu)ies$", "$1y"), (r"([lr])ves$", "$1f"), (r"(tive)s$", "$1"),
    (r"(hive)s$", "$1"), (r"([^f])ves$", "$1fe"), (r"(^analy)(sis|ses)$", "$1sis"),
    (r"((a)naly|(b)a|(d)iagno|(p)arenthe|(p)rogno|(s)ynop|(t)he)(sis|ses)$", "$1sis"), (r"([ti])a$", "$1um"), (r"(n)ews$", "$1ews"),
    (r"(ss)$", "$1"), (r"s$", ""),
)
IRREGULAR = (("person", "people"), ("man", "men"), ("child", "children"), ("sex", "sexes"), ("move", "moves"), ("zombie", "zombies"))
UNCOUNTABLE = ("equipment", "information", "rice", "money", "species", "series", "fish", "sheep", "jeans", "police")


def _inflect(word: Column, rules, irregular) -> Column:
    out = word
    choices = [(f"(?:^|_|\\b){w}$", lambda c, w=w: c) for w in UNCOUNTABLE]
    choices += [(f"{a}$", lambda c, a=a, b=b: F.regexp_replace(c, f"{a}$", b)) for a, b in irregular]
    choices += [(p, lambda c, p=p, r=r: F.regexp_replace(c, p, r)) for p, r in rules]
    chosen = None
    for pattern, change in choices:
        chosen = F.when(word.rlike(pattern), change(word)) if chosen is None else chosen.when(word.rlike(pattern), change(word))
    return F.when(word == "", word).otherwise(chosen.otherwise(out))


def plural(word: Column) -> Column:
    return _inflect(word, PLURALS, [(b, b) for _, b in IRREGULAR] + list(IRREGULAR))


def singular(word: Column) -> Column:
    return _inflect(word, SINGULARS, [(b, a) for a, b in IRREGULAR] + [(a, a) for a, _ in IRREGULAR])


def share(agreeing: Column, total: Column) -> Column:
    """Confidence: agreeing of total to two places, 0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(agreeing / total, 2))


def accepts(params: Column, argc: Column) -> Column:
    """Whether a call with argc arguments fits; an unknown count always does."""
    count = lambda *kinds: F.size(F.filter(params, lambda p: p["kind"].isin(*kinds)))
    required = count("req", "post")
    variadic = count("opt", "rest", "keyrest", "block") > 0
    keywords = count("key", "keyreq") > 0
    return argc.isNull() | params.isNull() | ((argc >= required) & (variadic | (argc == required) | (keywords & (argc == required + 1))))


def shape_matches(shape: Column, name: Column) -> Column:
    """A shape's stars stand for any characters, one at least each."""
    pattern = F.concat(F.lit("^"), F.replace(F.concat(F.lit("\\Q"), F.replace(shape, F.lit("*"), F.lit("\\E.+\\Q")), F.lit("\\E")), F.lit("\\Q\\E"), F.lit("")), F.lit("$"))
    return F.call_function("rlike", name, pattern)


def under(root: Column, path: Column) -> Column:
    return path.startswith(F.concat(root, F.lit("/"))) | (path == root)


def shared_dirs(a: Column, b: Column) -> Column:
    """Leading directories that two paths share."""
    left, right = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(left), F.size(right)) - 1
    same = F.zip_with(F.slice(left, 1, F.greatest(n, F.lit(0))), F.slice(right, 1, F.greatest(n, F.lit(0))), lambda x, y: x == y)
    first_off = F.array_position(same, False)
    return F.when(first_off > 0, first_off - 1).otherwise(F.size(same)).cast("int")


def in_tests(path: Column) -> Column:
    """A directory spec, test or tests before any lib or app."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    place = lambda *ws: reduce(F.least, [F.when(F.array_position(dirs, w) > 0, F.array_position(dirs, w)).otherwise(F.lit(1 << 30)) for w in ws])
    return place("spec", "test", "tests") < place("lib", "app")


def version_key(version: Column) -> Column:
    """Comparable array of a version's segments: numbers above words, so that a prerelease is lower."""
    parts = F.filter(F.split(F.regexp_replace(version, r"([0-9])([a-zA-Z])", "$1.$2"), r"[.\-]"), lambda p: p != "")
    number = lambda p: F.when(p.rlike("^[0-9]+$"), F.struct(F.lit(1).alias("n"), p.cast("bigint").alias("v"), F.lit("").alias("w"))).otherwise(F.struct(F.lit(-1).alias("n"), F.lit(0).cast("bigint").alias("v"), p.alias("w")))
    end = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("v"), F.lit("").alias("w"))
    return F.concat(F.transform(parts, number), F.array(end))


def satisfies(version: Column, operator: str, wanted: str) -> Column:
    """A gem requirement: = != > < >= <= or ~>."""
    have, want = version_key(version), version_key(F.lit(wanted))
    if operator == "~>":
        parts = wanted.split(".")
        upper = ".".join([*parts[:-2], str(int(parts[-2]) + 1)]) if len(parts) > 1 else str(int(parts[0]) + 1)
        return (have >= want) & (have < version_key(F.lit(upper)))
    return {"=": have == want, "!=": have != want, ">": have > want, "<": have < want, ">=": have >= want, "<=": have <= want}[operator]


#: Column types of a schema dump and the class that their values have.
COLUMN_CLASSES = {
    "string": "String", "text": "String", "citext": "String", "binary": "String", "uuid": "String", "inet": "String", "cidr": "String",
    "integer": "Integer", "bigint": "Integer", "serial": "Integer", "bigserial": "Integer", "primary_key": "Integer", "float": "Float",
    "decimal": "BigDecimal", "numeric": "BigDecimal", "money": "BigDecimal", "datetime": "Time", "timestamp": "Time", "timestamptz": "Time",
    "time": "Time", "date": "Date", "json": "Hash", "jsonb": "Hash", "hstore": "Hash",
}


def column_class(sql_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in COLUMN_CLASSES.items() for x in pair])
    return F.try_element_at(table, sql_type)


def utf16_column(line: Column, column: Column) -> Column:
    """The UTF-16 column, from 0, of a place given as a byte of its line, from 1: how editors count."""
    before = F.substring(line.cast("binary"), F.lit(1), column - 1).cast("string")
    return (F.octet_length(F.encode(before, "UTF-16LE")) / 2).cast("int")


def byte_column(line: Column, utf16: Column) -> Column:
    """The byte, from 1, at which the character of a UTF-16 column, from 0, begins; the line's end for what is beyond it."""
    units = F.transform(F.split(line, ""), lambda c: F.struct((F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int").alias("u"), F.octet_length(c).alias("b")))
    start = F.struct(F.lit(0).alias("u"), F.lit(1).alias("b"))
    step = lambda at, c: F.when(at["u"] + c["u"] <= utf16, F.struct((at["u"] + c["u"]).alias("u"), (at["b"] + c["b"]).alias("b"))).otherwise(F.struct(F.lit(1 << 30).alias("u"), at["b"].alias("b")))
    return F.aggregate(units, start, step, lambda at: at["b"])


def latency_bucket(milliseconds: Column) -> Column:
    """Decades of latency."""
    return F.when(milliseconds < 1, "<1ms").when(milliseconds < 10, "<10ms").when(milliseconds < 100, "<100ms").when(milliseconds < 1000, "<1s").when(milliseconds < 10000, "<10s").otherwise(">=10s")
