"""Schema dumps: the tables, columns, keys and indexes that an app's database has."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carnelian.extract import macros
from carnelian.extract.facts import literal_names
from carnelian.extract.ruby import Node, parse
from carnelian.functions.scalars import COLUMN_CLASSES
from carnelian.sources.rows import read_rows

TABLES = (
    "name string, line int, primary_key array<string>,"
    " columns array<struct<name: string, sql_type: string, class: string, nullable: boolean, line: int>>,"
    " indexes array<struct<columns: array<string>, unique: boolean>>"
)

#: SQL spellings and the type that a schema dump would give them.
SQL_TYPES = (
    (r"(character varying|varchar|char|character)\b", "string"), (r"(text|longtext|mediumtext|tinytext)\b", "text"), (r"tinyint\(1\)", "boolean"),
    (r"(bigint|bigserial)\b", "bigint"), (r"(integer|int|smallint|mediumint|tinyint|serial)\b", "integer"), (r"(double precision|float|real|double)\b", "float"),
    (r"(numeric|decimal)\b", "decimal"), (r"money\b", "money"), (r"timestamp.*with time zone|timestamptz", "timestamptz"), (r"(timestamp|datetime)\b", "datetime"), (r"date\b", "date"),
    (r"time\b", "time"), (r"jsonb\b", "jsonb"), (r"json\b", "json"), (r"(public\.)?hstore\b", "hstore"), (r"boolean\b", "boolean"), (r"uuid\b", "uuid"), (r"inet\b", "inet"), (r"cidr\b", "cidr"),
    (r"(public\.)?citext\b", "citext"), (r"(bytea|blob|longblob|binary|varbinary)\b", "binary"),
)


def class_of(sql_type: str, array: bool = False) -> str | None:
    return "Array" if array else COLUMN_CLASSES.get(sql_type)


def _option(args: list[Node], name: str) -> Node | None:
    for a in args:
        if a.kind == "hash":
            for p in a.pairs or []:
                if p.kind == "pair" and p.key.kind in ("sym", "str") and (p.key.name or "".join(p.key.parts or [])) == name:
                    return p.value
    return None


def ruby_tables(source: bytes) -> list[dict]:
    """create_table and add_index of a schema.rb."""
    tree, parser = parse(source)
    tables: dict[str, dict] = {}

    def add_index(table: dict | None, args: list[Node]) -> None:
        names = literal_names(args[:1])
        unique = _option(args, "unique")
        if table is not None and names:
            table["indexes"].append({"columns": names, "unique": unique is not None and unique.kind == "true"})

    def walk(node: Node) -> None:
        if node.kind == "call" and node.name == "create_table" and literal_names((node.args or [])[:1]):
            name = literal_names(node.args[:1])[0]
            key = _option(node.args, "primary_key")
            ident = _option(node.args, "id")
            own = {"name": name, "line": parser.pos(node.start)[0], "primary_key": literal_names([key]) if key is not None else [] if ident is not None and ident.kind == "false" else ["id"], "columns": [], "indexes": []}
            if own["primary_key"] == ["id"]:
                kind = (literal_names([ident]) or ["bigint"])[0] if ident is not None else "bigint"
                own["columns"].append({"name": "id", "sql_type": kind, "class": class_of(kind), "nullable": False, "line": own["line"]})
            tables[name] = own
            for statement in (node.block.body.body if node.block is not None and node.block.body.body else []):
                if statement.kind != "call" or statement.recv is None or statement.recv.kind != "lvar":
                    continue
                line = parser.pos(statement.start)[0]
                if statement.name == "index":
                    add_index(own, statement.args)
                elif statement.name == "timestamps":
                    own["columns"] += [{"name": n, "sql_type": "datetime", "class": "Time", "nullable": False, "line": line} for n in ("created_at", "updated_at")]
                elif statement.name in ("references", "belongs_to"):
                    own["columns"] += [{"name": f"{n}_id", "sql_type": "bigint", "class": "Integer", "nullable": True, "line": line} for n in literal_names(statement.args[:1]) or []]
                else:
                    kind = statement.name
                    names = [a for a in statement.args or [] if a.kind in ("str", "sym")]
                    if kind == "column":
                        kind, names = (literal_names(names[1:2]) or [""])[0], names[:1]
                    null, array = _option(statement.args, "null"), _option(statement.args, "array")
                    for n in literal_names(names) or []:
                        own["columns"].append({"name": n, "sql_type": kind, "class": class_of(kind, array is not None and array.kind == "true"), "nullable": null is None or null.kind != "false", "line": line})
        elif node.kind == "call" and node.name == "add_index" and literal_names((node.args or [])[:1]):
            add_index(tables.get(literal_names(node.args[:1])[0]), node.args[1:])
        for child in node.children():
            walk(child)

    walk(tree)
    return list(tables.values())


_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|[A-Za-z_][\w$]*|\d[\w.]*|[^\s]", re.S)


def _bare(name: str) -> str:
    return name.strip('"`').split(".")[-1].strip('"`')


def sql_type(written: str) -> tuple[str, bool]:
    """(type, whether an array) of a column's type as a dump writes it."""
    low = written.lower().strip()
    array = low.endswith("[]") or " array" in low
    for pattern, kind in SQL_TYPES:
        if re.match(pattern, low):
            return kind, array
    return low.split("(")[0].strip(), array


def sql_tables(source: bytes) -> list[dict]:
    """CREATE TABLE and INDEX, and primary keys, of pg_dump or mysqldump output; nothing of it is run."""
    text = source.decode("utf-8", "replace")
    tokens = [(m.group(), text.count("\n", 0, m.start()) + 1 if m.group().upper() == "CREATE" else 0, m.start()) for m in _TOKEN.finditer(text) if not m.group().startswith(("--", "/*"))]
    tables: dict[str, dict] = {}
    i = 0
    upper = [t.upper() for t, _, _ in tokens]

    def parens(at: int) -> int:
        depth = 0
        while at < len(tokens):
            depth += (tokens[at][0] == "(") - (tokens[at][0] == ")")
            at += 1
            if not depth:
                return at
        return at

    def name_at(at: int) -> tuple[str, int]:
        out = tokens[at][0]
        while at + 2 < len(tokens) and tokens[at + 1][0] == ".":
            at += 2
            out = tokens[at][0]
        return _bare(out), at + 1

    def names_in(at: int) -> tuple[list[str], int]:
        end = parens(at)
        parts, depth, found = [], 0, []
        for t, _, _ in tokens[at + 1 : end - 1]:
            depth += (t == "(") - (t == ")")
            if t == "," and not depth:
                found.append(parts)
                parts = []
            else:
                parts.append(t)
        found.append(parts)
        return [_bare(p[0]) for p in found if p], end

    def split_columns(begin: int, end: int):
        item, depth = [], 0
        for t in tokens[begin:end]:
            depth += (t[0] == "(") - (t[0] == ")")
            if t[0] == "," and not depth:
                yield item
                item = []
            else:
                item.append(t)
        if item:
            yield item

    while i < len(tokens):
        if upper[i] == "CREATE" and "TABLE" in upper[i + 1 : i + 3]:
            line = tokens[i][1]
            at = upper.index("TABLE", i) + 1
            if upper[at : at + 3] == ["IF", "NOT", "EXISTS"]:
                at += 3
            name, at = name_at(at)
            if at < len(tokens) and tokens[at][0] == "(":
                end = parens(at)
                own = {"name": name, "line": line, "primary_key": [], "columns": [], "indexes": []}
                for item in split_columns(at + 1, end - 1):
                    words = [t for t, _, _ in item]
                    up = [w.upper() for w in words]
                    if up[0] in ("CONSTRAINT", "PRIMARY", "UNIQUE", "KEY", "INDEX", "FOREIGN", "CHECK", "EXCLUDE", "FULLTEXT", "SPATIAL", "LIKE"):
                        inside = [w for w in words[words.index("(") + 1 :] if re.match(r"[\"`A-Za-z_]", w)] if "(" in words else []
                        if "PRIMARY" in up:
                            own["primary_key"] = [_bare(w) for w in inside]
                        elif up[0] in ("UNIQUE", "KEY", "INDEX"):
                            own["indexes"].append({"columns": [_bare(w) for w in inside], "unique": up[0] == "UNIQUE"})
                        continue
                    if len(words) < 2:
                        continue
                    stops = [k for k, w in enumerate(up) if w in ("NOT", "NULL", "DEFAULT", "PRIMARY", "COLLATE", "GENERATED", "REFERENCES", "UNIQUE", "CHECK", "COMMENT", "AUTO_INCREMENT", "CONSTRAINT") and k > 0]
                    written = " ".join(words[1 : min(stops, default=len(words))]).replace(" (", "(").replace("( ", "(").replace(" )", ")").replace(" [", "[").replace("[ ]", "[]")
                    kind, array = sql_type(written)
                    if "PRIMARY" in up:
                        own["primary_key"] = [_bare(words[0])]
                    own["columns"].append({"name": _bare(words[0]), "sql_type": kind, "class": class_of(kind, array), "nullable": not any(up[k : k + 2] == ["NOT", "NULL"] for k in range(len(up))), "line": text.count("\n", 0, item[0][2]) + 1})
                tables[name] = own
                i = end
                continue
        if upper[i] == "CREATE" and "INDEX" in upper[i + 1 : i + 3] and "ON" in upper[i : i + 12]:
            unique = upper[i + 1] == "UNIQUE"
            at = upper.index("ON", i) + 1
            if upper[at] == "ONLY":
                at += 1
            name, at = name_at(at)
            if at < len(tokens) and upper[at] == "USING":
                at += 2
            if name in tables and at < len(tokens) and tokens[at][0] == "(":
                columns, at = names_in(at)
                tables[name]["indexes"].append({"columns": columns, "unique": unique})
            i = at
            continue
        if upper[i] == "ALTER" and i + 1 < len(tokens) and upper[i + 1] == "TABLE":
            at = i + 2
            if upper[at] == "ONLY":
                at += 1
            name, at = name_at(at)
            stop = next((k for k in range(at, len(tokens)) if tokens[k][0] == ";"), len(tokens))
            if name in tables and "PRIMARY" in upper[at:stop]:
                place = upper.index("PRIMARY", at) + 2
                if place < stop and tokens[place][0] == "(":
                    tables[name]["primary_key"] = names_in(place)[0]
            i = stop
            continue
        i += 1
    return list(tables.values())


def tables(files: DataFrame) -> DataFrame:
    """Tables of the dumps among files (checkout, path, content)."""
    ruby = read_rows(files.where(F.col("path").rlike(r"(^|/)schema\.rb$")), TABLES, ruby_tables)
    return ruby.unionByName(read_rows(files.where(F.col("path").rlike(r"(^|/)structure\.sql$")), TABLES, sql_tables))


#: Methods that a column gives its model.
COLUMN_METHODS = ("{}", "{}=", "{}?", *macros.DIRTY)


def attribute_methods(tables_: DataFrame) -> DataFrame:
    """checkout, owner, name, returns: what columns give the class of their table."""
    from carnelian.functions.scalars import camelize, singular

    owner = camelize(singular(F.col("name")))
    rows = tables_.select("checkout", "path", owner.alias("owner"), F.explode("columns").alias("c"))
    made = F.explode(F.array(*[F.replace(F.lit(t), F.lit("{}"), F.col("c.name")) for t in COLUMN_METHODS]))
    each = rows.select("checkout", "path", "owner", "c", made.alias("name"))
    return each.select("checkout", "path", "owner", "name", F.when(F.col("name") == F.col("c.name"), F.col("c.class")).alias("returns"), F.col("c.line").alias("line"))


def model_tables(classes: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    """checkout, fqn, table: the table that a model's name stands for, unless it says another (column table_name)."""
    from carnelian.functions.scalars import plural, underscore

    last = F.element_at(F.split("fqn", "::"), -1)
    named = F.concat(F.lit(prefix), plural(underscore(last)), F.lit(suffix))
    return classes.select("checkout", "fqn", F.coalesce("table_name", named).alias("table"))
