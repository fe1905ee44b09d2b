"""Schemas of the fact tables; every operator takes and returns these columns.

A blob's facts are a function of its bytes, so fact tables are keyed by oid and
only files() names a path.
"""

from __future__ import annotations

POS = "struct<line: int, col: int>"

BLOBS = "oid string, content binary, lines int, parse_errors int, surface bigint, namespace bigint"
FILES = "checkout string, path string, oid string"
CHECKOUTS = "root string, kind string, indexed_at bigint, layer int"
GEM_USE = "checkout string, gem_root string, name string"
DEFS = (
    "oid string, name string, kind string, nesting array<string>, singleton boolean, visibility string,"
    " params array<struct<kind: string, name: string>>, via string, target string,"
    " sig_returns string, line int, col int, end_line int"
)
ANCESTRY = "oid string, owner array<string>, relation string, target string, line int, col int"
CONST_REFS = "oid string, name string, nesting array<string>, line int, col int"
CALLS = (
    "oid string, name string, recv string, recv_text string, nesting array<string>, singleton boolean,"
    " argc int, block boolean, symbol boolean, recv_line int, recv_col int, line int, col int"
)
ASSIGNS = "oid string, target string, shape string, value string, nesting array<string>, singleton boolean, line int, col int"
CALL_NAME = "oid string, name string, calls bigint, symbols bigint"
BODY_CALL = "oid string, name string, nesting array<string>, args array<string>, line int"
REACHING = "oid string, read_line int, read_col int, write_line int, write_col int"

#: Version of the facts: raise it with any change of a schema or of extraction.
VERSION = 1

#: Layers of a load order: what is read later wins.
LAYERS = {"core": 0, "stdlib": 1, "gem": 2, "repo": 3}


def names(schema: str) -> list[str]:
    """Column names of a schema given as text."""
    depth, out, word = 0, [], ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out
