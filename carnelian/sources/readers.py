"""Which files are read, by what reader, and how a template becomes Ruby."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is indexed besides .rb.
EXTENSIONS = ("rb", "rake", "gemspec", "ru", "jbuilder", "rbi")
BARE_NAMES = ("Rakefile", "Gemfile", "Guardfile", "Capfile", "Thorfile", "Vagrantfile")
TEMPLATES = {"erb": "erb", "haml": "haml", "rabl": "rabl"}
MOST_BYTES = 64 * 1024 * 1024
#: git's modes of regular files.
REGULAR = ("100644", "100755")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def reader_of(path: Column) -> Column:
    """ruby, erb, haml, rabl, structure_sql, or null for a path that isn't read."""
    name = base_name(path)
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(extension.isin(*EXTENSIONS) | name.isin(*BARE_NAMES), "ruby").when(name == "structure.sql", "structure_sql")
    for ending, reader in TEMPLATES.items():
        out = out.when(extension == ending, reader)
    return out


def is_indexed(path: Column) -> Column:
    return reader_of(path).isNotNull()


def erb_to_ruby(source: bytes) -> bytes:
    """Only what stands in tags, at its place; the rest is blanks and line ends."""
    out = bytearray(re.sub(rb"[^\n]", b" ", source))
    for m in re.finditer(rb"<%(?!%)([=-]|#)?(.*?)(-?%>)", source, re.S):
        if m.group(1) == b"#":
            continue
        begin, end = m.span(2)
        out[begin:end] = source[begin:end]
        if end < len(out) and not source[begin:end].rstrip().endswith((b"do", b"|")):
            out[end : end + 1] = b";"
    return bytes(out)


def haml_to_ruby(source: bytes) -> bytes:
    """Script lines (- and =, also behind a tag) at their place; do becomes a brace that the next lesser indent closes."""
    out: list[bytes] = []
    open_: list[tuple[int, bytes]] = []
    for line in source.split(b"\n"):
        indent = len(line) - len(line.lstrip(b" "))
        closers = b""
        stripped = line.strip()
        while open_ and stripped and indent <= open_[-1][0]:
            level, closer = open_.pop()
            if not (closer == b"end" and level == indent and re.match(rb"-\s*(else|elsif|when|rescue|ensure)\b", stripped)):
                closers += closer + b";"
            else:
                open_.append((level, closer))
                break
        m = re.match(rb"^( *(?:[%.#][\w.#:-]*(?:\{[^\n]*?\}|\([^\n]*?\))?)?[-=!&~]=? ?)(.*)$", line) if not stripped.startswith((b"-#", b"/", b":")) else None
        if not m or re.match(rb"^ *[%.#][\w.#:-]*(?:\{[^\n]*?\}|\([^\n]*?\))?$", line):
            out.append(closers + b" " * max(0, len(line) - len(closers)))
            continue
        code = m.group(2)
        if re.search(rb"\bdo\b(\s*\|[^|]*\|)?\s*$", code):
            open_.append((indent, b"end"))
        elif re.match(rb"(if|unless|while|until|case|for|begin)\b", code):
            open_.append((indent, b"end"))
        out.append((closers or b"") + b" " * max(0, len(m.group(1)) - len(closers)) + code)
    return b"\n".join([*out, b"".join(c + b";" for _, c in reversed(open_))])


def to_ruby(content: bytes, reader: str | None) -> bytes:
    """What the extractor reads of a file."""
    if reader == "erb":
        return erb_to_ruby(content)
    if reader == "haml":
        return haml_to_ruby(content)
    return b"" if reader == "structure_sql" else content
