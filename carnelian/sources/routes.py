"""Rails routes: the controller actions that a routes file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carnelian.extract.facts import literal_names
from carnelian.extract.macros import camelize
from carnelian.extract.ruby import Node, parse
from carnelian.functions.scalars import in_tests
from carnelian.sources.rows import read_rows

ROUTES = "controller string, action string, line int, unread string"
#: The actions of a resource.
PLURAL = ("index", "create", "new", "edit", "show", "update", "destroy")
SINGULAR = ("create", "new", "edit", "show", "update", "destroy")
VERBS = ("get", "post", "put", "patch", "delete", "match", "root")


def _plural(word: str) -> str:
    return word if word.endswith("s") else word[:-1] + "ies" if word.endswith("y") and word[-2:-1] not in "aeiou" else word + "s"


class Reader:
    def __init__(self, source: bytes):
        self.tree, self.parser = parse(source)
        self.out: list[dict] = []

    def add(self, node: Node, modules: list[str], controller: str | None, action: str | None, unread: str | None = None) -> None:
        path = "/".join([*modules, controller]) if controller else None
        self.out.append({"controller": f"{camelize(path)}Controller" if path else None, "action": action.replace("-", "_") if action else None, "line": self.parser.pos(node.start)[0], "unread": unread})

    @staticmethod
    def options(node: Node) -> dict[str, Node]:
        out = {}
        for a in node.args or []:
            if a.kind == "hash":
                for p in a.pairs or []:
                    if p.kind == "pair":
                        key = p.key.name if p.key.kind == "sym" else "".join(x for x in p.key.parts or [] if isinstance(x, str))
                        out[key] = p.value
        return out

    def read(self) -> list[dict]:
        self.walk(self.tree, [], None)
        return self.out

    def walk(self, node: Node | None, modules: list[str], controller: str | None) -> None:
        if node is None:
            return
        if node.kind != "call":
            for child in node.children():
                self.walk(child, modules, controller)
            return
        options = self.options(node)
        names = [n for a in node.args or [] for n in (literal_names([a]) or [])]
        text = lambda key: (literal_names([options[key]]) or [None])[0] if key in options else None
        body = node.block.body if node.block is not None else None
        if node.name in ("resources", "resource"):
            for n in names:
                own = text("controller") or (n if node.name == "resources" else _plural(n))
                inner = [*modules, *([text("module")] if text("module") else [])]
                actions = list(PLURAL if node.name == "resources" else SINGULAR)
                unread = None
                for key, keep in (("only", True), ("except", False)):
                    if key in options:
                        listed = literal_names([options[key]])
                        if listed is None:
                            unread = f"{key} is not literal"
                        else:
                            actions = [a for a in actions if (a in listed) == keep]
                for a in actions:
                    self.add(node, inner, own, a, unread)
                self.walk(body, inner, own)
        elif node.name == "namespace" and names:
            self.walk(body, [*modules, text("module") or names[0]], controller)
        elif node.name == "scope":
            self.walk(body, [*modules, *([text("module")] if text("module") else [])], text("controller") or controller)
        elif node.name == "controller" and names:
            self.walk(body, modules, names[0])
        elif node.name in VERBS:
            to = text("to") or next((v.parts[0] for v in options.values() if v.kind == "str" and v.parts and isinstance(v.parts[0], str) and "#" in v.parts[0]), None)
            if to and "#" in to:
                c, a = to.split("#", 1)
                self.add(node, modules, c.strip("/"), a)
            elif text("action") and (text("controller") or controller):
                self.add(node, modules, text("controller") or controller, text("action"))
            elif names and "#" in names[0]:
                c, a = names[0].split("#", 1)
                self.add(node, modules, c, a)
            else:
                for n in names:
                    if "/" in n.strip("/"):
                        c, a = n.strip("/").rsplit("/", 1)
                        self.add(node, modules, c, a)
                    elif controller:
                        self.add(node, modules, controller, n.strip("/"))
        else:
            for child in node.children():
                self.walk(child, modules, controller)


def routes(files: DataFrame) -> DataFrame:
    """checkout, path, controller, action, line, unread of routes files outside tests."""
    own = files.where(F.col("path").rlike(r"(^|/)config/routes(\.rb|/.*\.rb)$") & ~in_tests(F.col("path")))
    return read_rows(own, ROUTES, lambda content: Reader(content).read())
