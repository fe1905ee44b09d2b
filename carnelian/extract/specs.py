"""Spec files: example groups, the members that they declare, and what reads them."""

from __future__ import annotations

from carnelian.extract.facts import Extractor, literal_names, path_text, text_of
from carnelian.extract.ruby import Node, parse

#: Words that open a group, an example, or declare a member.
GROUPS = {"describe", "context", "feature", "example_group", "fdescribe", "xdescribe", "fcontext", "xcontext"}
SHARED = {"shared_examples", "shared_examples_for", "shared_context"}
INCLUDES = {"include_examples", "include_context", "it_behaves_like", "it_should_behave_like"}
EXAMPLES = {"it", "specify", "example", "scenario", "fit", "xit", "its", "before", "after", "around"}
MEMBERS = {"let", "let!", "subject", "subject!"}

GROUP_ROWS = "group string, parent string, described string, shared boolean, line int, end_line int"
MEMBER_ROWS = "group string, name string, how string, shape string, value string, line int, col int"
READ_ROWS = "group string, name string, in_example boolean, symbol boolean, line int, col int"
INCLUDE_ROWS = "group string, shared_name string, line int"


class Reader:
    """groups are known by the path of their place: "12", "12/15", and so on."""

    def __init__(self, source: bytes):
        self.tree, self.parser = parse(source)
        self.shapes = Extractor.__new__(Extractor)
        self.out: dict[str, list[dict]] = {"groups": [], "members": [], "reads": [], "includes": []}

    def read(self) -> dict[str, list[dict]]:
        self.walk(self.tree, None, False)
        return self.out

    def walk(self, node: Node | None, group: str | None, example: bool) -> None:
        if node is None:
            return
        if node.kind == "call" and (node.recv is None or path_text(node.recv) == "RSpec"):
            line, col = self.parser.pos(node.name_at)
            if node.name in GROUPS | SHARED and node.block is not None:
                own = f"{group}/{line}" if group else str(line)
                first = (node.args or [None])[0]
                label = (literal_names([first]) or [None])[0] if first is not None else None
                self.out["groups"].append({"group": own, "parent": group, "described": label if node.name in SHARED else path_text(first), "shared": node.name in SHARED, "line": line, "end_line": self.parser.pos(max(0, node.end - 1))[0]})
                self.walk(node.block.body, own, False)
                return
            if node.name in INCLUDES and group and literal_names((node.args or [])[:1]):
                self.out["includes"].append({"group": group, "shared_name": literal_names(node.args[:1])[0], "line": line})
            if node.name in MEMBERS and group and node.block is not None:
                names = literal_names((node.args or [])[:1]) or ["subject"]
                body = node.block.body.body or [] if node.block.body.kind == "seq" else []
                shape, value = self.shapes.value_shape(body[-1]) if body else ("other", None)
                for n in dict.fromkeys([names[0], *(["subject"] if node.name.startswith("subject") else [])]):
                    self.out["members"].append({"group": group, "name": n, "how": node.name, "shape": shape, "value": value, "line": line, "col": col})
                self.walk(node.block.body, group, True)
                return
            if group and node.name not in EXAMPLES | INCLUDES and node.name:
                if not node.args:
                    self.out["reads"].append({"group": group, "name": text_of(node.name), "in_example": example, "symbol": False, "line": line, "col": col})
            inside = example or node.name in EXAMPLES
            for child in node.children():
                self.walk(child, group, inside)
            return
        if node.kind == "def" and group:
            line, col = self.parser.pos(node.name_at)
            self.out["members"].append({"group": group, "name": text_of(node.name), "how": "def", "shape": "other", "value": None, "line": line, "col": col})
            self.walk(node.body, group, True)
            return
        if node.kind == "sym" and group and example and node.name and not node.label:
            line, col = self.parser.pos(node.start)
            self.out["reads"].append({"group": group, "name": text_of(node.name), "in_example": example, "symbol": True, "line": line, "col": col})
        for child in node.children():
            self.walk(child, group, example)


def is_minitest(source: bytes) -> bool:
    """A spec file of the other library: it requires it, or opens a class below its test case."""
    return b"minitest" in source.lower() and b"require" in source or b"Minitest::" in source
