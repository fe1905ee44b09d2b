"""What one blob declares, references and calls: a pure function of its bytes."""

from __future__ import annotations

import hashlib
import json

from carnelian.extract import macros
from carnelian.extract.flow import reaching_writes
from carnelian.extract.ruby import Node, Parser, parse

IDENTITY = {"freeze", "dup", "clone", "itself", "tap"}
LITERALS = {"str": "String", "xstr": "String", "sym": "Symbol", "int": "Integer", "float": "Float", "array": "Array", "hash": "Hash", "regex": "Regexp", "range": "Range", "lambda": "Proc", "nil": "NilClass", "true": "TrueClass", "false": "FalseClass"}
KINDS = ("defs", "ancestry", "const_refs", "calls", "assigns", "body_calls", "reaching", "errors")


def text_of(name: str) -> str:
    """A name read as bytes, as text."""
    return name.encode("latin-1", "replace").decode("utf-8", "replace") if name and not name.isascii() else name


def path_text(node: Node | None) -> str | None:
    """A constant path as written, or None for anything else."""
    if node is None or node.kind != "const":
        return None
    if node.scope is None:
        return ("::" if node.top else "") + text_of(node.name)
    before = path_text(node.scope)
    return None if before is None else f"{before}::{text_of(node.name)}"


def literal_names(args: list[Node] | None) -> list[str] | None:
    """Symbols and strings of an argument list, or None where another thing stands."""
    out = []
    for a in args or []:
        if a.kind == "array":
            inner = literal_names(a.items)
            if inner is None:
                return None
            out += inner
        elif a.kind == "sym" and a.name is not None:
            out.append(text_of(a.name))
        elif a.kind == "str" and len(a.parts or []) == 1 and isinstance(a.parts[0], str):
            out.append(text_of(a.parts[0]))
        else:
            return None
    return out


class Scope:
    def __init__(self, nesting: tuple[str, ...] = (), singleton: bool = False, method: str | None = None, body: bool = True):
        self.nesting, self.singleton, self.method, self.body = nesting, singleton, method, body
        self.visibility, self.module_function = "public", False


class Extractor:
    def __init__(self, source: bytes, table: list | None = None):
        self.tree, self.parser = parse(source)
        self.table = table or macros.TABLE
        self.names = {m for m, *_ in self.table}
        self.out: dict[str, list[dict]] = {k: [] for k in KINDS}
        self.sig: str | None = None

    def run(self) -> dict[str, list[dict]]:
        self.visit(self.tree, Scope())
        self.type_readers()
        for read, writes in reaching_writes(self.tree).items():
            for w in sorted(writes):
                (rl, rc), (wl, wc) = self.parser.pos(read), self.parser.pos(w)
                self.out["reaching"].append({"read_line": rl, "read_col": rc, "write_line": wl, "write_col": wc})
        for at, what in self.parser.errors:
            line, col = self.parser.pos(min(at, max(0, self.parser.n - 1)))
            self.out["errors"].append({"message": what, "line": line, "col": col})
        return self.out

    def type_readers(self) -> None:
        """A reader returns the class that every write of its variable in the body makes."""
        made: dict[tuple, set] = {}
        for a in self.out["assigns"]:
            if a["target"].startswith("@") and not a["target"].startswith("@@"):
                made.setdefault((a["target"][1:], tuple(a["nesting"]), a["singleton"]), set()).add(a["value"] if a["shape"] == "new" else None)
        for row in self.out["defs"]:
            if row["via"] in ("attr_reader", "attr_accessor", "attr") and not row["name"].endswith("=") and row["sig_returns"] is None:
                classes = made.get((row["name"], tuple(row["nesting"]), row["singleton"]), set())
                if len(classes) == 1:
                    row["sig_returns"] = next(iter(classes))

    def evaluated(self, text: Node, scope: Scope) -> None:
        """Source in a string that a class evaluates, read at its place in the file.

        Interpolated source is read where the interpolation is no part of a name."""
        begin, stop = text.body or (text.start + 1, text.end - 1)
        if begin >= stop:
            return
        source = self.parser.s
        blank = "".join(c if c == "\n" else " " for c in source[:begin]) + source[begin:stop]
        inner = Extractor(blank.encode("latin-1"), self.table)
        if not inner.parser.errors:
            inner.out = self.out
            inner.visit(inner.tree, scope)

    # -- rows ---------------------------------------------------------------
    def add_def(self, scope: Scope, name: str, kind: str, at: int, end: int, **more) -> dict:
        line, col = self.parser.pos(at)
        row = {"name": text_of(name), "kind": kind, "nesting": list(scope.nesting), "singleton": scope.singleton, "visibility": "public", "params": None, "via": None, "target": None, "sig_returns": None, "line": line, "col": col, "end_line": self.parser.pos(max(at, end - 1))[0]} | more
        self.out["defs"].append(row)
        return row

    def add_edge(self, owner: tuple[str, ...], relation: str, target: str, at: int) -> None:
        line, col = self.parser.pos(at)
        self.out["ancestry"].append({"owner": list(owner), "relation": relation, "target": target, "line": line, "col": col})

    def add_call(self, scope: Scope, name: str, at: int, recv: Node | None, args: list[Node] | None, block: bool, symbol: bool = False, shape: str | None = None) -> None:
        line, col = self.parser.pos(at)
        kind, text = self.receiver(recv)
        rl, rc = self.parser.pos(recv.name_at if recv is not None and recv.name_at is not None else recv.start) if recv is not None else (None, None)
        self.out["calls"].append({"name": text_of(name), "recv": shape or kind, "recv_text": text, "nesting": list(scope.nesting), "singleton": scope.singleton, "argc": self.count(args), "block": block, "symbol": symbol, "recv_line": rl, "recv_col": rc, "line": line, "col": col})

    @staticmethod
    def count(args: list[Node] | None) -> int | None:
        if args is None:
            return None
        if any(a.kind in ("splat", "dsplat") or a.kind == "hash" and a.bare and any(p.kind == "dsplat" for p in a.pairs) for a in args):
            return None
        return sum(1 for a in args if a.kind != "blockpass")

    def receiver(self, recv: Node | None) -> tuple[str, str | None]:
        if recv is None:
            return "implicit", None
        if recv.kind == "self":
            return "self", "self"
        if recv.kind == "const":
            path = path_text(recv)
            return ("const", path) if path else ("other", None)
        if recv.kind == "lvar":
            return "local", text_of(recv.name)
        if recv.kind in ("ivar", "cvar"):
            return "ivar", text_of(recv.name)
        if recv.kind == "call":
            return "other", text_of(recv.name)
        return ("other", LITERALS[recv.kind]) if recv.kind in LITERALS else ("other", None)

    def value_shape(self, value: Node) -> tuple[str, str | None]:
        while value.kind == "paren" and len(value.body.body or []) == 1:
            value = value.body.body[0]
        if value.kind == "rescue_mod":
            return self.value_shape(value.body)
        if value.kind in LITERALS:
            return "literal", LITERALS[value.kind]
        if value.kind == "const":
            path = path_text(value)
            return ("const", path) if path else ("other", None)
        if value.kind == "lvar":
            return "same", text_of(value.name)
        if value.kind == "call" and not value.operator:
            if value.name in IDENTITY and value.recv is not None:
                return self.value_shape(value.recv)
            if value.recv is None or value.recv.kind == "self":
                return "self_call", text_of(value.name)
            path = path_text(value.recv)
            if path and value.name == "new":
                return ("other", None) if path in ("Class", "Module", "Struct") else ("new", path)
            if path:
                return "const_call", f"{path}.{text_of(value.name)}"
            if value.recv.kind == "lvar":
                return "local_call", f"{text_of(value.recv.name)}.{text_of(value.name)}"
            return "chain", text_of(value.name)
        return "other", None

    # -- visiting -----------------------------------------------------------
    def visit(self, node: Node | None, scope: Scope) -> None:
        if node is None:
            return
        method = getattr(self, f"on_{node.kind}", None)
        if method:
            method(node, scope)
        else:
            self.inside(node, scope)

    def inside(self, node: Node, scope: Scope) -> None:
        for child in node.children():
            self.visit(child, scope)

    def on_const(self, node: Node, scope: Scope) -> None:
        if node.scope is not None:
            self.visit(node.scope, scope)
        path = path_text(node)
        if path:
            line, col = self.parser.pos(node.name_at if node.name_at is not None else node.start)
            self.out["const_refs"].append({"name": path, "nesting": list(scope.nesting), "line": line, "col": col})

    def on_class(self, node: Node, scope: Scope) -> None:
        name = path_text(node.path)
        self.add_def(scope, name, node.kind, node.path.name_at, node.end, singleton=False)
        if node.path.scope is not None:
            self.visit(node.path.scope, scope)
        inner = (name, *scope.nesting)
        if node.parent is not None:
            target = path_text(node.parent)
            made = node.parent.kind == "call" and path_text(node.parent.recv) in ("Struct", "Data") and node.parent.name in ("new", "define")
            if target:
                self.add_edge(inner, "superclass", target, node.parent.start)
            elif made:
                self.add_edge(inner, "superclass", path_text(node.parent.recv), node.parent.start)
                self.members(Scope(inner), node.parent)
            self.visit(node.parent, scope)
        self.visit(node.body, Scope(inner))

    def on_module(self, node: Node, scope: Scope) -> None:
        name = path_text(node.path)
        self.add_def(scope, name, "module", node.path.name_at, node.end, singleton=False)
        if node.path.scope is not None:
            self.visit(node.path.scope, scope)
        self.visit(node.body, Scope((name, *scope.nesting)))

    def on_sclass(self, node: Node, scope: Scope) -> None:
        path = path_text(node.value)
        if node.value.kind == "self":
            self.visit(node.body, Scope(scope.nesting, True))
        elif path:
            self.on_const(node.value, scope)
            self.visit(node.body, Scope((path, *scope.nesting), True))
        else:
            self.visit(node.value, scope)
            self.visit(node.body, Scope(("(object)", *scope.nesting), True, body=False))

    def params(self, node: Node) -> list[dict]:
        return [{"kind": p.role, "name": text_of(p.name)} for p in node.params or []]

    def on_def(self, node: Node, scope: Scope) -> None:
        singleton, nesting, visibility = scope.singleton, scope.nesting, scope.visibility
        if node.singleton is not None:
            path = path_text(node.singleton) if node.singleton.kind == "const" else None
            singleton = True
            visibility = "public"
            if path and path != (nesting[0] if nesting else None):
                nesting = (path, *nesting)
            elif node.singleton.kind not in ("self", "const"):
                nesting = (f"(on {text_of(node.singleton.name or '')})", *nesting)
        elif node.name in ("initialize", "initialize_copy", "respond_to_missing?"):
            visibility = "private"
        more = {"visibility": visibility, "params": self.params(node), "sig_returns": self.sig}
        self.sig = None
        at = Scope(nesting, singleton)
        if scope.method and scope.body is False:
            more["via"] = "nested"
        row = self.add_def(at, node.name, "method", node.name_at, node.end, **more)
        if scope.module_function and node.singleton is None:
            self.out["defs"].append(row | {"singleton": True, "visibility": "public", "via": "module_function"})
            row["visibility"] = "private"
        if node.name == "method_missing":
            line, col = self.parser.pos(node.name_at)
            self.out["ancestry"].append({"owner": list(nesting), "relation": "dynamic", "target": "(missing)", "line": line, "col": col})
        inner = Scope(nesting, singleton, node.name, body=False)
        for p in node.params or []:
            self.visit(p.default, inner)
        self.visit(node.body, inner)

    def on_alias(self, node: Node, scope: Scope) -> None:
        if node.new.name and node.old.name:
            self.add_def(scope, node.new.name, "method", node.new.start, node.end, via="alias", target=text_of(node.old.name), visibility=scope.visibility)
            self.add_call(scope, node.old.name, node.old.start, None, None, False, symbol=True, shape="symbol")

    def on_asgn(self, node: Node, scope: Scope) -> None:
        target, value = node.target, node.value
        if target.kind in ("lvar", "ivar", "cvar"):
            shape, text = self.value_shape(value)
            if value.kind == "rescue_mod":
                shape = "rescued" if shape == "new" else shape
            self.add_assign(scope, target, shape, text)
        elif target.kind == "const":
            path = path_text(target)
            if path and target.scope is None:
                self.constant(node, scope, path)
            elif target.scope is not None:
                self.visit(target.scope, scope)
                if path:
                    self.constant(node, scope, path)
        elif target.kind == "call":
            self.visit(target.recv, scope)
            self.add_call(scope, target.name + "=", target.name_at, target.recv, [value], False)
        elif target.kind == "index":
            self.visit(target.recv, scope)
            for a in target.args:
                self.visit(a, scope)
            self.add_call(scope, "[]=", target.name_at, target.recv, [*target.args, value], False)
        self.visit(value, scope)

    def add_assign(self, scope: Scope, target: Node, shape: str, text: str | None) -> None:
        line, col = self.parser.pos(target.start)
        self.out["assigns"].append({"target": text_of(target.name), "shape": shape, "value": text, "nesting": list(scope.nesting), "singleton": scope.singleton, "line": line, "col": col})

    def on_opasgn(self, node: Node, scope: Scope) -> None:
        target = node.target
        if target.kind in ("lvar", "ivar", "cvar"):
            shape, text = self.value_shape(node.value) if node.op in ("||", "&&") else ("other", None)
            self.add_assign(scope, target, shape, text)
        elif target.kind == "call":
            self.visit(target.recv, scope)
            self.add_call(scope, target.name, target.name_at, target.recv, [], False)
            self.add_call(scope, target.name + "=", target.name_at, target.recv, [node.value], False)
        elif target.kind == "index":
            self.visit(target.recv, scope)
            for a in target.args:
                self.visit(a, scope)
            self.add_call(scope, "[]", target.name_at, target.recv, target.args, False)
            self.add_call(scope, "[]=", target.name_at, target.recv, [*target.args, node.value], False)
        elif target.kind == "const":
            self.constant(node, scope, path_text(target) or target.name)
        self.visit(node.value, scope)

    def on_masgn(self, node: Node, scope: Scope) -> None:
        paired = len(node.values) == len(node.targets) and all(v.kind != "splat" for v in node.values) and all(t.kind != "splat" for t in node.targets)
        for k, t in enumerate(node.targets):
            t = t.value if t.kind == "splat" and t.value is not None else t
            if t.kind in ("lvar", "ivar", "cvar"):
                self.add_assign(scope, t, *(self.value_shape(node.values[k]) if paired else ("other", None)))
            elif t.kind == "call":
                self.visit(t.recv, scope)
                self.add_call(scope, t.name + "=", t.name_at, t.recv, [t], False)
        for v in node.values:
            self.visit(v, scope)

    def constant(self, node: Node, scope: Scope, name: str) -> None:
        value, at = node.value, node.target.name_at
        recv = path_text(value.recv) if value.kind == "call" else None
        if (recv, value.name) in (("Struct", "new"), ("Data", "define"), ("Class", "new"), ("Module", "new")):
            self.add_def(scope, name, "module" if recv == "Module" else "class", at, node.end, singleton=False, via=f"{recv}.{value.name}")
            inner = Scope((name, *scope.nesting))
            if recv == "Class" and value.args and path_text(value.args[0]):
                self.add_edge(inner.nesting, "superclass", path_text(value.args[0]), value.args[0].start)
            elif recv in ("Struct", "Data"):
                self.add_edge(inner.nesting, "superclass", recv, value.start)
                self.members(inner, value)
            if value.block is not None:
                self.visit(value.block.body, inner)
                value.block = None
            return
        self.add_def(scope, name, "constant", at, node.end, singleton=False, target=path_text(value))

    def members(self, scope: Scope, call: Node) -> None:
        for a in call.args or []:
            if a.kind == "sym" and a.name:
                self.add_def(scope, a.name, "method", a.start, a.end, via="member", params=[])
                if path_text(call.recv) == "Struct":
                    self.add_def(scope, a.name + "=", "method", a.start, a.end, via="member", params=[{"kind": "req", "name": "value"}])

    def on_super(self, node: Node, scope: Scope) -> None:
        if scope.method:
            self.add_call(scope, scope.method, node.start, None, node.args, node.block is not None, shape="super")
        for a in node.args or []:
            self.visit(a, scope)
        self.visit(node.block, scope)

    def on_index(self, node: Node, scope: Scope) -> None:
        self.visit(node.recv, scope)
        self.add_call(scope, "[]", node.name_at, node.recv, node.args, False)
        for a in node.args:
            self.visit(a, scope)

    def on_blockpass(self, node: Node, scope: Scope) -> None:
        if node.value is not None and node.value.kind == "sym" and node.value.name:
            self.add_call(scope, node.value.name, node.value.start, None, [], False, symbol=True, shape="symbol")
        elif node.value is not None:
            self.visit(node.value, scope)

    def on_block(self, node: Node, scope: Scope) -> None:
        for p in node.params or []:
            self.visit(p.default, scope)
        self.visit(node.body, scope)

    def on_call(self, node: Node, scope: Scope) -> None:
        own = node.recv is None or node.recv.kind == "self"
        at_body = scope.body and own
        if at_body and self.macro(node, scope):
            return
        if own and scope.method and scope.singleton and node.name in macros.MIXINS:
            for a in node.args or []:
                if path_text(a):
                    self.add_edge(scope.nesting, "macro", f"{node.name}|{scope.method}|{path_text(a)}", a.start)
        if not own:
            self.sent_mixin(node, scope)
        self.visit(node.recv, scope)
        name = node.name
        if name:
            blocked = node.block is not None or any(a.kind == "blockpass" for a in node.args or [])
            self.add_call(scope, name, node.name_at, node.recv, node.args, blocked)
        if at_body and name and name not in self.names:
            args = [text_of(a.name) if a.kind == "sym" and a.name else a.parts[0] if a.kind == "str" and len(a.parts or []) == 1 and isinstance(a.parts[0], str) else None for a in node.args or []]
            self.out["body_calls"].append({"name": text_of(name), "nesting": list(scope.nesting), "args": args, "line": self.parser.pos(node.name_at)[0]})
        if path_text(node.recv) == "ActiveSupport" and name == "run_load_hooks" and literal_names((node.args or [])[:1]):
            self.add_edge(scope.nesting, "load_hooks", literal_names(node.args[:1])[0], node.name_at)
        self.symbols(node, scope, own)
        for a in node.args or []:
            self.visit(a, scope)
        if name in ("class_eval", "module_eval", "instance_eval") and node.args and node.args[0].kind == "str" and all(isinstance(p, str) for p in node.args[0].parts or []):
            path = path_text(node.recv)
            if path or own:
                self.evaluated(node.args[0], Scope((path, *scope.nesting) if path else scope.nesting, name == "instance_eval"))
        if node.block is not None:
            self.visit_block(node, scope)

    def visit_block(self, node: Node, scope: Scope) -> None:
        path = path_text(node.recv)
        if node.block is None:
            return
        if node.name in ("class_eval", "class_exec", "module_eval") and path:
            self.visit(node.block, Scope((path, *scope.nesting)))
        elif scope.body and node.recv is None and node.name == "included":
            inner = Scope(scope.nesting)
            inner.included = True
            self.visit(node.block, inner)
        elif scope.body and node.recv is None and node.name == "class_methods":
            self.add_def(scope, "ClassMethods", "module", node.name_at, node.end, singleton=False, via="class_methods")
            self.visit(node.block, Scope(("ClassMethods", *scope.nesting)))
        elif node.recv is not None and path_text(node.recv) == "ActiveSupport" and node.name == "on_load" and literal_names(node.args[:1]):
            self.visit(node.block, Scope((f"(on_load {literal_names(node.args[:1])[0]})", *(n for n in scope.nesting if not n.startswith("(")))))
        else:
            inner = Scope(scope.nesting, scope.singleton, scope.method, body=False)
            self.visit(node.block, inner)

    def symbols(self, node: Node, scope: Scope, own: bool) -> None:
        """Literal symbols that name a method to call."""
        by_name = node.name in macros.BY_NAME
        if not (own and scope.body or by_name):
            return
        for k, a in enumerate(node.args or []):
            declares = node.name in self.names or node.name in ("delegate", "enum", "def_delegators", "def_delegator")
            if a.kind == "sym" and a.name and not a.label and (k == 0 or not by_name) and not declares:
                recv = node.recv if by_name and node.recv is not None else None
                self.add_call(scope, a.name, a.start, recv, None, False, symbol=True, shape=None if recv is not None else "symbol")
            if a.kind == "hash":
                for p in a.pairs or []:
                    if p.kind == "pair" and p.key.kind == "sym" and p.key.name in ("if", "unless", "with", "only_if", "validate", "through", "counter_cache", "prepend_if") and p.value is not None:
                        for v in [p.value] if p.value.kind == "sym" else p.value.items or []:
                            if v.kind == "sym" and v.name:
                                self.add_call(scope, v.name, v.start, None, [], False, symbol=True, shape="symbol")

    def sent_mixin(self, node: Node, scope: Scope) -> None:
        path, args, name = path_text(node.recv), list(node.args or []), node.name
        if not path:
            return
        if name in ("send", "public_send", "__send__") and args and args[0].kind == "sym" and args[0].name in macros.MIXINS:
            name, args = args[0].name, args[1:]
        if name in macros.MIXINS:
            for a in reversed(args):
                if path_text(a):
                    self.add_edge((f"(sent {path})", *scope.nesting), name, path_text(a), a.start)

    def macro(self, node: Node, scope: Scope) -> bool:
        """Handles a class-body call that declares something; True if it is done with."""
        name, args = node.name, node.args or []
        if name in ("private", "public", "protected", "module_function"):
            return self.set_visibility(node, scope, name, args)
        if name in ("private_class_method", "public_class_method"):
            for n in literal_names(args) or []:
                self.change(scope, n, name.split("_")[0], True)
            for a in args:
                self.visit(a, scope)
            return True
        if name in macros.MIXINS and args:
            for a in reversed(args):
                path = path_text(a)
                target = path or ("self" if a.kind == "self" else None)
                if target and scope.nesting:
                    relation = name
                    if scope.singleton:
                        relation = {"include": "extend", "prepend": "singleton_prepend", "extend": "extend"}[name]
                    owner = (f"(mixed {scope.nesting[0]})", *scope.nesting[1:]) if getattr(scope, "included", False) else scope.nesting
                    self.add_edge(owner, relation, target, a.start)
            self.add_call(scope, name, node.name_at, node.recv, node.args, False)
            for a in args:
                self.visit(a, scope)
            return True
        if name == "sig" and node.block is not None:
            self.sig = self.returned(node.block.body)
            self.visit(node.block, Scope(scope.nesting, True, body=False))
            return True
        if name == "alias_method" and len(args) == 2:
            names = literal_names(args)
            if names:
                self.add_def(scope, names[0], "method", args[0].start, node.end, via="alias", target=names[1], visibility=scope.visibility)
                self.add_call(scope, names[1], args[1].start, None, None, False, symbol=True, shape="symbol")
                return True
        if name in ("delegate", "def_delegators", "def_delegator", "def_instance_delegator", "def_instance_delegators", "delegate_missing_to"):
            self.delegated(node, scope, name, args)
            return False
        if name == "define_method" and args:
            names = literal_names(args[:1])
            if names:
                params = [{"kind": p.role, "name": text_of(p.name)} for p in (node.block.params if node.block else [])] if node.block else None
                self.add_def(scope, names[0], "method", args[0].start, node.end, via="define_method", params=params, visibility=scope.visibility)
            else:
                self.add_edge(scope.nesting, "dynamic", self.shape(args[0]), node.name_at)
            if node.block is not None:
                self.visit(node.block, Scope(scope.nesting, scope.singleton, names[0] if names else None, body=False))
            return True
        if name == "enum":
            self.enum(node, scope, args)
            return False
        if name in self.names and args:
            self.generated(node, scope, name, args)
        return False

    @staticmethod
    def shape(value: Node) -> str:
        if value.kind in ("str", "sym") and value.parts:
            return "".join(p if isinstance(p, str) else "*" for p in value.parts)
        return "*"

    def set_visibility(self, node: Node, scope: Scope, name: str, args: list[Node]) -> bool:
        if not args:
            scope.module_function = name == "module_function"
            if name != "module_function":
                scope.visibility = name
            return True
        for a in args:
            before = len(self.out["defs"])
            self.visit(a, scope)
            names = [r["name"] for r in self.out["defs"][before:] if r["kind"] == "method"] or literal_names([a]) or []
            for n in names:
                if name == "module_function":
                    for row in [r for r in self.out["defs"] if r["name"] == n and r["nesting"] == list(scope.nesting) and r["kind"] == "method" and not r["singleton"]][-1:]:
                        self.out["defs"].append(row | {"singleton": True, "visibility": "public", "via": "module_function"})
                        row["visibility"] = "private"
                else:
                    self.change(scope, n, name, scope.singleton)
        return True

    def change(self, scope: Scope, name: str, visibility: str, singleton: bool) -> None:
        found = [r for r in self.out["defs"] if r["kind"] == "method" and r["name"] == name and r["nesting"] == list(scope.nesting) and r["singleton"] == singleton]
        for row in found[-1:]:
            row["visibility"] = visibility

    def returned(self, body: Node | None) -> str | None:
        """What a signature says the method returns, where it is one class."""
        stack = [body] if body is not None else []
        while stack:
            node = stack.pop()
            if node.kind == "call" and node.name == "returns" and node.args:
                kind = node.args[0]
                while kind.kind in ("call", "index") and path_text(kind.recv) in ("T",) and kind.name == "nilable" and kind.args:
                    kind = kind.args[0]
                return path_text(kind)
            if node.kind == "call" and node.name == "void":
                return None
            stack += list(node.children())
        return None

    def option(self, args: list[Node], name: str) -> Node | None:
        for a in args:
            if a.kind == "hash":
                for p in a.pairs or []:
                    if p.kind == "pair" and p.key.kind in ("sym", "str") and (p.key.name or "".join(x for x in p.key.parts or [] if isinstance(x, str))) == name:
                        return p.value
        return None

    def delegated(self, node: Node, scope: Scope, name: str, args: list[Node]) -> None:
        names = [n for a in args for n in (literal_names([a]) or [])]
        if name == "delegate":
            to, prefix = self.option(args, "to"), self.option(args, "prefix")
            target = (literal_names([to]) or [path_text(to)])[0] if to is not None else None
            lead = "" if prefix is None else f"{target}_" if prefix.kind == "true" else f"{(literal_names([prefix]) or [''])[0]}_"
            for a in args:
                for n in literal_names([a]) or []:
                    self.add_def(scope, lead + n, "method", a.start, node.end, via="delegate", target=f"{target}.{n}", visibility=scope.visibility)
        elif name == "delegate_missing_to" and names:
            self.add_edge(scope.nesting, "dynamic", f"(delegate {names[0]})", node.name_at)
        elif name in ("def_delegators", "def_instance_delegators") and len(names) > 1:
            for a, n in zip(args[1:], names[1:], strict=False):
                self.add_def(scope, n, "method", a.start, node.end, via="delegate", target=f"{names[0]}.{n}")
        elif len(names) > 1:
            self.add_def(scope, names[2] if len(names) > 2 else names[1], "method", args[1].start, node.end, via="delegate", target=f"{names[0]}.{names[1]}")

    def generated(self, node: Node, scope: Scope, name: str, args: list[Node]) -> None:
        class_name = self.option(args, "class_name")
        known = (literal_names([class_name]) or [None])[0] if class_name is not None else None
        chosen = [a for a in args if a.kind in ("sym", "str")]
        if name == "store_accessor":
            chosen = chosen[1:]
        for a in chosen if name in macros.MANY else chosen[:1]:
            for n in literal_names([a]) or []:
                for made, side, arity, returns in macros.made(name, n, known, self.table):
                    params = None if arity < 0 else [{"kind": "req", "name": f"a{k}"} for k in range(arity)]
                    self.add_def(scope, made, "method", a.start, node.end, singleton=side or scope.singleton, via=name, target=n, params=params, sig_returns=returns, visibility=scope.visibility if name.startswith("attr") else "public")
        if name in ("has_many", "has_one", "belongs_to", "has_and_belongs_to_many") and chosen:
            n = (literal_names(chosen[:1]) or [None])[0]
            target = macros.associated_class(name, n, known) if n else None
            if target:
                line, col = self.parser.pos(chosen[0].start)
                self.out["const_refs"].append({"name": target, "nesting": list(scope.nesting), "line": line, "col": col})

    def enum(self, node: Node, scope: Scope, args: list[Node]) -> None:
        """enum status: {...} and enum :status, ...; members with prefix or suffix."""
        pairs: list[tuple[str, Node | None]] = []
        if args and args[0].kind in ("sym", "str"):
            values = args[1] if len(args) > 1 else None
            if values is not None and values.kind == "hash" and values.bare:
                keep = [p for p in values.pairs if p.kind == "pair" and p.key.name not in ("prefix", "suffix", "scopes", "default", "validate", "instance_methods")]
                values = Node("hash", values.start, values.end, pairs=keep)
            pairs = [((literal_names(args[:1]) or [""])[0], values)]
        else:
            pairs = [(p.key.name, p.value) for a in args if a.kind == "hash" for p in a.pairs if p.kind == "pair" and p.key.kind == "sym" and not p.key.name.startswith("_")]
        lead, tail = (self.option(args, k) or self.option(args, f"_{k}") for k in ("prefix", "suffix"))
        for attribute, values in pairs:
            names = [p.key.name for p in values.pairs or [] if p.kind == "pair" and p.key.kind == "sym"] if values is not None and values.kind == "hash" else (literal_names([values]) or []) if values is not None else []
            word = lambda option, attribute=attribute: "" if option is None else attribute if option.kind == "true" else (literal_names([option]) or [""])[0]
            before, after = word(lead), word(tail)
            self.add_def(scope, macros.singular(attribute) + ("s" if not attribute.endswith("s") else "es"), "method", node.name_at, node.end, singleton=True, via="enum", params=[])
            for n in names:
                full = "_".join(x for x in (before, text_of(n), after) if x)
                for made, side in ((f"{full}?", False), (f"{full}!", False), (full, True), (f"not_{full}", True)):
                    self.add_def(scope, made, "method", node.name_at, node.end, singleton=side, via="enum", target=attribute, params=[])


def extract(source: bytes, table: list | None = None) -> dict[str, list[dict]]:
    """Rows of every fact kind; never raises, on any bytes."""
    import sys

    if sys.getrecursionlimit() < 6000:
        sys.setrecursionlimit(6000)
    extractor = Extractor(source, table)
    try:
        return extractor.run()
    except (RecursionError, AttributeError, IndexError, TypeError, KeyError) as trouble:
        extractor.out["errors"].append({"message": type(trouble).__name__, "line": 1, "col": 1})
        return extractor.out


def digest(facts: dict[str, list[dict]], namespace_only: bool = False) -> int:
    """A signed 64-bit digest of what a tree is built from; without methods for the namespace alone."""
    rows = [r for r in facts["defs"] if not namespace_only or r["kind"] != "method"], facts["ancestry"]
    return int.from_bytes(hashlib.blake2b(json.dumps(rows, sort_keys=True).encode(), digest_size=8).digest(), "big", signed=True)


__all__ = ["KINDS", "Extractor", "Parser", "digest", "extract", "literal_names", "path_text"]
