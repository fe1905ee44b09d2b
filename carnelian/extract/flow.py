"""Which writes of a local variable reach each read: a forward pass over the tree.

State maps a variable to its writes that may have been the last.  Branches run
from a copy and are united; a repeated body may run again after itself, so its
reads also see its own later writes; a rescue clause starts from before the
body and every write in it; bodies of def, class and module start empty.
"""

from __future__ import annotations

from carnelian.extract.ruby import Node

State = dict[str, frozenset[int]]


def union(*states: State) -> State:
    out: State = {}
    for s in states:
        for k, v in s.items():
            out[k] = out.get(k, frozenset()) | v
    return out


class Flow:
    def __init__(self):
        self.reads: dict[int, set[int]] = {}

    def write(self, node: Node | None, state: State) -> None:
        if node is None:
            return
        if node.kind == "lvar":
            state[node.name] = frozenset([node.start])
        elif node.kind == "splat":
            self.write(node.value, state)
        elif node.kind == "mlhs":
            for x in node.items:
                self.write(x, state)
        else:
            for child in node.children():
                self.run(child, state)

    def run(self, node: Node | None, state: State) -> None:
        """Changes state to what holds after the node."""
        if node is None:
            return
        kind = node.kind
        if kind == "lvar":
            self.reads.setdefault(node.start, set()).update(state.get(node.name, ()))
        elif kind in ("asgn", "opasgn"):
            if kind == "opasgn" and node.target.kind == "lvar":
                self.reads.setdefault(node.target.start, set()).update(state.get(node.target.name, ()))
            self.run(node.value, state)
            if kind == "opasgn" and node.op in ("||", "&&") and node.target.kind == "lvar":
                before = state.get(node.target.name, frozenset())
                self.write(node.target, state)
                state[node.target.name] |= before
            else:
                self.write(node.target, state)
        elif kind == "masgn":
            for v in node.values:
                self.run(v, state)
            for t in node.targets:
                self.write(t, state)
        elif kind == "if":
            self.run(node.cond, state)
            self.branches(state, [node.then, node.other])
        elif kind in ("and", "or"):
            self.run(node.left, state)
            self.branches(state, [node.right, None])
        elif kind == "case":
            self.run(node.value, state)
            for b in node.branches:
                for t in b.tests:
                    self.run(t, state)
            self.branches(state, [b.body for b in node.branches] + [node.other])
        elif kind == "while":
            for t in node.targets or []:
                self.write(t, state)
            self.repeated([node.cond, node.body], state, ())
        elif kind == "rescue_mod":
            before = dict(state)
            self.run(node.body, state)
            other = union(before, state)
            self.run(node.rescue, other)
            self.merge(state, union(state, other))
        elif kind == "begin":
            before = dict(state)
            seen = self.writes_of(node.body)
            self.run(node.body, state)
            after = dict(state)
            self.run(node.other, after)
            ends = [after]
            for r in node.rescues or []:
                own = union(before, seen)
                self.write(r.name, own) if r.name is not None else None
                for c in r.classes:
                    self.run(c, own)
                self.run(r.body, own)
                ends.append(own)
            self.merge(state, union(*ends))
            self.run(node.ensure, state)
        elif kind in ("def", "class", "module", "sclass"):
            self.run(node.parent, state)
            inner: State = {p.name: frozenset([p.start]) for p in node.params or [] if p.kind == "param"}
            for p in node.params or []:
                self.run(p.default, inner)
            self.run(node.body, inner)
        elif kind in ("block", "lambda"):
            own = {p.name for p in node.params or []}
            inner = dict(state)
            for p in node.params or []:
                self.run(p.default, inner)
                if p.inner is not None:
                    self.write(p.inner, inner)
                inner[p.name] = frozenset([p.start])
            self.repeated([node.body], inner, own)
            hidden = own | (set(inner) - set(state))
            self.merge(state, union(state, {k: v for k, v in inner.items() if k not in hidden}))
        else:
            for child in node.children():
                self.run(child, state)

    @staticmethod
    def merge(state: State, found: State) -> None:
        state.clear()
        state.update(found)

    def branches(self, state: State, parts: list[Node | None]) -> None:
        ends = []
        for p in parts:
            own = dict(state)
            self.run(p, own)
            ends.append(own)
        self.merge(state, union(*ends))

    def repeated(self, parts: list[Node | None], state: State, own) -> None:
        before = dict(state)
        for p in parts:
            self.run(p, state)
        again = union(before, {k: v for k, v in state.items() if k not in own})
        for p in parts:
            self.run(p, again)
        self.merge(state, union(before, again))

    def writes_of(self, node: Node | None) -> State:
        out: State = {}
        stack = [node] if node is not None else []
        while stack:
            n = stack.pop()
            if n.kind in ("def", "class", "module", "sclass"):
                continue
            if n.kind in ("asgn", "opasgn") and n.target.kind == "lvar":
                out[n.target.name] = out.get(n.target.name, frozenset()) | {n.target.start}
            stack += list(n.children())
        return out


def reaching_writes(tree: Node) -> dict[int, set[int]]:
    """Offsets of writes that reach each read of a local, by the read's offset."""
    flow = Flow()
    flow.run(tree, {})
    return {k: v for k, v in flow.reads.items() if v}
