"""A tolerant parser for Ruby source.

It reads the source as one character a byte, so offsets are byte offsets, and
works without a separate lexer: what a character means depends on where the
parser stands (a slash after a value divides, elsewhere it opens a pattern).
It never raises: what it can't read is counted and skipped to the next line.
"""

from __future__ import annotations

import re
from bisect import bisect_right

IDENT = re.compile(r"[a-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*")
CONST = re.compile(r"[A-Z][A-Za-z0-9_\x80-\xff]*")
ANY_NAME = re.compile(r"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*")
NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![0-9.eE])|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]*")
OPERATOR_NAME = re.compile(r"\[\]=?|\*\*|[+\-!~]@|<=>|===?|=~|!=|!~|<<|>>|<=|>=|[+\-*/%<>!&|^~`]")
HEREDOC = re.compile(r"<<([~-]?)(?:([A-Z_a-z]\w*)|\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`)")
ASSIGN_OP = re.compile(r"(\*\*|\|\||&&|<<|>>|[+\-*/%|&^])=(?![=~>])")
WORD_END = r"(?![A-Za-z0-9_\x80-\xff?!]|:(?!:))"
KEYWORDS = frozenset("alias and begin BEGIN break case class def defined? do else elsif end END ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__ __LINE__ __method__ __ENCODING__".split())
#: Binary operators by binding power, the weakest first.
BINARY = (
    (1, r"\.\.\.?"), (2, r"\|\|(?!=)"), (3, r"&&(?!=)"), (5, r"<=>|===|==|!=|=~|!~"), (6, r"<=|>=|<(?!<)|>(?!>)"), (7, r"\|(?![|=])|\^(?!=)"),
    (8, r"&(?![&=.])"), (9, r"<<(?!=)|>>(?!=)"), (10, r"[+\-](?!=)"), (11, r"\*(?![*=])|/(?!=)|%(?!=)"), (13, r"\*\*(?!=)"),
)
BINARY = tuple((p, re.compile(x)) for p, x in BINARY)
CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}


class Node:
    """kind, start and end offset, and whatever the kind has."""

    def __init__(self, kind: str, start: int, end: int, **more):
        self.kind, self.start, self.end = kind, start, end
        self.__dict__.update(more)

    def __getattr__(self, name):  # a field that the kind lacks
        if name.startswith("__"):
            raise AttributeError(name)
        return None

    def children(self):
        for value in self.__dict__.values():
            if isinstance(value, Node):
                yield value
            elif isinstance(value, (list, tuple)):
                for x in value:
                    if isinstance(x, Node):
                        yield x
                    elif isinstance(x, tuple):
                        yield from (y for y in x if isinstance(y, Node))


class Stop(Exception):
    """What stands here can't be read."""


class Parser:
    def __init__(self, source: bytes):
        self.s = source.decode("latin-1")
        self.n = len(self.s)
        cut = re.search(r"^__END__\r?$", self.s, re.M)
        if cut:
            self.n = cut.start()
        self.i = 0
        self.errors: list[tuple[int, str]] = []
        self.pending: list[tuple[str, bool, bool, Node]] = []
        self.locals: list[set[str]] = [set()]
        self.no_do = 0
        self.depth = 0
        self.lines = [0, *(m.end() for m in re.finditer("\n", self.s))]

    # -- places -------------------------------------------------------------
    def pos(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.lines, at)
        return line, at - self.lines[line - 1] + 1

    def error(self, what: str) -> Stop:
        return Stop(f"{what} at {self.i}")

    # -- white space --------------------------------------------------------
    def newline(self) -> None:
        """Past the line's end, and past the bodies of here documents begun on it."""
        self.i += 1
        while self.pending:
            word, squiggly, raw, node = self.pending.pop(0)
            begin = self.i
            pattern = re.compile(r"[ \t]*" + re.escape(word) + r"\r?(?:\n|$)" if squiggly else re.escape(word) + r"\r?(?:\n|$)")
            while self.i < self.n:
                m = pattern.match(self.s, self.i)
                if m:
                    break
                end = self.s.find("\n", self.i, self.n)
                self.i = self.n if end < 0 else end + 1
            stop = self.i
            if self.i < self.n:
                end = self.s.find("\n", self.i, self.n)
                self.i = self.n if end < 0 else end + 1
            node.parts = [self.s[begin:stop]] if raw else self.interpolated(begin, stop)
            node.body = (begin, stop)

    def space(self, lines: bool = False) -> None:
        s = self.s
        while self.i < self.n:
            c = s[self.i]
            if c in " \t\r\f\v":
                self.i += 1
            elif c == "\\" and s.startswith(("\\\n", "\\\r\n"), self.i):
                self.i = s.index("\n", self.i)
                self.newline()
            elif c == "#":
                end = s.find("\n", self.i, self.n)
                self.i = self.n if end < 0 else end
            elif c == "\n" and lines:
                self.newline()
                self.comment_block()
            elif c == ";" and lines == "all":
                self.i += 1
            else:
                return

    def comment_block(self) -> None:
        while self.s.startswith("=begin", self.i) and (self.i == 0 or self.s[self.i - 1] == "\n"):
            end = re.compile(r"^=end.*$", re.M).search(self.s, self.i, self.n)
            self.i = end.end() if end else self.n
            if self.i < self.n:
                self.i += 1

    def follows_line(self) -> bool:
        """Past a line's end stands a method call's dot: the expression goes on."""
        save, pending = self.i, list(self.pending)
        if self.pending:
            return False
        self.space(lines=True)
        if re.compile(r"&?\.(?![.\d])").match(self.s, self.i):
            return True
        self.i, self.pending = save, pending
        return False

    def at(self, text: str) -> bool:
        return self.s.startswith(text, self.i) and self.i + len(text) <= self.n

    def word(self, w: str) -> bool:
        return self.at(w) and re.compile(WORD_END).match(self.s, self.i + len(w)) is not None

    def keyword(self) -> str | None:
        m = ANY_NAME.match(self.s, self.i)
        if not m or self.i >= self.n:
            return None
        w = m.group()
        if w == "defined" and self.s.startswith("?", m.end()):
            return "defined?"
        if w in KEYWORDS and not (self.s.startswith(":", m.end()) and not self.s.startswith("::", m.end()) and w not in ("else", "ensure", "begin", "then", "do")):
            return w
        return None

    def take(self, text: str) -> None:
        if not self.at(text):
            raise self.error(f"expected {text}")
        self.i += len(text)

    # -- statements ---------------------------------------------------------
    def program(self) -> Node:
        body = []
        self.comment_block()
        while self.i < self.n:
            found = self.statements(())
            body += found.body
            if self.i < self.n:  # a stray closer
                self.errors.append((self.i, "unexpected"))
                m = ANY_NAME.match(self.s, self.i)
                self.i = m.end() if m else self.i + 1
        return Node("seq", 0, self.n, body=body)

    def statements(self, ends: tuple[str, ...], closer: str = "") -> Node:
        start, body = self.i, []
        self.depth += 1
        while True:
            self.space("all")
            if self.i >= self.n or closer and self.at(closer):
                break
            if self.keyword() in ("end", "else", "elsif", "when", "in", "rescue", "ensure", "then") or self.s[self.i] in ")]}":
                break
            before = self.i
            try:
                if self.depth > 150:
                    raise self.error("too deep")
                body.append(self.statement())
                self.space()
                if self.i < self.n and self.s[self.i] not in "\n;)]}" and self.keyword() not in (*ends, "end", "else", "elsif", "when", "in", "rescue", "ensure", "then", "do"):
                    raise self.error("unexpected")
                if self.keyword() == "do":
                    raise self.error("unexpected do")
            except Stop as stop:
                self.errors.append((self.i, str(stop)))
                self.recover(before)
            except (RecursionError, IndexError, AttributeError, TypeError) as stop:
                self.errors.append((self.i, type(stop).__name__))
                self.recover(before)
        self.depth -= 1
        return Node("seq", start, self.i, body=body)

    def recover(self, before: int) -> None:
        self.i = max(self.i, before + 1)
        end = self.s.find("\n", self.i, self.n)
        self.i = self.n if end < 0 else end
        if self.i < self.n:
            self.newline()

    def statement(self) -> Node:
        node = self.expression_statement()
        while True:
            self.space()
            w = self.keyword()
            start = node.start
            if w in ("if", "unless"):
                self.i += len(w)
                cond = self.expression_statement()
                node = Node("if", start, self.i, cond=cond, then=node if w == "if" else None, other=node if w == "unless" else None, modifier=True)
            elif w in ("while", "until"):
                self.i += len(w)
                node = Node("while", start, self.i, cond=self.expression_statement(), body=node, modifier=True)
            elif w == "rescue":
                self.i += 6
                node = Node("rescue_mod", start, self.i, body=node, rescue=self.expression_statement())
            else:
                return node

    def expression_statement(self) -> Node:
        node = self.not_expression()
        while True:
            self.space()
            w = self.keyword()
            if w not in ("and", "or"):
                return node
            self.i += len(w)
            self.space(lines=True)
            node = Node(w, node.start, self.i, left=node, right=self.not_expression())

    def not_expression(self) -> Node:
        self.space()
        if self.keyword() == "not":
            start = self.i
            self.i += 3
            return Node("not", start, self.i, value=self.not_expression())
        node = self.expression(commands=True)
        self.space()
        if self.i < self.n and self.at(",") and self.masgn_follows(node):
            return self.multiple(node)
        if self.at("=>") or self.keyword() == "in" and not self.no_in:
            if self.at("=>"):
                self.i += 2
            else:
                self.i += 2
            return Node("match", node.start, self.i, value=node, pattern=self.pattern())
        return node

    no_in = 0

    # -- multiple assignment ------------------------------------------------
    def masgn_follows(self, node: Node) -> bool:
        if node.kind not in ("lvar", "ivar", "gvar", "cvar", "call", "const", "splat", "mlhs", "index"):
            return False
        m = re.compile(r"[^\n=#;{}'\"]*?[^=!<>~+\-*/|&%\n;]=(?![=~>])").match(self.s, self.i, self.n)
        return m is not None

    def multiple(self, first: Node) -> Node:
        targets = [first]
        while self.at(","):
            self.i += 1
            self.space()
            if self.at("="):
                break
            targets.append(self.target())
            self.space()
        self.take("=")
        self.space(lines=True)
        values = [self.splat_or_expression()]
        self.space()
        while self.at(","):
            self.i += 1
            self.space(lines=True)
            values.append(self.splat_or_expression())
            self.space()
        for t in targets:
            self.declare(t)
        return Node("masgn", first.start, self.i, targets=targets, values=values)

    def target(self) -> Node:
        start = self.i
        if self.at("*"):
            self.i += 1
            inner = self.target() if re.compile(r"[A-Za-z_@$\x80-\xff]").match(self.s, self.i) else None
            return Node("splat", start, self.i, value=inner)
        if self.at("("):
            self.i += 1
            inner = []
            self.space()
            while not self.at(")"):
                inner.append(self.target())
                self.space()
                if self.at(","):
                    self.i += 1
                    self.space()
                elif not self.at(")"):
                    raise self.error("expected )")
            self.i += 1
            return Node("mlhs", start, self.i, items=inner)
        return self.primary(postfix_only=True)

    def declare(self, t: Node | None) -> None:
        if t is None:
            return
        if t.kind == "call" and t.recv is None and not t.args and t.name and t.name[0] in "abcdefghijklmnopqrstuvwxyz_":
            t.kind = "lvar"
        if t.kind == "lvar":
            self.locals[-1].add(t.name)
        elif t.kind == "splat":
            self.declare(t.value)
        elif t.kind == "mlhs":
            for x in t.items:
                self.declare(x)

    def splat_or_expression(self) -> Node:
        start = self.i
        if self.at("*") and not self.at("**"):
            self.i += 1
            return Node("splat", start, self.i, value=self.expression())
        return self.expression(commands=True)

    # -- expressions --------------------------------------------------------
    def expression(self, commands: bool = False) -> Node:
        self.space()
        start = self.i
        if self.at("*") and not self.at("**") and commands:
            self.i += 1
            return Node("splat", start, self.i, value=self.primary(postfix_only=True))
        left = self.ternary(commands)
        self.space()
        if self.at("=") and re.compile(r"=(?![=~>])").match(self.s, self.i) and left.kind in ("lvar", "call", "ivar", "gvar", "cvar", "const", "index"):
            return self.assign(left, None)
        m = ASSIGN_OP.match(self.s, self.i)
        if m and m.end() <= self.n and left.kind in ("lvar", "call", "ivar", "gvar", "cvar", "const", "index"):
            return self.assign(left, m.group(1))
        return left

    def assign(self, left: Node, op: str | None) -> Node:
        self.i += 1 + len(op or "")
        self.declare(left)
        self.space(lines=True)
        start = self.i
        value = self.splat_or_expression()
        self.space()
        if op is None and self.at(",") and not self.in_args:
            values = [value]
            while self.at(","):
                self.i += 1
                self.space(lines=True)
                values.append(self.splat_or_expression())
                self.space()
            value = Node("array", start, self.i, items=values)
        if self.keyword() == "rescue" and not self.in_args:
            self.i += 6
            value = Node("rescue_mod", start, self.i, body=value, rescue=self.expression(commands=True))
        return Node("asgn" if op is None else "opasgn", left.start, self.i, target=left, value=value, op=op)

    in_args = 0

    def ternary(self, commands: bool) -> Node:
        cond = self.binary(0, commands)
        self.space()
        if self.at("?") and not re.compile(r"\?[^\s]\b").match(self.s, self.i) or self.at("? "):
            self.i += 1
            self.space(lines=True)
            then = self.in_ternary()
            self.space(lines=True)
            self.take(":")
            self.space(lines=True)
            other = self.in_ternary()
            return Node("if", cond.start, self.i, cond=cond, then=then, other=other, ternary=True)
        return cond

    def in_ternary(self) -> Node:
        save, self.ternary_depth = self.ternary_depth, self.ternary_depth + 1
        try:
            return self.expression()
        finally:
            self.ternary_depth = save

    ternary_depth = 0

    def binary(self, least: int, commands: bool = False) -> Node:
        left = self.unary(commands)
        while True:
            self.space()
            if self.i >= self.n:
                return left
            for power, pattern in BINARY:
                if power < least:
                    continue
                m = pattern.match(self.s, self.i, self.n)
                if not m:
                    continue
                op = m.group()
                if op in ("|",) and self.no_pipe:
                    continue
                if ASSIGN_OP.match(self.s, self.i, self.n):
                    continue
                break
            else:
                return left
            at = self.i
            self.i = m.end()
            if power == 1:
                self.space()
                if self.i >= self.n or self.s[self.i] in "\n)];," or self.keyword() in ("then", "do"):
                    left = Node("range", left.start, self.i, left=left, right=None)
                    continue
            self.space(lines=True)
            right = self.binary(power if op == "**" else power + 1, commands and op in ("&&", "||"))
            if op in ("&&", "||"):
                left = Node("and" if op == "&&" else "or", left.start, self.i, left=left, right=right)
            elif power == 1:
                left = Node("range", left.start, self.i, left=left, right=right)
            else:
                left = Node("call", left.start, self.i, recv=left, name=op, args=[right], name_at=at, operator=True)

    no_pipe = 0

    def unary(self, commands: bool = False) -> Node:
        self.space()
        start = self.i
        c = self.s[self.i] if self.i < self.n else ""
        if c == "!":
            self.i += 1
            value = self.unary(commands)
            return Node("not", start, self.i, value=value)
        if c == "-" and re.compile(r"-\d").match(self.s, self.i):
            self.i += 1
            node = self.primary()
            node.start = start
            return node
        if c in "-+~" and c and not self.at("->"):
            self.i += 1
            value = self.binary(13)
            return Node("call", start, self.i, recv=value, name=c + "@" if c != "~" else "~", args=[], name_at=start, operator=True)
        if c == "&" and not self.at("&&"):
            self.i += 1
            value = self.unary() if re.compile(r"[^\s),]").match(self.s, self.i) else None
            return Node("blockpass", start, self.i, value=value)
        if self.at("**"):
            self.i += 2
            return Node("dsplat", start, self.i, value=self.unary() if re.compile(r"[^\s),]").match(self.s, self.i) else None)
        if c == "*":
            self.i += 1
            return Node("splat", start, self.i, value=self.unary() if re.compile(r"[^\s),]").match(self.s, self.i) else None)
        if self.at("..") :
            self.i += 3 if self.at("...") else 2
            return Node("range", start, self.i, left=None, right=self.binary(2) if re.compile(r"[^\s),]").match(self.s, self.i) else None)
        if self.keyword() == "defined?":
            self.i += 8
            self.space()
            return Node("defined", start, self.i, value=self.unary())
        return self.primary(commands=commands)

    # -- primaries ----------------------------------------------------------
    def primary(self, commands: bool = False, postfix_only: bool = False) -> Node:
        node = self.atom(commands)
        return self.postfix(node, commands)

    def postfix(self, node: Node, commands: bool) -> Node:
        s = self.s
        while self.i < self.n:
            c = s[self.i]
            if c == "(" and node.kind == "call" and node.args is None:
                raise self.error("unexpected (")
            if c == "[" and node.kind not in ("command",):
                start = self.i
                self.i += 1
                args = self.arguments("]")
                node = Node("call", node.start, self.i, recv=node, name="[]", args=args, name_at=start, index=True)
                node.kind = "index"
                continue
            if c == "{" and node.kind in ("call", "super", "lambda_call") and node.block is None and self.block_allowed(node):
                node.block = self.block("}")
                node.end = self.i
                continue
            m = re.compile(r"&?\.(?![.\d])|::(?=[A-Za-z_(\x80-\xff])").match(s, self.i, self.n)
            if m:
                self.i = m.end()
                node = self.after_dot(node, m.group(), commands)
                continue
            save = self.i
            self.space()
            if self.i < self.n and s[self.i] == "\n" and self.follows_line():
                continue
            if self.i < self.n and s[self.i] == "{" and node.kind in ("call", "super") and node.block is None and self.block_allowed(node) and save != self.i:
                node.block = self.block("}")
                node.end = self.i
                continue
            if self.keyword() == "do" and not self.no_do and node.kind in ("call", "super", "lambda") and node.block is None and node.body is None:
                self.i += 2
                node.block = self.block("end")
                node.end = self.i
                continue
            if re.compile(r"&?\.(?![.\d])").match(s, self.i, self.n) and self.i != save:
                continue
            self.i = save
            return node
        return node

    def block_allowed(self, node: Node) -> bool:
        return not node.operator and not (node.command and node.args)

    def after_dot(self, recv: Node, dot: str, commands: bool) -> Node:
        self.space(lines=True)
        at = self.i
        if self.at("("):
            self.i += 1
            return Node("call", recv.start, self.i, recv=recv, name="call", args=self.arguments(")"), name_at=at, safe=dot == "&.", paren=True)
        m = ANY_NAME.match(self.s, self.i) or OPERATOR_NAME.match(self.s, self.i)
        if not m or m.end() > self.n:
            raise self.error("expected a name")
        name = m.group()
        self.i = m.end()
        if name[0].isalpha() or name[0] == "_" or ord(name[0]) > 127:
            if self.i < self.n and self.s[self.i] in "?!" and not re.compile(r"[?!]=(?![=~>])").match(self.s, self.i):
                name += self.s[self.i]
                self.i += 1
        if dot == "::" and name[0].isupper() and not self.at("("):
            if not (commands and re.compile(r"[ \t]+[\"':@\w]").match(self.s, self.i) and not self.command_blocked()):
                return Node("const", recv.start, self.i, scope=recv, name=name, name_at=at)
            return Node("const", recv.start, self.i, scope=recv, name=name, name_at=at)
        return self.call_rest(Node("call", recv.start, self.i, recv=recv, name=name, args=[], name_at=at, safe=dot == "&."), commands)

    def command_blocked(self) -> bool:
        save = self.i
        self.space()
        w = self.keyword()
        self.i = save
        return w in ("if", "unless", "while", "until", "and", "or", "then", "do", "rescue", "in", "end", "else", "elsif", "when", "ensure")

    def call_rest(self, node: Node, commands: bool) -> Node:
        """Arguments of a call whose name was just read."""
        if self.at("("):
            self.i += 1
            node.args = self.arguments(")")
            node.paren = True
            node.end = self.i
            return node
        if self.command_starts(node):
            node.args = self.command_arguments()
            node.command = True
            node.end = self.i
        return node

    def command_starts(self, node: Node) -> bool:
        """Arguments without parentheses follow: a space, and what begins a value and is no operator."""
        m = re.compile(r"[ \t]+").match(self.s, self.i, self.n)
        if not m:
            return False
        j = m.end()
        if j >= self.n or self.command_blocked():
            return False
        c = self.s[j]
        after = self.s[j + 1] if j + 1 < self.n else "\n"
        if c.isalnum() or c in "_@$\"'`" or ord(c) > 127:
            return True
        if c == ":":
            return after not in " \t\n:" or after == ":" and j + 2 < self.n and self.s[j + 2].isupper()
        if c == "-":
            return after == ">" or after not in " \t\n="
        if c in "*&":
            return after not in " \t\n=&" or c == "*" and after == "*" and self.s[j + 2 : j + 3] not in " \t\n"
        if c == "[":
            return node.recv is None or after != "]" or True
        if c == "(":
            return True
        if c == "!":
            return after not in "=~"
        if c == "~":
            return after not in " \t\n"
        if c == "/":
            return after not in " \t\n="
        if c == "%":
            return re.compile(r"%[wWiIqQrs]?[\[({<|!/]").match(self.s, j, self.n) is not None and after not in " \t\n="
        if c == "<":
            return HEREDOC.match(self.s, j, self.n) is not None
        if c == "?":
            return re.compile(r"\?\S(?![A-Za-z0-9_])").match(self.s, j, self.n) is not None and not self.ternary_likely(j)
        if c == "{":
            return False
        if c == ".":
            return self.s.startswith("..", j) and after == "." and False
        return False

    def ternary_likely(self, j: int) -> bool:
        return self.s[j + 1 : j + 2] in " \t\n"

    def command_arguments(self) -> list[Node]:
        args = []
        self.space()
        save, self.in_args = self.in_args, self.in_args + 1
        try:
            while True:
                args.append(self.argument(commands=True))
                self.space()
                if not self.at(","):
                    break
                self.i += 1
                self.space(lines=True)
        finally:
            self.in_args = save
        return self.with_hash(args)

    def arguments(self, closer: str) -> list[Node]:
        """Arguments up to the closer, which is taken."""
        args = []
        save = self.no_do, self.in_args, self.no_pipe, self.no_in, self.ternary_depth
        self.no_do, self.in_args, self.no_pipe, self.no_in, self.ternary_depth = 0, self.in_args + 1, 0, 0, 0
        try:
            self.space(lines=True)
            while not self.at(closer):
                if self.i >= self.n:
                    raise self.error(f"expected {closer}")
                args.append(self.argument(commands=True))
                self.space(lines=True)
                if self.at(","):
                    self.i += 1
                    self.space(lines=True)
                elif not self.at(closer):
                    raise self.error(f"expected {closer}")
            self.i += len(closer)
        finally:
            self.no_do, self.in_args, self.no_pipe, self.no_in, self.ternary_depth = save
        return self.with_hash(args)

    @staticmethod
    def with_hash(args: list[Node]) -> list[Node]:
        """Pairs at the end of arguments are one hash."""
        pairs = [a for a in args if a.kind in ("pair", "dsplat")]
        if not pairs:
            return args
        rest = [a for a in args if a.kind not in ("pair", "dsplat", "blockpass")]
        blocks = [a for a in args if a.kind == "blockpass"]
        return [*rest, Node("hash", pairs[0].start, pairs[-1].end, pairs=pairs, bare=True), *blocks]

    LABEL = re.compile(r"([A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*[?!]?):(?!:)")
    QUOTED_LABEL = re.compile(r"\"((?:[^\"\\#\n]|\\.)*)\":(?!:)|'((?:[^'\\\n]|\\.)*)':(?!:)")

    def argument(self, commands: bool = False) -> Node:
        start = self.i
        m = self.LABEL.match(self.s, self.i, self.n) or self.QUOTED_LABEL.match(self.s, self.i, self.n)
        if m and not (self.ternary_depth and self.s[m.end() : m.end() + 1] not in (" ", "\n") and False):
            name = next(g for g in m.groups() if g is not None)
            self.i = m.end()
            key = Node("sym", start, self.i - 1, name=name, label=True)
            self.space()
            if self.i >= self.n or self.s[self.i] in ",)}]":
                return Node("pair", start, self.i, key=key, value=None)
            if self.s[self.i] == "\n":
                save = self.i
                self.space(lines=True)
                if self.i >= self.n or self.s[self.i] in ",)}]":
                    self.i = save
                    return Node("pair", start, self.i, key=key, value=None)
            value = self.no_comma_expression(commands)
            return Node("pair", start, self.i, key=key, value=value)
        value = self.no_comma_expression(commands)
        self.space()
        if self.at("=>"):
            self.i += 2
            self.space(lines=True)
            return Node("pair", start, self.i, key=value, value=self.no_comma_expression(commands))
        return value

    def no_comma_expression(self, commands: bool) -> Node:
        if self.keyword() == "not":
            return self.not_expression()
        node = self.expression(commands)
        self.space()
        if self.keyword() in ("if", "unless") and False:
            return node
        return node

    # -- atoms --------------------------------------------------------------
    def atom(self, commands: bool) -> Node:
        self.space()
        s, start = self.s, self.i
        if start >= self.n:
            raise self.error("unexpected end")
        c = s[start]
        w = self.keyword()
        if w:
            return self.keyword_atom(w, commands)
        if c in "0123456789":
            m = NUMBER.match(s, start)
            self.i = m.end()
            return Node("float" if re.search(r"[.eE]", m.group()) and not m.group().startswith("0x") else "int", start, self.i, text=m.group())
        if c == '"' or c == "`":
            self.i += 1
            return self.string(start, c, c, True, "str" if c == '"' else "xstr")
        if c == "'":
            self.i += 1
            return self.string(start, "'", "'", False, "str")
        if c == "@":
            m = re.compile(r"@@?[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*").match(s, start)
            if not m:
                raise self.error("unexpected @")
            self.i = m.end()
            return Node("cvar" if m.group().startswith("@@") else "ivar", start, self.i, name=m.group())
        if c == "$":
            m = re.compile(r"\$(?:[A-Za-z_][A-Za-z0-9_]*|-?.)").match(s, start)
            self.i = m.end()
            return Node("gvar", start, self.i, name=m.group())
        if self.at("::"):
            m = CONST.match(s, self.i + 2)
            if not m:
                raise self.error("unexpected ::")
            at, self.i = self.i + 2, m.end()
            return Node("const", start, self.i, scope=None, name=m.group(), top=True, name_at=at)
        if c == ":":
            return self.symbol()
        if c == "[":
            self.i += 1
            return Node("array", start, self.i, items=self.arguments("]"))
        if c == "{":
            self.i += 1
            items = self.arguments("}")
            pairs = [p for a in items for p in (a.pairs if a.kind == "hash" and a.bare else [a])]
            return Node("hash", start, self.i, pairs=pairs)
        if c == "(":
            self.i += 1
            save = self.no_do, self.in_args, self.no_pipe, self.no_in, self.ternary_depth
            self.no_do = self.in_args = self.no_pipe = self.no_in = self.ternary_depth = 0
            body = self.statements((), ")")
            self.no_do, self.in_args, self.no_pipe, self.no_in, self.ternary_depth = save
            self.take(")")
            return Node("paren", start, self.i, body=body)
        if self.at("->"):
            return self.lambda_()
        if c == "/":
            self.i += 1
            node = self.string(start, "/", "/", True, "regex")
            m = re.compile(r"[a-z]*").match(s, self.i)
            self.i = m.end()
            return node
        if c == "%":
            return self.percent()
        if self.at("<<"):
            m = HEREDOC.match(s, start, self.n)
            if m:
                self.i = m.end()
                word = next(g for g in m.groups()[1:] if g is not None)
                node = Node("str", start, self.i, parts=[""], heredoc=True)
                self.pending.append((word, bool(m.group(1)), m.group(4) is not None, node))
                return node
        if c == "?":
            m = re.compile(r"\?(?:\\.|[^\s\\])").match(s, start)
            if m:
                self.i = m.end()
                return Node("str", start, self.i, parts=[m.group()[1:]])
        m = CONST.match(s, start)
        if m:
            self.i = m.end()
            name = m.group()
            if self.i < self.n and s[self.i] in "?!" and re.compile(r"[?!](?![=~])").match(s, self.i) and not (s[self.i] == "?" and re.compile(r"\?[ \t\n]").match(s, self.i)):
                name += s[self.i]
                self.i += 1
                return self.call_rest(Node("call", start, self.i, recv=None, name=name, args=[], name_at=start), commands)
            if self.at("("):
                return self.call_rest(Node("call", start, self.i, recv=None, name=name, args=[], name_at=start), commands)
            if re.compile(r"[ \t]+[\"'](?!\s)").match(s, self.i, self.n):
                return self.call_rest(Node("call", start, self.i, recv=None, name=name, args=[], name_at=start), commands)
            return Node("const", start, self.i, scope=None, name=name, name_at=start)
        m = IDENT.match(s, start)
        if m:
            self.i = m.end()
            name = m.group()
            if self.i < self.n and s[self.i] in "?!" and re.compile(r"[?!](?!=(?![=~>]))").match(s, self.i):
                ternary = s[self.i] == "?" and self.known(name)
                if not ternary:
                    name += s[self.i]
                    self.i += 1
            if self.known(name) and not self.at("("):
                return Node("lvar", start, self.i, name=name)
            node = Node("call", start, self.i, recv=None, name=name, args=[], name_at=start)
            node = self.call_rest(node, commands)
            node.bare = not node.args and not node.paren
            return node
        raise self.error(f"unexpected {c!r}")

    def known(self, name: str) -> bool:
        return name in self.locals[-1]

    def symbol(self) -> Node:
        start = self.i
        s = self.s
        if s.startswith(':"', start):
            self.i += 2
            node = self.string(start, '"', '"', True, "sym")
            node.name = node.parts[0] if len(node.parts) == 1 and isinstance(node.parts[0], str) else ("" if not node.parts else None)
            return node
        if s.startswith(":'", start):
            self.i += 2
            node = self.string(start, "'", "'", False, "sym")
            node.name = node.parts[0] if node.parts else ""
            return node
        m = re.compile(r":(@{0,2}\$?[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*(?:[?!]|=(?![=~>]))?|" + OPERATOR_NAME.pattern + ")").match(s, start, self.n)
        if not m:
            raise self.error("unexpected :")
        self.i = m.end()
        return Node("sym", start, self.i, name=m.group(1))

    def lambda_(self) -> Node:
        start = self.i
        self.i += 2
        self.space()
        self.locals.append(set(self.locals[-1]))
        params = []
        if self.at("("):
            self.i += 1
            params = self.parameters(")")
            self.take(")")
        elif re.compile(r"[a-z_*&\x80-\xff]").match(self.s, self.i) and self.keyword() != "do":
            params = self.parameters("")
        self.space()
        if self.at("{"):
            self.i += 1
            body = self.inside("}")
            self.take("}")
        else:
            if self.keyword() != "do":
                raise self.error("expected a body")
            self.i += 2
            body = self.body(("end",))
            self.finish()
        self.locals.pop()
        return Node("lambda", start, self.i, params=params, body=body)

    def inside(self, closer: str) -> Node:
        save = self.no_do, self.in_args, self.no_pipe, self.no_in, self.ternary_depth
        self.no_do = self.in_args = self.no_pipe = self.no_in = self.ternary_depth = 0
        body = self.statements((), closer)
        self.no_do, self.in_args, self.no_pipe, self.no_in, self.ternary_depth = save
        return body

    def block(self, closer: str) -> Node:
        """A block; its opening brace stands here, or its do was taken."""
        start = self.i
        if closer == "}":
            self.i += 1
        self.locals.append(set(self.locals[-1]))
        self.space(lines=True)
        params = []
        if self.at("|") :
            self.i += 1
            if not self.at("|"):
                self.no_pipe += 1
                params = self.parameters("|")
                self.no_pipe -= 1
            self.take("|")
        body = self.inside("}") if closer == "}" else self.body(("end",))
        if closer == "}":
            self.take("}")
        else:
            self.finish()
        self.locals.pop()
        return Node("block", start, self.i, params=params, body=body)

    def string(self, start: int, opener: str, closer: str, live: bool, kind: str) -> Node:
        """From behind the opener to behind the closer."""
        s, begin, depth = self.s, self.i, 0
        i = begin
        while i < self.n:
            c = s[i]
            if c == "\\":
                i += 2
                continue
            if live and c == "#" and s.startswith("#{", i):
                i = self.skip_braces(i + 2)
                continue
            if c == closer and depth == 0:
                break
            if opener != closer and c == opener:
                depth += 1
            elif opener != closer and c == closer:
                depth -= 1
            i += 1
        if i >= self.n:
            raise self.error("unterminated string")
        parts = self.interpolated(begin, i) if live else [self.unescape(s[begin:i], False)]
        self.i = i + 1
        node = Node(kind, start, self.i, parts=parts)
        while kind == "str" and re.compile(r"[ \t]*(?:\\\r?\n[ \t]*)?[\"']").match(s, self.i, self.n) and not self.in_string:
            save = self.i
            self.space()
            q, at = s[self.i], self.i
            if self.QUOTED_LABEL.match(s, self.i, self.n):
                self.i = save
                break
            self.i += 1
            self.in_string += 1
            more = self.string(at, q, q, q == '"', "str")
            self.in_string -= 1
            node.parts = [*node.parts, *more.parts]
            node.end = self.i
        if len(node.parts) > 1 and all(isinstance(p, str) for p in node.parts):
            node.parts = ["".join(node.parts)]
        return node

    in_string = 0

    @staticmethod
    def unescape(text: str, live: bool) -> str:
        if "\\" not in text:
            return text
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "s": " ", "e": "\x1b", "0": "\0"}.get(m[1], m[1]) if live else (m[1] if m[1] in "\\'" else m[0]), text, flags=re.S)

    def skip_braces(self, i: int) -> int:
        depth = 1
        s = self.s
        while i < self.n and depth:
            c = s[i]
            if c == "\\":
                i += 1
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            elif c in "\"'" and depth:
                j = i + 1
                while j < self.n and s[j] != c and s[j] != "\n":
                    if s[j] == "\\":
                        j += 1
                    elif c == '"' and s.startswith("#{", j):
                        j = self.skip_braces(j + 2) - 1
                    j += 1
                if j < self.n and s[j] == c:
                    i = j
            i += 1
        return i

    def interpolated(self, begin: int, end: int) -> list:
        """Strings and nodes between two offsets."""
        parts, at, i, s = [], begin, begin, self.s
        while i < end:
            if s[i] == "\\":
                i += 2
                continue
            if s.startswith("#{", i):
                if i > at:
                    parts.append(self.unescape(s[at:i], True))
                stop = self.skip_braces(i + 2)
                save = self.i, self.n, self.pending
                self.i, self.n, self.pending = i + 2, max(i + 2, min(stop - 1, self.n)), []
                body = self.inside("")
                self.i, self.n, self.pending = save
                parts.append(body)
                at = i = stop
                continue
            i += 1
        if end > at:
            parts.append(self.unescape(s[at:end], True))
        return parts

    def percent(self) -> Node:
        start = self.i
        m = re.compile(r"%([wWiIqQrsx]?)([^\sA-Za-z0-9])").match(self.s, start, self.n)
        if not m:
            raise self.error("unexpected %")
        kind, opener = m.group(1), m.group(2)
        closer = CLOSERS.get(opener, opener)
        self.i = m.end()
        if kind in ("w", "W", "i", "I") and kind:
            node = self.string(start, opener, closer, False, "words")
            items = []
            at = m.end()
            for x in re.finditer(r"(?:\\.|\S)+", self.s[at : self.i - 1]):
                where = at + x.start()
                items.append(Node("sym" if kind in "iI" else "str", where, at + x.end(), **({"name": x.group()} if kind in "iI" else {"parts": [x.group()]})))
            return Node("array", start, node.end, items=items)
        node = self.string(start, opener, closer, kind not in ("q", "s"), {"r": "regex", "s": "sym", "x": "xstr"}.get(kind, "str"))
        if kind == "r":
            self.i = re.compile(r"[a-z]*").match(self.s, self.i).end()
        if kind == "s":
            node.name = node.parts[0] if node.parts else ""
        return node

    # -- keywords -----------------------------------------------------------
    def keyword_atom(self, w: str, commands: bool) -> Node:
        start = self.i
        if w in ("nil", "true", "false", "self", "redo", "retry", "__FILE__", "__LINE__", "__ENCODING__"):
            self.i += len(w)
            return Node(w if w in ("nil", "true", "false", "self", "redo", "retry") else "str", start, self.i, parts=[])
        if w == "__method__":
            self.i += len(w)
            return Node("call", start, self.i, recv=None, name=w, args=[], name_at=start)
        method = getattr(self, f"kw_{w.lower().rstrip('?')}", None)
        if method is None:
            raise self.error(f"unexpected {w}")
        self.i += len(w)
        save = self.no_do, self.in_args, self.no_pipe, self.no_in, self.ternary_depth
        if w in ("def", "class", "module", "begin", "if", "unless", "while", "until", "case", "for"):
            self.in_args = self.no_pipe = self.no_in = self.ternary_depth = 0
            self.no_do = 0
        try:
            return method(start)
        finally:
            self.no_do, self.in_args, self.no_pipe, self.no_in, self.ternary_depth = save

    def finish(self) -> None:
        self.space("all")
        if self.keyword() != "end":
            raise self.error("expected end")
        self.i += 3

    def then(self) -> None:
        self.space("all")
        if self.keyword() == "then":
            self.i += 4

    def body(self, ends: tuple[str, ...]) -> Node:
        """Statements with rescue, else and ensure clauses; the end is not taken."""
        start = self.i
        main = self.statements(("rescue", "else", "ensure", *ends))
        rescues, other, ensure = [], None, None
        while self.keyword() == "rescue":
            at = self.i
            self.i += 6
            self.space()
            classes, name = [], None
            while self.i < self.n and self.s[self.i] not in "\n;" and self.keyword() != "then" and not self.at("=>"):
                classes.append(self.splat_or_ternary())
                self.space()
                if self.at(","):
                    self.i += 1
                    self.space(lines=True)
                elif not self.at("=>"):
                    break
            if self.at("=>"):
                self.i += 2
                self.space()
                name = self.target()
                self.declare(name)
            self.then()
            rescues.append(Node("rescue", at, self.i, classes=classes, name=name, body=self.statements(("rescue", "else", "ensure", *ends))))
        if self.keyword() == "else":
            self.i += 4
            other = self.statements(("ensure", *ends))
        if self.keyword() == "ensure":
            self.i += 6
            ensure = self.statements(ends)
        if not rescues and other is None and ensure is None:
            return main
        return Node("begin", start, self.i, body=main, rescues=rescues, other=other, ensure=ensure)

    def splat_or_ternary(self) -> Node:
        start = self.i
        if self.at("*"):
            self.i += 1
            return Node("splat", start, self.i, value=self.ternary(False))
        return self.ternary(False)

    def kw_begin(self, start: int) -> Node:
        if self.s[start] == "B":
            return self.kw_end_block(start)
        body = self.body(("end",))
        self.finish()
        return Node("paren", start, self.i, body=body, begin=True)

    def kw_end_block(self, start: int) -> Node:
        self.space()
        self.take("{")
        body = self.inside("}")
        self.take("}")
        return Node("paren", start, self.i, body=body)

    kw_end = kw_end_block

    def condition(self) -> Node:
        self.no_do += 1
        cond = self.expression_statement()
        self.no_do -= 1
        return cond

    def kw_if(self, start: int) -> Node:
        cond = self.expression_statement()
        self.then()
        then = self.statements(("elsif", "else", "end"))
        other = None
        self.space("all")
        if self.keyword() == "elsif":
            at = self.i
            self.i += 5
            return Node("if", start, self.i, cond=cond, then=then, other=self.kw_if(at))
        if self.keyword() == "else":
            self.i += 4
            other = self.statements(("end",))
        self.finish()
        return Node("if", start, self.i, cond=cond, then=then, other=other)

    def kw_unless(self, start: int) -> Node:
        cond = self.expression_statement()
        self.then()
        body = self.statements(("else", "end"))
        other = None
        if self.keyword() == "else":
            self.i += 4
            other = self.statements(("end",))
        self.finish()
        return Node("if", start, self.i, cond=cond, then=other, other=body)

    def kw_while(self, start: int) -> Node:
        cond = self.condition()
        self.space("all")
        if self.keyword() == "do":
            self.i += 2
        body = self.statements(("end",))
        self.finish()
        return Node("while", start, self.i, cond=cond, body=body)

    kw_until = kw_while

    def kw_for(self, start: int) -> Node:
        self.space()
        self.no_in += 1
        targets = [self.target()]
        self.space()
        while self.at(","):
            self.i += 1
            self.space()
            targets.append(self.target())
            self.space()
        self.no_in -= 1
        for t in targets:
            self.declare(t)
        if self.keyword() != "in":
            raise self.error("expected in")
        self.i += 2
        value = self.condition()
        self.space("all")
        if self.keyword() == "do":
            self.i += 2
        body = self.statements(("end",))
        self.finish()
        return Node("while", start, self.i, cond=value, body=body, targets=targets)

    def kw_case(self, start: int) -> Node:
        self.space()
        value = None
        if self.i < self.n and self.s[self.i] not in "\n;":
            self.no_in += 1
            value = self.expression_statement()
            self.no_in -= 1
        branches, other = [], None
        self.space("all")
        while self.keyword() in ("when", "in"):
            w, at = self.keyword(), self.i
            self.i += len(w)
            self.space(lines=True)
            tests, guard = [], None
            if w == "when":
                while True:
                    tests.append(self.splat_or_ternary())
                    self.space()
                    if not self.at(","):
                        break
                    self.i += 1
                    self.space(lines=True)
            else:
                tests.append(self.pattern())
                self.space()
                if self.keyword() in ("if", "unless"):
                    self.i += len(self.keyword())
                    guard = self.expression_statement()
            self.then()
            branches.append(Node("when", at, self.i, tests=tests, guard=guard, body=self.statements(("when", "in", "else", "end"))))
            self.space("all")
        if self.keyword() == "else":
            self.i += 4
            other = self.statements(("end",))
        self.finish()
        return Node("case", start, self.i, value=value, branches=branches, other=other)

    def pattern(self) -> Node:
        """A pattern, read for the constants in it and the names that it binds."""
        start, depth, items = self.i, 0, []
        self.space()
        while self.i < self.n:
            c = self.s[self.i]
            if c in "([{":
                depth += 1
                self.i += 1
            elif c in ")]}":
                if not depth:
                    break
                depth -= 1
                self.i += 1
            elif c in "\n;" and not depth or self.keyword() in ("then", "if", "unless", "and", "or") and not depth:
                break
            elif c in "\n;":
                self.space("all")
            elif c in " \t\r,|*^&":
                self.i += 1
            elif self.at("=>"):
                self.i += 2
            elif m := self.LABEL.match(self.s, self.i, self.n):
                self.i = m.end()
                save = self.i
                self.space()
                if self.i >= self.n or self.s[self.i] in ",}])\n;" or self.keyword() in ("then", "if", "unless"):
                    self.locals[-1].add(m.group(1))
                    self.i = save
            elif m := CONST.match(self.s, self.i):
                node = self.atom(False)
                while m2 := re.compile(r"::([A-Z]\w*)").match(self.s, self.i, self.n):
                    self.i = m2.end()
                    node = Node("const", node.start, self.i, scope=node, name=m2.group(1), name_at=m2.start(1))
                items.append(node)
            elif (m := IDENT.match(self.s, self.i)) and not self.keyword():
                self.i = m.end()
                self.locals[-1].add(m.group())
            elif c in ".-+":
                self.i += 1
            else:
                items.append(self.atom(False))
        return Node("pattern", start, self.i, items=items)

    def kw_def(self, start: int) -> Node:
        self.space(lines=True)
        at, s = self.i, self.s
        singleton = None
        m = re.compile(r"(self|[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*|@{1,2}\w+|\([^)\n]*\))[ \t]*(?:\.|::)[ \t]*").match(s, self.i, self.n)
        if m:
            text = m.group(1)
            kind = "self" if text == "self" else "const" if text[0].isupper() else "lvar" if self.known(text) else "ivar" if text[0] == "@" else "call"
            singleton = Node(kind, self.i, m.end(1), name=text, recv=None, args=[], name_at=self.i)
            self.i = m.end()
            at = self.i
        m = re.compile(r"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*(?:[?!]|=(?![=~>(]|\s)|=(?=\())?").match(s, self.i, self.n) or OPERATOR_NAME.match(s, self.i, self.n)
        if not m:
            raise self.error("expected a name")
        name = m.group()
        self.i = m.end()
        self.locals.append(set())
        try:
            self.space()
            params = []
            if self.at("("):
                self.i += 1
                params = self.parameters(")")
                self.take(")")
            elif self.i < self.n and s[self.i] not in "\n;=" and self.keyword() != "rescue":
                params = self.parameters("")
            self.space()
            if self.at("=") and not self.at("=="):
                self.i += 1
                self.space(lines=True)
                body = self.statement_in_def()
                return Node("def", start, self.i, name=name, params=params, body=body, singleton=singleton, name_at=at, endless=True)
            body = self.body(("end",))
            self.finish()
        finally:
            self.locals.pop()
        return Node("def", start, self.i, name=name, params=params, body=body, singleton=singleton, name_at=at)

    def statement_in_def(self) -> Node:
        node = self.expression(commands=True)
        self.space()
        if self.keyword() == "rescue":
            self.i += 6
            node = Node("rescue_mod", node.start, self.i, body=node, rescue=self.expression(commands=True))
        return node

    def parameters(self, closer: str) -> list[Node]:
        """Parameters up to the closer, or to the end of the line; the closer is not taken."""
        out, seen_rest = [], False
        save, self.in_args = self.in_args, self.in_args + 1
        while True:
            self.space(lines=bool(closer))
            if closer and self.at(closer) or self.i >= self.n or not closer and self.s[self.i] in "\n;{" or not closer and self.keyword() == "do":
                break
            start = self.i
            if self.at(";"):
                self.i += 1
                self.space()
                while m := IDENT.match(self.s, self.i):
                    self.locals[-1].add(m.group())
                    self.i = m.end()
                    self.space()
                    if self.at(","):
                        self.i += 1
                        self.space()
                continue
            if self.at("..."):
                self.i += 3
                out.append(Node("param", start, self.i, role="rest", name="..."))
            elif m := re.compile(r"(\*\*nil|\*\*|\*|&)([A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)?").match(self.s, self.i, self.n):
                self.i = m.end()
                role = {"*": "rest", "**": "keyrest", "&": "block", "**nil": "nokey"}[m.group(1)]
                seen_rest = seen_rest or role == "rest"
                if m.group(2):
                    self.locals[-1].add(m.group(2))
                out.append(Node("param", start, self.i, role=role, name=m.group(2) or ""))
            elif self.at("("):
                inner = self.target()
                self.declare(inner)
                out.append(Node("param", start, self.i, role="post" if seen_rest else "req", name="", inner=inner))
            elif m := self.LABEL.match(self.s, self.i, self.n):
                self.i = m.end()
                self.locals[-1].add(m.group(1))
                self.space()
                default = None
                if self.i < self.n and self.s[self.i] not in ",)|\n;":
                    default = self.ternary(False)
                out.append(Node("param", start, self.i, role="keyreq" if default is None else "key", name=m.group(1), default=default))
            elif m := IDENT.match(self.s, self.i, self.n):
                self.i = m.end()
                name = m.group()
                self.locals[-1].add(name)
                self.space()
                if self.at("=") and not self.at("=="):
                    self.i += 1
                    default = self.ternary(False)
                    out.append(Node("param", start, self.i, role="opt", name=name, default=default))
                else:
                    out.append(Node("param", start, m.end(), role="post" if seen_rest or any(p.role == "opt" for p in out) else "req", name=name))
            else:
                self.in_args = save
                raise self.error("unexpected in parameters")
            self.space(lines=bool(closer))
            if self.at(","):
                self.i += 1
                if not closer:
                    self.space(lines=True)
            elif not (closer and self.at(closer)) and not self.at(";"):
                if closer:
                    self.in_args = save
                    raise self.error(f"expected {closer}")
                break
        self.in_args = save
        return out

    def path(self) -> Node:
        self.space()
        start = self.i
        top = self.at("::")
        if top:
            self.i += 2
        node = None
        while m := CONST.match(self.s, self.i):
            at, self.i = self.i, m.end()
            node = Node("const", start, self.i, scope=node, name=m.group(), top=top and node is None, name_at=at)
            if not re.compile(r"::(?=[A-Z])").match(self.s, self.i):
                break
            self.i += 2
        if node is None:
            raise self.error("expected a constant")
        return node

    def kw_class(self, start: int) -> Node:
        self.space()
        if self.at("<<"):
            self.i += 2
            value = self.expression()
            self.locals.append(set())
            body = self.body(("end",))
            self.locals.pop()
            self.finish()
            return Node("sclass", start, self.i, value=value, body=body)
        name, parent = self.path(), None
        self.space()
        if self.at("<"):
            self.i += 1
            self.space()
            parent = self.expression(commands=True)
        self.locals.append(set())
        body = self.body(("end",))
        self.locals.pop()
        self.finish()
        return Node("class", start, self.i, path=name, parent=parent, body=body)

    def kw_module(self, start: int) -> Node:
        name = self.path()
        self.locals.append(set())
        body = self.body(("end",))
        self.locals.pop()
        self.finish()
        return Node("module", start, self.i, path=name, body=body)

    def jump(self, kind: str, start: int) -> Node:
        self.space()
        value = None
        if self.i < self.n and self.s[self.i] not in "\n;)}]" and not self.command_blocked() and not self.at("?") and not self.at(":"):
            value = Node("array", self.i, self.i, items=self.command_arguments())
            value.end = self.i
        return Node(kind, start, self.i, value=value)

    def kw_return(self, start: int) -> Node:
        return self.jump("return", start)

    def kw_break(self, start: int) -> Node:
        return self.jump("break", start)

    def kw_next(self, start: int) -> Node:
        return self.jump("next", start)

    def kw_super(self, start: int) -> Node:
        node = Node("super", start, self.i, args=None, name_at=start)
        if self.at("("):
            self.i += 1
            node.args, node.paren = self.arguments(")"), True
        elif self.command_starts(Node("call", start, self.i, recv=None)):
            node.args, node.command = self.command_arguments(), True
        node.end = self.i
        return node

    def kw_yield(self, start: int) -> Node:
        node = Node("yield", start, self.i, args=[])
        if self.at("("):
            self.i += 1
            node.args = self.arguments(")")
        elif self.command_starts(Node("call", start, self.i, recv=Node("nil", 0, 0))):
            node.args = self.command_arguments()
        node.end = self.i
        return node

    def method_name(self) -> Node:
        self.space(lines=True)
        if self.at(":"):
            return self.symbol()
        m = re.compile(r"\$\S+|[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*(?:[?!]|=(?![=~>]))?").match(self.s, self.i, self.n) or OPERATOR_NAME.match(self.s, self.i, self.n)
        if not m:
            raise self.error("expected a name")
        at, self.i = self.i, m.end()
        return Node("sym", at, self.i, name=m.group())

    def kw_alias(self, start: int) -> Node:
        new, old = self.method_name(), self.method_name()
        return Node("alias", start, self.i, new=new, old=old)

    def kw_undef(self, start: int) -> Node:
        names = [self.method_name()]
        self.space()
        while self.at(","):
            self.i += 1
            names.append(self.method_name())
            self.space()
        return Node("undef", start, self.i, names=names)


def parse(source: bytes) -> tuple[Node, Parser]:
    """The tree and the parser that made it (for places and errors); never raises on any bytes."""
    parser = Parser(source)
    try:
        tree = parser.program()
    except (Stop, RecursionError, IndexError, ValueError, AttributeError, TypeError) as stop:
        parser.errors.append((parser.i, str(stop)))
        tree = Node("seq", 0, parser.n, body=[])
    return tree, parser
