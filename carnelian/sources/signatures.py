"""RBS signatures as stub Ruby, which goes through the extractor like any source."""

from __future__ import annotations

import re

def _split(text: str, mark: str) -> list[str]:
    """Parts between marks that stand outside brackets."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c in "([{") - (c in ")]}")
        if c == mark and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def params_of(written: str) -> list[tuple[str, str]]:
    """(kind, name) of an RBS parameter list."""
    out, rest = [], False
    for k, p in enumerate(x.strip() for x in _split(written, ",")):
        if not p:
            continue
        words = re.findall(r"[A-Za-z_]\w*", p)
        name = words[-1] if len(words) > 1 and words[-1][0].islower() else f"a{k}"
        if p.startswith("**"):
            out.append(("keyrest", name))
        elif p.startswith("*"):
            out.append(("rest", name))
            rest = True
        elif m := re.match(r"(\?)?([a-z_]\w*):\s", p + " "):
            out.append(("key" if m[1] else "keyreq", m[2]))
        elif p.startswith("?"):
            out.append(("opt", name))
        else:
            out.append(("post" if rest else "req", name))
    return out


def class_of(written: str) -> str | None:
    """The class of a return type, where it is one class."""
    written = written.strip().rstrip("?")
    if _split(written, "|")[1:]:
        return None
    m = re.match(r"(::)?[A-Z]\w*(::[A-Z]\w*)*", written)
    return {"bool": None, "void": None}.get(written, m.group() if m else None)


def overloads(written: str) -> list[tuple[list[tuple[str, str]], bool, str | None]]:
    """(params, whether a block is taken, returned class) of each overload."""
    out = []
    for one in re.split(r"\n\s*\|\s*|(?<=[\w\])?])\s+\|\s+(?=\()", written):
        one = re.sub(r"^\s*\[[^\]]*\]\s*", "", one.strip())
        m = re.match(r"(?:\((?P<p>(?:[^()]|\([^()]*\))*)\))?\s*(?P<b>\??\{.*?\}\s*)?->\s*(?P<r>.+)$", one, re.S)
        if m:
            out.append((params_of(m["p"] or ""), bool(m["b"]), class_of(m["r"])))
    return out


def _param(kind: str, name: str) -> str:
    return {"req": name, "post": name, "opt": f"{name} = nil", "rest": f"*{name}", "keyreq": f"{name}:", "key": f"{name}: nil", "keyrest": f"**{name}"}[kind]


def to_stubs(source: str) -> str:
    """Ruby that declares what an RBS file declares: a sig where all overloads return one class."""
    out, depth = [], 0
    lines = re.sub(r"#[^\n]*", "", source).split("\n")
    i = 0
    while i < len(lines):
        line = lines[i].strip()
        while i + 1 < len(lines) and re.match(r"\s*\|", lines[i + 1]):
            i += 1
            line += "\n" + lines[i].strip()
        if m := re.match(r"(class|module|interface)\s+([\w:]+)(?:\[[^\]]*\])?(?:\s*<\s*([\w:]+))?(?:\s*:\s*[^\n]*)?", line):
            out.append("  " * depth + f"{'module' if m[1] != 'class' else 'class'} {m[2].lstrip('_')}" + (f" < {m[3]}" if m[3] and m[1] == "class" else ""))
            depth += 1
        elif line == "end":
            depth = max(0, depth - 1)
            out.append("  " * depth + "end")
        elif m := re.match(r"(include|extend|prepend)\s+([\w:]+)", line):
            out.append("  " * depth + f"{m[1]} {m[2]}")
        elif m := re.match(r"alias\s+(\S+)\s+(\S+)", line):
            out.append("  " * depth + f"alias {m[1]} {m[2]}")
        elif m := re.match(r"attr_(reader|writer|accessor)\s+(\w+)", line):
            out.append("  " * depth + f"attr_{m[1]} :{m[2]}")
        elif m := re.match(r"(?:private\s+|public\s+)?def\s+(self\??\.)?([^\s:]+(?:::)?)\s*:\s*(.+)$", line, re.S):
            ways = overloads(m[3])
            returned = {r for _, _, r in ways}
            widest = max((p for p, _, _ in ways), key=len, default=[])
            least = min((sum(k in ("req", "post") for k, _ in p) for p, _, _ in ways), default=0)
            listed = ", ".join(_param("opt" if k == "req" and n >= least else k, name if [x for _, x in widest].count(name) == 1 else f"{name}{n}") for n, (k, name) in enumerate(widest))
            block = ", &block" if any(b for _, b, _ in ways) and listed else "&block" if any(b for _, b, _ in ways) else ""
            if len(returned) == 1 and None not in returned:
                out.append("  " * depth + f"sig {{ returns({returned.copy().pop()}) }}")
            out.append("  " * depth + f"def {'self.' if m[1] else ''}{m[2].strip('`')}({listed}{block}); end")
        elif m := re.match(r"([A-Z]\w*)\s*:\s*([\w:]+)", line):
            out.append("  " * depth + f"{m[1]} = nil")
        i += 1
    return "\n".join(out) + "\n"
