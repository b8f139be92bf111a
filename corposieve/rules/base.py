"""The registry of rules, and what rules over syntax trees share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from corposieve.model import KINDS, SEVERITIES
from corposieve.syntax.lexer import Token
from corposieve.syntax.parser import Node, RustFile, _Parser


@dataclass(frozen=True)
class Rule:
    id: str  # noqa: A003
    kind: str
    severity: str
    description: str
    check: Callable
    default: bool = True
    fixable: bool = False
    params: dict[str, object] = field(default_factory=dict)
    pack: str = "builtin"


class Registry:
    """Rules by id. ``extend`` adds a pack whole or not at all."""

    def __init__(self, rules: Iterable[Rule] = ()) -> None:
        self.rules: dict[str, Rule] = {}
        self.packs: dict[str, tuple[str, str]] = {}
        for r in rules:
            self.add(r)

    def add(self, r: Rule) -> None:
        if r.id in self.rules:
            raise ValueError(f"rule {r.id} is registered twice")
        if r.kind not in KINDS or r.severity not in SEVERITIES:
            raise ValueError(f"rule {r.id} has an unknown kind or severity")
        for name, value in r.params.items():
            ok = isinstance(value, bool) or (isinstance(value, int) and value >= 0) or (isinstance(value, list) and all(isinstance(x, str) for x in value) and len(set(value)) == len(value))
            if not ok:
                raise ValueError(f"parameter {name} of {r.id} must be a bool, an integer from 0 or a list of different strings")
        self.rules[r.id] = r

    def extend(self, pack: str, version: str, fingerprint: str, rules: Iterable[Rule]) -> None:
        if pack == "builtin" or pack in self.packs:
            raise ValueError(f"pack name {pack} is taken")
        if not re.fullmatch(r"\d+\.\d+\.\d+(?:[-+].+)?", version) or not fingerprint:
            raise ValueError("a pack needs a semantic version and a fingerprint")
        trial = Registry(self.rules.values())
        for r in rules:
            trial.add(r)
        self.rules = dict(sorted(trial.rules.items()))
        self.packs[pack] = (version, fingerprint)


BUILTIN = Registry()


def rule(id: str, kind: str, severity: str, description: str, default: bool = True, fixable: bool = False, **params):  # noqa: A002
    def register(f: Callable) -> Callable:
        BUILTIN.add(Rule(id, kind, severity, description, f, default, fixable, params))
        return f

    return register


def ast(id: str, severity: str, description: str, default: bool = True, fixable: bool = False, **params):  # noqa: A002
    """Register ``f(file, params)``, which yields (node or line, message)."""
    return rule(id, "rust-ast", severity, description, default, fixable, **params)


# trees


def attr_args(a: Node) -> list[list[Token]]:
    """Top-level comma-separated arguments of ``name(...)``."""
    body = [t for t in a.tokens if True]
    text = a.compact_body
    if "(" not in text:
        return []
    k = next(i for i, t in enumerate(body) if t.text == "(")
    return split_commas(body[k + 1 : -2])


def split_commas(tokens: list[Token]) -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        if t.kind == "punct" and t.text in "([{":
            depth += 1
        elif t.kind == "punct" and t.text in ")]}":
            depth -= 1
        if t.text == "," and t.kind == "punct" and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    if not out[-1]:
        out.pop()
    return out


def joined(tokens: Iterable[Token]) -> str:
    return "".join(t.text for t in tokens)


def attrs(n: Node) -> list[Node]:
    return [a for a in (n.attrs or []) if a.kind == "Attr"]


def docs(n: Node) -> list[str]:
    return [line for a in (n.attrs or []) if a.kind == "Doc" for line in a.doc.split("\n")]


def has_attr(n: Node, *names: str) -> bool:
    return any(a.name in names or a.name.rpartition("::")[2] in names for a in attrs(n))


def derives(n: Node) -> list[str]:
    return [joined(x) for a in attrs(n) if a.name == "derive" for x in attr_args(a)]


def derived(n: Node, name: str) -> bool:
    return any(d.rpartition("::")[2] == name for d in derives(n))


def requires_test(body: str) -> bool:
    """Whether a ``cfg`` predicate holds only under test."""
    m = re.match(r"(\w+)\((.*)\)$", body)
    if not m:
        return body == "test"
    parts, depth, at = [], 0, 0
    inner = m.group(2)
    for i, c in enumerate(inner):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(inner[at:i])
            at = i + 1
    parts = [p for p in [*parts, inner[at:]] if p]
    if m.group(1) == "all":
        return any(map(requires_test, parts))
    if m.group(1) == "any":
        return bool(parts) and all(map(requires_test, parts))
    return False


def is_test_item(n: Node) -> bool:
    for a in attrs(n):
        if a.name == "test" or a.name.endswith("::test"):
            return True
        if a.name == "cfg" and requires_test(re.sub(r"^cfg\((.*?),?\)$", r"\1", a.compact_body)):
            return True
    return False


def in_test(n: Node) -> bool:
    if n.file.test_only:
        return True
    while n is not None:
        if n.f.get("attrs") and is_test_item(n):
            return True
        n = n.parent
    return False


def strip(t: Node | None) -> Node | None:
    """A type without parentheses."""
    while t is not None and t.kind == "ParenType":
        t = t.type
    return t


def last_of(t: Node | None) -> str:
    t = strip(t)
    return t.last_name if t is not None and t.kind == "PathType" else ""


def referent(t: Node | None) -> Node | None:
    t = strip(t)
    while t is not None and t.kind == "RefType":
        t = strip(t.type)
    return t


def args_of(t: Node | None) -> list[Node]:
    t = strip(t)
    return [a for a in (t.args or []) if a.kind not in ("ConstArg", "AssocArg")] if t is not None and t.kind == "PathType" else []


def owner(n: Node) -> Node | None:
    """The impl, trait or extern block that holds an associated item."""
    p = n.parent
    return p if p is not None and p.kind in ("Impl", "Trait", "ExternBlock") else None


def inherent(n: Node) -> Node | None:
    p = owner(n)
    return p if p is not None and p.kind == "Impl" and p.trait is None else None


def nearest_fn(n: Node) -> Node | None:
    return n.nearest("Fn")


def public(n: Node) -> bool:
    return n.vis == "pub"


def result_args(t: Node | None) -> list[Node] | None:
    return args_of(t) if last_of(t) == "Result" else None


def returns_self(f: Node, ty: str) -> bool:
    def mentions(t: Node | None) -> bool:
        t = strip(t)
        return t is not None and t.kind == "PathType" and (t.last_name in ("Self", ty) or any(mentions(a) for a in args_of(t)[:1]) and t.last_name in ("Result", "Option"))

    return mentions(f.ret)


def preceded(file: RustFile, line: int, *marks: str) -> bool:
    for i in range(line - 2, max(-1, line - 5), -1):
        t = file.lines[i].strip()
        if not t:
            continue
        if not t.startswith("//"):
            return False
        if any(m in t for m in marks):
            return True
    return False


def callee(n: Node) -> list[str]:
    """Path segments of a call's callee."""
    c = n.callee
    return list(c.names) if c is not None and c.kind == "PathExpr" else []


def bare(e: Node | None) -> Node | None:
    while e is not None and e.kind == "ParenExpr":
        e = e.expr
    return e


def macro_args(m: Node) -> list[list[Token]]:
    return split_commas(m.body)


def parse_expr(file_text: str) -> Node | None:
    f = RustFile("fn f(){ let _ = " + file_text + "; }")
    lets = f.of("LetStmt")
    return None if f.errors or not lets else lets[0].value


def string_value(token: str) -> str:
    m = re.match(r'[bc]?r(#*)"(.*)"\1$', token, re.S)
    if m:
        return m.group(2)
    body = token[token.index('"') + 1 : -1]
    return re.sub(r"\\(?:\n\s*|u\{([0-9a-fA-F_]+)\}|x([0-9a-fA-F]{2})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2], 16)) if m[2] else {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[3], m[3] or ""), body, flags=re.S)


def uses(file: RustFile) -> dict[str, str | None]:
    """Names that ``use`` brings in to their full path; a name brought in twice is None."""
    out: dict[str, str | None] = {}

    def go(tree: Node, before: list[str]) -> None:
        path = before + tree.path
        for c in tree.children_:
            go(c, path)
        if not tree.children_ and not tree.star and path:
            if path[-1] == "self":
                path = path[:-1]
            name = tree.alias or (path[-1] if path else "")
            full = "::".join(path)
            out[name] = full if out.get(name, full) == full else None

    for u in file.of("Use"):
        go(u.tree, [])
    return out


def leaves(tree: Node, before: list[str] | None = None) -> Iterator[tuple[list[str], bool, str | None, Node]]:
    path = (before or []) + tree.path
    for c in tree.children_:
        yield from leaves(c, path)
    if not tree.children_:
        yield path, tree.star, tree.alias, tree


def nonblank(text: str) -> int:
    return sum(1 for x in text.split("\n") if x.strip())


def camel(name: str) -> list[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [w for w in re.split(r"[ _]+", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", spaced)) if w]


SIZES = {"bool": 1, "u8": 1, "i8": 1, "u16": 2, "i16": 2, "u32": 4, "i32": 4, "f32": 4, "char": 4, "u64": 8, "i64": 8, "f64": 8, "usize": 8, "isize": 8, "u128": 16, "i128": 16, "String": 24, "Vec": 24, "Box": 8, "Arc": 8, "Rc": 8}


def int_value(e: Node | None) -> int | None:
    e = bare(e)
    if e is None or e.kind != "Literal" or e.lit != "num":
        return None
    m = re.match(r"(0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|[\d_]+)(?:[ui](?:8|16|32|64|128|size))?$", e.value)
    return int(m.group(1).replace("_", ""), 0) if m and (m.group(1).replace("_", "") == "0" or not re.match(r"0\d", m.group(1))) else (int(m.group(1).replace("_", "")) if m else None)


def size_of(t: Node | None) -> int | None:
    t = strip(t)
    if t is None:
        return None
    if t.kind == "PathType":
        if t.last_name == "Option":
            inner = size_of(args_of(t)[0]) if args_of(t) else None
            return inner
        return SIZES.get(t.last_name)
    if t.kind == "ArrayType":
        n, each = int_value(t.size), size_of(t.type)
        return None if n is None or each is None else n * each
    if t.kind == "TupleType":
        parts = [size_of(x) for x in t.types]
        return None if None in parts else sum(parts)
    if t.kind in ("RefType", "PtrType"):
        inner = strip(t.type)
        return 16 if inner is not None and (inner.kind in ("SliceType", "DynTraitType") or last_of(inner) == "str") else 8
    if t.kind == "FnPtrType":
        return 8
    return None


def public_types(file: RustFile, fields: bool = True) -> Iterator[tuple[Node, Node]]:
    """(type, item) of parameters and returns of public functions and of public fields of public structs."""
    for f in file.of("Fn"):
        if public(f) and not in_test(f):
            for p in f.params:
                if p.type is not None:
                    yield p.type, f
            if f.ret is not None:
                yield f.ret, f
    if fields:
        for s in file.of("Struct"):
            if public(s) and not in_test(s):
                for x in s.fields:
                    if x.vis == "pub":
                        yield x.type, s


__all__ = ["Node", "RustFile", "_Parser"]
