"""A parser for Rust that gives a tree of nodes in pre-order; broken input gives what could be parsed and errors."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import cached_property

from corposieve.syntax.lexer import Token, code_only, tokenize

ITEMS = ("Fn", "Impl", "Struct", "Enum", "Union", "Trait", "TypeAlias", "Const", "Static", "Use", "Module", "MacroRules", "ExternBlock", "ExternCrate")
_BINARY = {
    "*": 11, "/": 11, "%": 11, "+": 10, "-": 10, "<<": 9, ">>": 9, "&": 8, "^": 7, "|": 6, "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "&&": 4, "||": 3, "..": 2, "..=": 2,
    "=": 1, "+=": 1, "-=": 1, "*=": 1, "/=": 1, "%=": 1, "^=": 1, "&=": 1, "|=": 1, "<<=": 1, ">>=": 1,
}
_BLOCKLIKE = ("IfExpr", "MatchExpr", "ForExpr", "WhileExpr", "LoopExpr", "BlockExpr")


class Node:
    __slots__ = ("kind", "first", "last", "parent", "children", "f", "file", "pre", "end_pre")

    def __init__(self, kind: str, first: int) -> None:
        self.kind, self.first, self.last, self.parent, self.children, self.f = kind, first, first, None, [], {}

    def __getattr__(self, name: str):
        try:
            return self.f[name]
        except KeyError:
            return None

    @property
    def text(self) -> str:
        t = self.file.tokens
        return self.file.text[t[self.first].start : t[max(self.first, self.last - 1)].end] if self.last > self.first else ""

    @property
    def compact(self) -> str:
        return "".join(x.text for x in self.file.tokens[self.first : self.last])

    @property
    def tokens(self) -> list[Token]:
        return self.file.tokens[self.first : self.last]

    @property
    def line(self) -> int:
        return self.file.line_at(self.start)

    @property
    def start(self) -> int:
        t = self.file.tokens
        return t[self.first].start if self.first < len(t) else len(self.file.text)

    @property
    def end(self) -> int:
        return self.file.tokens[self.last - 1].end if self.last else 0

    @property
    def end_line(self) -> int:
        return self.file.line_at(max(self.start, self.end - 1))

    def all(self, *kinds: str) -> Iterator[Node]:
        for n in self.file.nodes[self.pre + 1 : self.end_pre]:
            if not kinds or n.kind in kinds:
                yield n

    def up(self, *kinds: str) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            if not kinds or n.kind in kinds:
                yield n
            n = n.parent

    def nearest(self, *kinds: str) -> Node | None:
        return next(self.up(*kinds), None)


class Broken(Exception):
    pass


class RustFile:
    """Tree and lines of one source."""

    def __init__(self, text: str, rel: str = "src/lib.rs", package: str | None = None, test_only: bool = False) -> None:
        self.text, self.rel, self.package, self.test_only = text, rel, package, test_only
        self.every, errors = tokenize(text)
        self.tokens = [t for t in self.every if t.kind != "comment"]
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.lines = [x.removesuffix("\r") for x in text.split("\n")]
        if self.lines and self.lines[-1] == "":
            self.lines.pop()
        self.errors = list(errors)
        self.root = _Parser(self).source_file()
        self.nodes: list[Node] = []
        self._number(self.root)

    def _number(self, root: Node) -> None:
        stack: list[tuple[Node, bool]] = [(root, False)]
        while stack:
            n, done = stack.pop()
            if done:
                n.end_pre = len(self.nodes)
                continue
            n.file, n.pre = self, len(self.nodes)
            self.nodes.append(n)
            stack.append((n, True))
            for c in reversed(n.children):
                c.parent = n
                stack.append((c, False))

    def line_at(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)

    def column_at(self, offset: int) -> int:
        return len(self.text[self.starts[self.line_at(offset) - 1] : offset].encode()) + 1

    def of(self, *kinds: str) -> list[Node]:
        if len(kinds) == 1:
            return list(self.by_kind.get(kinds[0], ()))
        return sorted((n for k in {*kinds} for n in self.by_kind.get(k, ())), key=lambda n: n.pre)

    @cached_property
    def by_kind(self) -> dict[str, list[Node]]:
        out: dict[str, list[Node]] = {}
        for n in self.nodes:
            out.setdefault(n.kind, []).append(n)
        return out

    @cached_property
    def code(self) -> list[str]:
        return code_only(self.text, self.every).split("\n")


class _Parser:
    def __init__(self, file: RustFile) -> None:
        self.file, self.t, self.i, self.n = file, file.tokens, 0, len(file.tokens)
        self.split = 0

    # tokens
    def at(self, *texts: str) -> bool:
        return self.i < self.n and self.t[self.i].text in texts and self.t[self.i].kind in ("punct", "ident")

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k].text if self.i + k < self.n else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k].kind if self.i + k < self.n else ""

    def eat(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if self.at(text):
            self.i += 1
            return
        # split a doubled sign, as in Vec<Vec<u8>> or &&x
        if self.i < self.n and self.t[self.i].kind == "punct" and self.peek().startswith(text) and len(self.peek()) > len(text):
            t = self.t[self.i]
            self.t[self.i : self.i + 1] = [Token("punct", text, t.start, t.start + len(text)), Token("punct", t.text[len(text) :], t.start + len(text), t.end)]
            self.n += 1
            self.i += 1
            return
        raise Broken(f"expected {text!r} before {self.peek()!r}")

    def starts(self, text: str) -> bool:
        return self.i < self.n and self.t[self.i].kind == "punct" and self.peek().startswith(text)

    def ident(self) -> str:
        if self.kind() != "ident":
            raise Broken(f"expected a name before {self.peek()!r}")
        self.i += 1
        return self.t[self.i - 1].text.removeprefix("r#")

    def node(self, kind: str, first: int | None = None) -> Node:
        return Node(kind, self.i if first is None else first)

    def done(self, n: Node, *children: Node | None, **f) -> Node:
        n.last = self.i
        n.children = [c for c in children if c is not None]
        n.children.sort(key=lambda c: (c.first, -c.last))
        n.f.update(f)
        return n

    def skip_tree(self) -> None:
        """One token or one bracketed group."""
        depth = 0
        while self.i < self.n:
            x, k = self.peek(), self.kind()
            if k == "punct" and x in "([{":
                depth += 1
            elif k == "punct" and x in ")]}":
                depth -= 1
            self.i += 1
            if depth <= 0:
                return
        raise Broken("a bracket doesn't close")

    # file and items
    def source_file(self) -> Node:
        root, items = self.node("SourceFile"), []
        while self.i < self.n:
            before = self.i
            try:
                items += [x for x in [self.item()] if x is not None]
            except (Broken, RecursionError, IndexError) as e:
                self.file_error(e)
                self.i = max(before + 1, self.i)
        return self.done(root, *items, items=items)

    def file_error(self, e: Exception) -> None:
        self.file.errors.append(str(e))

    def attrs(self) -> list[Node]:
        out = []
        while True:
            if self.kind() == "doc":
                a = self.node("Doc")
                self.i += 1
                text = self.t[self.i - 1].text
                inner = text.startswith(("//!", "/*!"))
                out.append(self.done(a, doc=re.sub(r"^(///|//!|/\*\*|/\*!)|\*/$", "", text), inner=inner))
            elif self.at("#") and self.peek(1) in ("[", "!"):
                if self.peek(1) == "!" and self.peek(2) != "[":
                    return out
                a = self.node("Attr")
                inner = self.peek(1) == "!"
                self.i += 1 + inner
                first = self.i
                self.skip_tree()
                body = self.t[first + 1 : self.i - 1]
                out.append(self.done(a, inner=inner, name=_attr_name(body), body=" ".join(x.text for x in body), compact_body="".join(x.text for x in body)))
            else:
                return out

    def visibility(self) -> str:
        if self.at("pub"):
            self.i += 1
            if self.at("(") and self.peek(1) in ("crate", "super", "self", "in"):
                first = self.i
                self.skip_tree()
                return "pub" + "".join(x.text for x in self.t[first : self.i])
            return "pub"
        return ""

    def item(self, scope: str = "file") -> Node | None:
        first = self.i
        attrs = self.attrs()
        inner = [a for a in attrs if a.f["inner"]]
        if inner and inner == attrs[: len(inner)]:  # they belong to what encloses the item
            self.i = inner[-1].last
            return self.done(self.node("Attrs", first), *inner)
        if self.i >= self.n or (self.at("}") and scope != "file"):
            if attrs:
                n = self.node("Attrs", first)
                return self.done(n, *attrs)
            return None
        vis_at = self.i
        vis = self.visibility()
        flags = set()
        head = self.i
        while self.at("default", "const", "async", "unsafe", "extern", "safe", "auto") and not (self.at("const") and not (self.peek(1) in ("fn", "unsafe", "async", "extern"))):
            if self.at("extern"):
                if self.peek(1) == "crate":
                    break
                self.i += 1
                abi = "C"
                if self.kind() == "str":
                    abi = self.peek().strip('"')
                    self.i += 1
                flags.add("extern")
                if self.at("{"):
                    return self.extern_block(first, attrs, abi, flags)
                flags.add("abi:" + abi)
                continue
            if self.at("default", "safe", "auto") and self.peek(1) not in ("fn", "unsafe", "async", "const", "impl", "type", "trait", "extern"):
                break
            if self.at("unsafe") and self.peek(1) == "{":
                break
            flags.add(self.peek())
            self.i += 1
        word = self.peek()
        common = {"vis": vis, "attrs": attrs, "flags": flags, "abi": next((x[4:] for x in flags if x.startswith("abi:")), None), "vis_at": vis_at}
        made = {"fn": self.fn, "struct": self.struct, "enum": self.enum, "impl": self.impl, "trait": self.trait, "use": self.use, "mod": self.mod, "type": self.alias, "const": self.const, "static": self.const}.get(word)
        if word == "union" and self.kind(1) == "ident":
            made = self.struct
        if word == "macro_rules" and self.peek(1) == "!":
            n = self.node("MacroRules", first)
            self.i += 2
            name = self.ident()
            brace = self.at("{")
            self.skip_tree()
            if not brace:
                self.eat(";")
            return self.done(n, *attrs, name=name, **common)
        if word == "extern":
            n = self.node("ExternCrate", first)
            while self.i < self.n and not self.at(";"):
                self.i += 1
            self.need(";")
            return self.done(n, *attrs, **common)
        if made:
            n = self.node("Item", first)
            return made(n, attrs, common)
        self.i = head
        if self.kind() == "ident" and not vis:
            path_end = self.i
            k = self.i
            while k + 1 < self.n and self.t[k].kind == "ident" and self.t[k + 1].text == "::":
                k += 2
            if k + 1 < self.n and self.t[k + 1].text == "!" and self.t[k + 1].start >= 0:
                m = self.macro(first)
                m.children = [*attrs, *m.children]
                m.f["attrs"] = attrs
                if not m.f["brace"]:
                    self.eat(";")
                    m.last = self.i
                return m
            self.i = path_end
        if self.eat(";"):
            return None
        raise Broken(f"no item starts with {self.peek()!r}" + (" after an attribute" if inner else ""))

    def extern_block(self, first: int, attrs: list[Node], abi: str, flags: set) -> Node:
        n = self.node("ExternBlock", first)
        items = self.body("extern")
        return self.done(n, *attrs, *items, items=items, abi=abi, attrs=attrs, flags=flags, vis="")

    def body(self, scope: str) -> list[Node]:
        self.need("{")
        out = []
        while not self.at("}"):
            if self.i >= self.n:
                raise Broken("a body doesn't close")
            x = self.item(scope)
            if x is not None:
                out.append(x)
        self.need("}")
        return out

    def generics(self) -> list[Node]:
        out: list[Node] = []
        if not self.at("<"):
            return out
        self.need("<")
        while not self.starts(">"):
            self.attrs()
            p = self.node("TypeParam")
            if self.kind() == "life":
                self.i += 1
                if self.eat(":"):
                    while self.kind() == "life" or self.at("+"):
                        self.i += 1
                p.kind = "LifetimeParam"
                out.append(self.done(p))
            elif self.eat("const"):
                p.kind = "ConstParam"
                name = self.ident()
                self.need(":")
                t = self.type()
                if self.eat("="):
                    self.skip_tree()
                out.append(self.done(p, t, name=name))
            else:
                name = self.ident()
                bounds, default = [], None
                if self.eat(":"):
                    bounds = self.bounds()
                if self.eat("="):
                    default = self.type()
                out.append(self.done(p, *bounds, default, name=name, bounds=bounds, default=default))
            if not self.eat(","):
                break
        self.need(">")
        return out

    def bounds(self) -> list[Node]:
        out = []
        while True:
            if self.kind() == "life":
                self.i += 1
            elif self.at("("):
                self.i += 1
                out += self.bounds()
                self.need(")")
            elif self.at("?", "~") or self.kind() == "ident" or self.at("::", "<", "for"):
                n = self.node("Bound")
                while self.at("?", "~", "const", "async"):
                    self.i += 1
                if self.eat("for"):
                    self.generics()
                if self.peek() == "use" and self.peek(1) == "<":
                    self.i += 1
                    self.generics()
                    out.append(self.done(n, path=None))
                else:
                    p = self.path()
                    out.append(self.done(n, p, path=p))
            else:
                break
            if not self.eat("+"):
                break
        return out

    def where(self) -> list[Node]:
        out = []
        if self.eat("where"):
            while not self.at("{", ";", "=") and self.i < self.n:
                n = self.node("WherePred")
                if self.kind() == "life":
                    self.i += 1
                    self.need(":")
                    self.bounds()
                    out.append(self.done(n, bounds=[]))
                else:
                    if self.eat("for"):
                        self.generics()
                    t = self.type()
                    self.need(":")
                    b = self.bounds()
                    out.append(self.done(n, t, *b, type=t, bounds=b))
                if not self.eat(","):
                    break
        return out

    def fn(self, n: Node, attrs: list[Node], common: dict) -> Node:
        n.kind = "Fn"
        self.need("fn")
        name_at = self.i
        name = self.ident()
        generics = self.generics()
        self.need("(")
        params, self_param = [], None
        while not self.at(")"):
            p = self.node("Param")
            pa = self.attrs()
            k = self.i
            while self.at("&", "mut") or self.kind() == "life":
                self.i += 1
            if self.at("self"):
                self.i += 1
                t = self.type() if self.eat(":") else None
                p.kind = "SelfParam"
                sign = self.t[k : self.i]
                self_param = self.done(p, t, type=t, is_ref=sign[0].text == "&", is_mut=any(x.text == "mut" for x in sign) and sign[0].text == "&")
            else:
                self.i = k
                if self.at("..."):
                    self.i += 1
                    self.done(p)
                else:
                    pat = self.pattern()
                    self.need(":")
                    t = self.type()
                    params.append(self.done(p, *pa, pat, t, pat=pat, type=t, name=pat.compact_name()))
            if not self.eat(","):
                break
        self.need(")")
        ret = self.type() if self.eat("->") else None
        where = self.where()
        block = None
        if self.at("{"):
            block = self.block()
        else:
            self.need(";")
        return self.done(n, *attrs, *generics, self_param, *params, ret, *where, block, name=name, name_at=name_at, generics=generics, params=params, self_param=self_param, ret=ret, where=where, body=block, **common)

    def struct(self, n: Node, attrs: list[Node], common: dict) -> Node:
        n.kind = "Union" if self.at("union") else "Struct"
        self.i += 1
        name_at = self.i
        name = self.ident()
        generics, where = self.generics(), self.where()
        fields = []
        if self.at("{"):
            fields = self.record_fields()
        elif self.at("("):
            fields = self.tuple_fields()
            where += self.where()
            self.need(";")
        else:
            self.need(";")
        return self.done(n, *attrs, *generics, *where, *fields, name=name, name_at=name_at, generics=generics, where=where, fields=fields, **common)

    def record_fields(self) -> list[Node]:
        self.need("{")
        out = []
        while not self.at("}"):
            f = self.node("RecordField")
            a = self.attrs()
            vis = self.visibility()
            name = self.ident()
            self.need(":")
            t = self.type()
            if self.eat("="):
                self.expr()
            out.append(self.done(f, *a, t, name=name, type=t, vis=vis, attrs=a))
            if not self.eat(","):
                break
        self.need("}")
        return out

    def tuple_fields(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.at(")"):
            f = self.node("TupleField")
            a = self.attrs()
            vis = self.visibility()
            t = self.type()
            out.append(self.done(f, *a, t, type=t, vis=vis, attrs=a, name=str(len(out))))
            if not self.eat(","):
                break
        self.need(")")
        return out

    def enum(self, n: Node, attrs: list[Node], common: dict) -> Node:
        n.kind = "Enum"
        self.need("enum")
        name_at = self.i
        name = self.ident()
        generics, where = self.generics(), self.where()
        self.need("{")
        variants = []
        while not self.at("}"):
            v = self.node("Variant")
            a = self.attrs()
            self.visibility()
            vn = self.ident()
            fields = self.record_fields() if self.at("{") else self.tuple_fields() if self.at("(") else []
            value = self.expr() if self.eat("=") else None
            variants.append(self.done(v, *a, *fields, value, name=vn, fields=fields, attrs=a))
            if not self.eat(","):
                break
        self.need("}")
        return self.done(n, *attrs, *generics, *where, *variants, name=name, name_at=name_at, generics=generics, where=where, variants=variants, **common)

    def impl(self, n: Node, attrs: list[Node], common: dict) -> Node:
        n.kind = "Impl"
        self.need("impl")
        generics = self.generics() if self.at("<") and (self.peek(1) in (">", "const", "#") or self.kind(1) == "life" or (self.kind(1) == "ident" and self.peek(2) in (":", ",", ">", "="))) else []
        self.eat("const")
        negative = self.eat("!")
        t = self.type()
        trait = None
        if self.eat("for"):
            trait, t = t, self.type()
        where = self.where()
        items = self.body("impl")
        return self.done(n, *attrs, *generics, trait, t, *where, *items, generics=generics, trait=trait, type=t, where=where, items=items, negative=negative, **common)

    def trait(self, n: Node, attrs: list[Node], common: dict) -> Node:
        n.kind = "Trait"
        self.need("trait")
        name_at = self.i
        name = self.ident()
        generics = self.generics()
        bounds = self.bounds() if self.eat(":") else []
        where = self.where()
        if self.eat("="):
            bounds = self.bounds()
            self.need(";")
            return self.done(n, *attrs, *generics, *bounds, name=name, name_at=name_at, generics=generics, items=[], **common)
        items = self.body("trait")
        return self.done(n, *attrs, *generics, *bounds, *where, *items, name=name, name_at=name_at, generics=generics, items=items, **common)

    def use(self, n: Node, attrs: list[Node], common: dict) -> Node:
        n.kind = "Use"
        self.need("use")
        tree = self.use_tree()
        self.need(";")
        return self.done(n, *attrs, tree, tree=tree, **common)

    def use_tree(self) -> Node:
        n, path, children, star, alias = self.node("UseTree"), [], [], False, None
        self.eat("::")
        while True:
            if self.at("*"):
                self.i += 1
                star = True
                break
            if self.at("{"):
                self.i += 1
                while not self.at("}"):
                    children.append(self.use_tree())
                    if not self.eat(","):
                        break
                self.need("}")
                break
            path.append(self.ident())
            if not self.eat("::"):
                break
        if self.eat("as"):
            alias = self.ident()
        return self.done(n, *children, path=path, children_=children, star=star, alias=alias)

    def mod(self, n: Node, attrs: list[Node], common: dict) -> Node:
        n.kind = "Module"
        self.need("mod")
        name = self.ident()
        items = None
        if self.at("{"):
            items = self.body("mod")
        else:
            self.need(";")
        return self.done(n, *attrs, *(items or []), name=name, items=items, **common)

    def alias(self, n: Node, attrs: list[Node], common: dict) -> Node:
        n.kind = "TypeAlias"
        self.need("type")
        name = self.ident()
        generics = self.generics()
        bounds = self.bounds() if self.eat(":") else []
        where = self.where()
        t = self.type() if self.eat("=") else None
        where += self.where()
        self.need(";")
        return self.done(n, *attrs, *generics, *bounds, t, *where, name=name, type=t, generics=generics, **common)

    def const(self, n: Node, attrs: list[Node], common: dict) -> Node:
        n.kind = "Const" if self.at("const") else "Static"
        self.i += 1
        mut = self.eat("mut")
        name = self.ident()
        t = self.type() if self.eat(":") else None
        value = self.expr() if self.eat("=") else None
        self.need(";")
        return self.done(n, *attrs, t, value, name=name, type=t, value=value, mut=mut, **common)

    # types and paths
    def type(self) -> Node:  # noqa: A003
        n = self.node("Type")
        if self.starts("&"):
            self.need("&")
            if self.kind() == "life":
                self.i += 1
            mut = self.eat("mut")
            t = self.type()
            n.kind = "RefType"
            return self.done(n, t, type=t, mut=mut)
        if self.at("*"):
            self.i += 1
            mut = self.peek() == "mut"
            if not self.eat("const", "mut"):
                raise Broken("a pointer type needs const or mut")
            t = self.type()
            n.kind = "PtrType"
            return self.done(n, t, type=t, mut=mut)
        if self.at("["):
            self.i += 1
            t = self.type()
            if self.eat(";"):
                size = self.expr()
                self.need("]")
                n.kind = "ArrayType"
                return self.done(n, t, size, type=t, size=size)
            self.need("]")
            n.kind = "SliceType"
            return self.done(n, t, type=t)
        if self.at("("):
            self.i += 1
            ts = []
            comma = False
            while not self.at(")"):
                ts.append(self.type())
                comma = self.eat(",")
                if not comma:
                    break
            self.need(")")
            n.kind = "TupleType" if len(ts) != 1 or comma else "ParenType"
            return self.done(n, *ts, types=ts, type=ts[0] if n.kind == "ParenType" else None)
        if self.at("!"):
            self.i += 1
            n.kind = "NeverType"
            return self.done(n)
        if self.at("_"):
            self.i += 1
            n.kind = "InferType"
            return self.done(n)
        if self.at("dyn", "impl") and not (self.at("dyn") and self.peek(1) == "::"):
            n.kind = "DynTraitType" if self.at("dyn") else "ImplTraitType"
            self.i += 1
            b = self.bounds()
            return self.done(n, *b, bounds=b)
        if self.at("for"):
            self.i += 1
            self.generics()
            t = self.type()
            t.first = n.first
            return t
        if self.at("fn", "unsafe", "extern") or (self.at("unsafe") and self.peek(1) in ("fn", "extern")):
            while not self.at("fn"):
                self.i += 1
                if self.kind() == "str":
                    self.i += 1
            self.need("fn")
            self.need("(")
            ps = []
            while not self.at(")"):
                self.attrs()
                if self.kind() == "ident" and self.peek(1) == ":":
                    self.i += 2
                if self.at("..."):
                    self.i += 1
                else:
                    ps.append(self.type())
                if not self.eat(","):
                    break
            self.need(")")
            ret = self.type() if self.eat("->") else None
            n.kind = "FnPtrType"
            return self.done(n, *ps, ret, params=ps, ret=ret)
        p = self.path(types=True)
        if self.at("!") and self.peek(1) in ("(", "[", "{"):
            self.i += 1
            self.skip_tree()
            n.kind = "MacroType"
            return self.done(n, p)
        n.kind = "PathType"
        out = self.done(n, p, path=p, last=p.f["names"][-1] if p.f["names"] else "", args=p.f["args"])
        out.f["last_name"] = out.f.pop("last")
        return out

    def path(self, types: bool = True) -> Node:
        n, names, args, qself, every = self.node("Path"), [], [], None, []
        if self.starts("<") and self.at("<", "<<"):
            self.need("<")
            qself = self.type()
            if self.eat("as"):
                every.append(self.path())
            self.need(">")
            self.need("::")
        else:
            self.eat("::")
        while True:
            if self.kind() != "ident":
                raise Broken(f"expected a path before {self.peek()!r}")
            names.append(self.ident())
            args = []
            if self.at("::") and self.peek(1) in ("<", "<<"):
                self.i += 1
                args = self.generic_args()
            elif types and self.starts("<") and not self.at("<=", "<<="):
                args = self.generic_args()
            elif types and self.at("(") and names[-1] in ("Fn", "FnMut", "FnOnce", "AsyncFn", "AsyncFnMut", "AsyncFnOnce"):
                self.i += 1
                while not self.at(")"):
                    args.append(self.type())
                    if not self.eat(","):
                        break
                self.need(")")
                if self.eat("->"):
                    args.append(self.type())
            every += args
            if self.at("::") and (self.kind(1) == "ident"):
                self.i += 1
                continue
            break
        return self.done(n, qself, *every, names=names, args=args, qself=qself, every=every)

    def generic_args(self) -> list[Node]:
        self.need("<")
        out = []
        while not self.starts(">"):
            if self.kind() == "life":
                self.i += 1
            elif self.kind() in ("num", "str", "char") or self.at("-", "true", "false"):
                self.eat("-")
                a = self.node("ConstArg")
                self.i += 1
                out.append(self.done(a))
            elif self.at("{"):
                a = self.node("ConstArg")
                self.skip_tree()
                out.append(self.done(a))
            elif self.kind() == "ident" and self.peek(1) in ("=", ":"):
                a = self.node("AssocArg")
                name = self.ident()
                if self.eat("="):
                    t = self.type() if self.kind() not in ("num",) else None
                    if t is None:
                        self.i += 1
                    out.append(self.done(a, t, name=name, type=t))
                else:
                    self.need(":")
                    out.append(self.done(a, *self.bounds(), name=name))
            else:
                out.append(self.type())
            if not self.eat(","):
                break
        self.need(">")
        return out

    # patterns
    def pattern(self) -> Node:
        n = self.node("Pat")
        self.eat("|")
        parts = [self.pattern_one()]
        while self.at("|"):
            self.i += 1
            parts.append(self.pattern_one())
        if len(parts) == 1:
            return parts[0]
        n.kind = "OrPat"
        return self.done(n, *parts)

    def pattern_one(self) -> Node:
        n, kids = self.node("Pat"), []
        if self.starts("&"):
            self.need("&")
            self.eat("mut")
            kids.append(self.pattern_one())
            n.kind = "RefPat"
            return self.done(n, *kids)
        if self.at("_"):
            self.i += 1
            n.kind = "WildPat"
            return self.done(n)
        if self.at("("):
            self.i += 1
            while not self.at(")"):
                kids.append(self.pattern())
                if not self.eat(","):
                    break
            self.need(")")
            n.kind = "TuplePat"
            return self.done(n, *kids)
        if self.at("["):
            self.i += 1
            while not self.at("]"):
                kids.append(self.pattern())
                if not self.eat(","):
                    break
            self.need("]")
            n.kind = "SlicePat"
            return self.done(n, *kids)
        if self.at("..", "..="):
            self.i += 1
            if self.kind() in ("num", "char", "str", "ident") or self.at("-"):
                self.eat("-")
                if self.kind() == "ident":
                    self.path()
                else:
                    self.i += 1
            n.kind = "RestPat"
            return self.done(n)
        if self.kind() in ("num", "char", "str") or self.at("-", "true", "false"):
            lit = self.node("Literal")
            neg = self.eat("-")
            self.i += 1
            self.done(lit, value=self.t[self.i - 1].text, lit=self.t[self.i - 1].kind, neg=neg)
            n.kind = "LiteralPat"
            if self.at("..", "..=", "..."):
                self.i += 1
                if self.kind() in ("num", "char") or self.at("-"):
                    self.eat("-")
                    self.i += 1
                elif self.kind() == "ident":
                    self.path()
            return self.done(n, lit)
        if self.at("box", "const") and self.peek(1) == "{":
            self.i += 1
            self.skip_tree()
            return self.done(n)
        ref = mut = False
        if self.at("ref") and self.kind(1) == "ident":
            ref = self.eat("ref")
        if self.at("mut"):
            mut = self.eat("mut")
        if self.kind() == "ident" and self.peek(1) not in ("::", "(", "{", "!", "<") or ref or mut:
            name = self.ident()
            if self.eat("@"):
                kids.append(self.pattern_one())
            elif self.at("..", "..=", "..."):
                self.i += 1
                if self.kind() in ("num", "char"):
                    self.i += 1
                elif self.kind() == "ident":
                    self.path()
                n.kind = "RangePat"
                return self.done(n)
            n.kind = "IdentPat"
            return self.done(n, *kids, name=name, mut=mut, ref=ref)
        p = self.path(types=False)
        kids.append(p)
        n.kind = "PathPat"
        if self.at("!"):
            self.i += 1
            self.skip_tree()
        elif self.at("("):
            n.kind = "TupleStructPat"
            self.i += 1
            while not self.at(")"):
                kids.append(self.pattern())
                if not self.eat(","):
                    break
            self.need(")")
        elif self.at("{"):
            n.kind = "RecordPat"
            self.i += 1
            while not self.at("}"):
                self.attrs()
                if self.at(".."):
                    self.i += 1
                elif self.kind() in ("ident", "num") and self.peek(1) == ":":
                    self.i += 2
                    kids.append(self.pattern())
                else:
                    kids.append(self.pattern_one())
                if not self.eat(","):
                    break
            self.need("}")
        elif self.at("..", "..="):
            self.i += 1
            if self.kind() == "ident":
                self.path(types=False)
            elif self.kind() in ("num", "char"):
                self.i += 1
        return self.done(n, *kids, path=p)

    # statements and expressions
    def block(self, first: int | None = None, **f) -> Node:
        n = self.node("BlockExpr", first)
        body = self.node("StmtList")
        self.need("{")
        inner = []
        while (self.at("#") and self.peek(1) == "!") or (self.kind() == "doc" and self.peek().startswith(("//!", "/*!"))):
            got = self.attrs()
            inner += got
            if not got:
                break
        stmts, tail = [], None
        while not self.at("}"):
            if self.i >= self.n:
                raise Broken("a block doesn't close")
            if self.eat(";"):
                continue
            s = self.statement()
            stmts.append(s)
            if s.kind not in ("LetStmt", "ExprStmt") and s.kind not in ITEMS and self.at("}") and not s.f.get("semi"):
                tail = s
        self.need("}")
        self.done(body, *stmts, stmts=stmts, tail=tail)
        return self.done(n, *inner, body, list=body, stmts=stmts, tail=tail, **f)

    def item_here(self) -> bool:
        a, b = self.peek(), self.peek(1)
        if self.kind() != "ident":
            return False
        if a in ("fn", "struct", "enum", "trait", "mod", "use", "static", "type", "impl", "pub"):
            return True
        if a == "const":
            return b != "{" and not (b in ("move", "|", "||"))
        if a == "unsafe":
            return b in ("fn", "impl", "trait", "extern")
        if a == "extern":
            return True
        if a == "async":
            return b == "fn" or (b == "unsafe" and self.peek(2) == "fn")
        if a == "union":
            return self.kind(1) == "ident" and self.peek(2) in ("{", "<")
        return a == "macro_rules" and b == "!"

    def statement(self) -> Node:
        first = self.i
        attrs = self.attrs()
        if self.at("}"):
            return self.done(self.node("Attrs", first), *attrs)
        if self.item_here():
            self.i = first
            x = self.item("block")
            return x if x is not None else self.done(self.node("Empty", first))
        if self.at("let"):
            n = self.node("LetStmt", first)
            self.i += 1
            pat = self.pattern()
            t = self.type() if self.eat(":") else None
            value = self.expr() if self.eat("=") else None
            other = self.block() if self.eat("else") else None
            self.need(";")
            return self.done(n, *attrs, pat, t, value, other, pat=pat, type=t, value=value, attrs=attrs, otherwise=other)
        at = self.i
        e = self.expr(statement=True)
        e_attrs = attrs
        if self.at(";"):
            n = self.node("ExprStmt", first)
            self.i += 1
            return self.done(n, *e_attrs, e, expr=e, attrs=attrs)
        if e.kind in _BLOCKLIKE or (e.kind == "MacroCall" and e.f["brace"]) or self.at("}"):
            if not self.at("}") or e_attrs:
                n = self.node("ExprStmt", first)
                return self.done(n, *e_attrs, e, expr=e, attrs=attrs, bare=True) if not self.at("}") else e
            return e
        raise Broken(f"expected ';' before {self.peek()!r} at {at}")

    def expr(self, least: int = 0, struct: bool = True, statement: bool = False) -> Node:
        first = self.i
        if self.at("..", "..="):
            n = self.node("RangeExpr")
            op = self.peek()
            self.i += 1
            end = None if self.range_ends(struct) else self.expr(3, struct)
            left = self.done(n, end, lo=None, hi=end, op=op)
        else:
            self.attrs()
            left = self.unary(struct)
            if statement and left.kind in _BLOCKLIKE and not self.at(".", "?"):
                return left
            left = self.postfix(left, first, struct, statement)
            if statement and left.kind in _BLOCKLIKE:
                return left
        while self.i < self.n:
            if self.at("as"):
                self.i += 1
                t = self.type()
                left = self.done(self.node("CastExpr", first), left, t, expr=left, type=t)
                continue
            op = self.peek()
            if self.kind() != "punct" or op not in _BINARY or _BINARY[op] <= least - (1 if _BINARY[op] == 1 else 0):
                break
            power = _BINARY[op]
            if power == 1 and least > 1:
                break
            self.i += 1
            if power == 2:
                right = None if self.range_ends(struct) else self.expr(3, struct)
                left = self.done(self.node("RangeExpr", first), left, right, lo=left, hi=right, op=op)
                continue
            right = self.expr(power if power > 1 else 0, struct)
            left = self.done(self.node("BinExpr", first), left, right, op=op, lhs=left, rhs=right)
        return left

    def range_ends(self, struct: bool) -> bool:
        return self.at(")", "]", "}", ",", ";", "=>") or (not struct and self.at("{")) or self.i >= self.n

    def args(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.at(")"):
            out.append(self.expr())
            if not self.eat(","):
                break
        self.need(")")
        return out

    def postfix(self, e: Node, first: int, struct: bool, statement: bool = False) -> Node:
        while True:
            if self.at("?"):
                self.i += 1
                e = self.done(self.node("TryExpr", first), e, expr=e)
            elif self.at("("):
                a = self.args()
                e = self.done(self.node("CallExpr", first), e, *a, callee=e, args=a)
            elif self.at("["):
                self.i += 1
                k = self.expr()
                self.need("]")
                e = self.done(self.node("IndexExpr", first), e, k, base=e, index=k)
            elif self.at("."):
                self.i += 1
                if self.at("await"):
                    self.i += 1
                    e = self.done(self.node("AwaitExpr", first), e, expr=e)
                elif self.kind() == "num":
                    name = self.peek()
                    self.i += 1
                    e = self.done(self.node("FieldExpr", first), e, expr=e, name=name)
                else:
                    name_at = self.i
                    name = self.ident()
                    generic = []
                    turbofish = ""
                    if self.at("::"):
                        k = self.i
                        self.i += 1
                        generic = self.generic_args()
                        turbofish = "".join(x.text for x in self.t[k : self.i])
                    if self.at("("):
                        a = self.args()
                        e = self.done(self.node("MethodCallExpr", first), e, *generic, *a, receiver=e, name=name, args=a, generic=generic, turbofish=turbofish, name_at=name_at)
                    else:
                        e = self.done(self.node("FieldExpr", first), e, expr=e, name=name)
            else:
                return e

    def unary(self, struct: bool) -> Node:
        first, n = self.i, self.node("Expr")
        x, k = self.peek(), self.kind()
        if self.starts("&") and not self.at("&="):
            self.need("&")
            raw = False
            if self.at("raw") and self.peek(1) in ("const", "mut") :
                self.i += 1
                raw = True
            mut = self.eat("mut")
            if raw and not mut:
                self.eat("const")
            e = self.postfix_unary(struct)
            n.kind = "RefExpr"
            return self.done(n, e, expr=e, mut=mut)
        if self.at("-", "!", "*"):
            self.i += 1
            e = self.postfix_unary(struct)
            n.kind = "PrefixExpr"
            return self.done(n, e, op=x, expr=e)
        if k in ("num", "str", "char") or self.at("true", "false"):
            self.i += 1
            n.kind = "Literal"
            return self.done(n, value=x, lit=k if k != "ident" else "bool")
        if self.at("("):
            self.i += 1
            es, comma = [], False
            while not self.at(")"):
                es.append(self.expr())
                comma = self.eat(",")
                if not comma:
                    break
            self.need(")")
            n.kind = "ParenExpr" if len(es) == 1 and not comma else "TupleExpr"
            return self.done(n, *es, expr=es[0] if n.kind == "ParenExpr" else None, items=es)
        if self.at("["):
            self.i += 1
            es, size = [], None
            while not self.at("]"):
                es.append(self.expr())
                if self.eat(";"):
                    size = self.expr()
                    break
                if not self.eat(","):
                    break
            self.need("]")
            n.kind = "ArrayExpr"
            return self.done(n, *es, size, items=es, size=size)
        if self.at("{"):
            return self.block()
        if k == "life":
            label = x
            self.i += 1
            self.need(":")
            e = self.unary(struct)
            e.f["label"] = label
            e.first = first
            return e
        if self.at("unsafe", "async", "const", "try") and (self.peek(1) == "{" or (x == "async" and self.peek(1) == "move" and self.peek(2) == "{")):
            self.i += 1
            self.eat("move")
            return self.block(first, modifier=x)
        if self.at("|", "||", "move", "static") or (self.at("async") and self.peek(1) in ("|", "||", "move")):
            while self.at("move", "static", "async"):
                self.i += 1
            params = []
            if not self.eat("||"):
                self.need("|")
                while not self.at("|"):
                    p = self.node("Param")
                    self.attrs()
                    pat = self.pattern_one()
                    t = self.type() if self.eat(":") else None
                    params.append(self.done(p, pat, t, pat=pat, type=t))
                    if not self.eat(","):
                        break
                self.need("|")
            ret = self.type() if self.eat("->") else None
            body = self.block() if ret is not None else self.expr(0, struct)
            n.kind = "ClosureExpr"
            return self.done(n, *params, ret, body, params=params, body=body, is_async=x == "async")
        if self.at("if"):
            return self.if_()
        if self.at("match"):
            self.i += 1
            e = self.expr(0, False)
            self.need("{")
            self.attrs() if self.at("#") and self.peek(1) == "!" else None
            arms = []
            while not self.at("}"):
                a = self.node("MatchArm")
                at = self.attrs()
                pat = self.pattern()
                guard = self.expr() if self.eat("if") else None
                self.need("=>")
                body = self.expr(statement=True)
                a_end = self.done(a, *at, pat, guard, body, pat=pat, guard=guard, body=body)
                a_end.f["comma"] = self.eat(",")
                arms.append(a)
                if not a.f["comma"] and not self.at("}") and body.kind not in _BLOCKLIKE and not (body.kind == "MacroCall" and body.f["brace"]):
                    raise Broken("a match arm needs a comma")
            self.need("}")
            n.kind = "MatchExpr"
            return self.done(n, e, *arms, expr=e, arms=arms)
        if self.at("for"):
            self.i += 1
            pat = self.pattern()
            self.need("in")
            it = self.expr(0, False)
            body = self.block()
            n.kind = "ForExpr"
            return self.done(n, pat, it, body, pat=pat, iterable=it, body=body)
        if self.at("while"):
            self.i += 1
            c = self.condition()
            body = self.block()
            n.kind = "WhileExpr"
            return self.done(n, c, body, cond=c, body=body)
        if self.at("loop"):
            self.i += 1
            body = self.block()
            n.kind = "LoopExpr"
            return self.done(n, body, body=body)
        if self.at("let"):
            return self.let_expr()
        if self.at("return", "break", "continue", "yield"):
            self.i += 1
            n.kind = {"return": "ReturnExpr", "break": "BreakExpr", "continue": "ContinueExpr", "yield": "YieldExpr"}[x]
            if self.kind() == "life":
                self.i += 1
            e = None if self.range_ends(struct) else self.expr(0, struct)
            return self.done(n, e, expr=e)
        if k == "ident" or self.at("::", "<", "<<"):
            p = self.path(types=False)
            if self.at("!") and self.peek(1) in ("(", "[", "{") and not self.at("!="):
                self.i = first
                return self.macro(first)
            if struct and self.at("{") and self.record_here(p):
                return self.record(n, p)
            n.kind = "PathExpr"
            return self.done(n, p, path=p, names=p.f["names"])
        raise Broken(f"no expression starts with {x!r}")

    def postfix_unary(self, struct: bool) -> Node:
        first = self.i
        e = self.postfix(self.unary(struct), first, struct)
        return e

    def condition(self) -> Node:
        return self.expr(0, False)

    def let_expr(self) -> Node:
        n = self.node("LetExpr")
        self.need("let")
        pat = self.pattern()
        self.need("=")
        e = self.expr(5, False)
        return self.done(n, pat, e, pat=pat, expr=e)

    def if_(self) -> Node:
        n = self.node("IfExpr")
        self.need("if")
        c = self.condition()
        then = self.block()
        other = None
        if self.eat("else"):
            other = self.if_() if self.at("if") else self.block()
        return self.done(n, c, then, other, cond=c, then=then, otherwise=other)

    def record_here(self, p: Node) -> bool:
        a, b = self.peek(1), self.peek(2)
        name = p.f["names"][-1]
        if a == "}":
            return name[:1].isupper() or len(p.f["names"]) > 1
        if a == "..":
            return True
        if self.kind(1) in ("ident", "num") and b in (":",):
            return True
        if a == "#":
            return name[:1].isupper()
        return self.kind(1) == "ident" and b in (",", "}") and name[:1].isupper()

    def record(self, n: Node, p: Node) -> Node:
        n.kind = "RecordExpr"
        self.need("{")
        fields, base = [], None
        while not self.at("}"):
            if self.eat(".."):
                base = None if self.at("}") else self.expr()
                break
            f = self.node("RecordExprField")
            a = self.attrs()
            name = self.peek().removeprefix("r#")
            self.i += 1
            value, colon = None, False
            if self.eat(":"):
                colon = True
                value = self.expr()
            fields.append(self.done(f, *a, value, name=name, value=value, colon=colon))
            if not self.eat(","):
                break
        self.need("}")
        return self.done(n, p, *fields, base, path=p, fields=fields, base=base)

    def macro(self, first: int) -> Node:
        n = self.node("MacroCall", first)
        while self.kind() == "doc" or (self.at("#") and self.peek(1) == "["):
            self.attrs()
        self.eat("::")
        names = [self.ident()]
        while self.eat("::"):
            names.append(self.ident())
        self.need("!")
        if self.kind() == "ident":
            self.i += 1
        brace = self.at("{")
        k = self.i
        self.skip_tree()
        body = self.t[k + 1 : self.i - 1]
        return self.done(n, names=names, name=names[-1], brace=brace, body=body, body_first=k + 1, bracket=self.t[k].text)


def _attr_name(body: list[Token]) -> str:
    out = []
    for t in body:
        if t.kind == "ident" or t.text == "::":
            out.append(t.text)
        else:
            break
    return "".join(out)


def _compact_name(self: Node) -> str:
    return self.f.get("name") or ""


Node.compact_name = _compact_name
