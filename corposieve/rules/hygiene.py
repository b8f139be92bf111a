"""Rules on tidiness."""

from __future__ import annotations

import re

from corposieve.rules.base import ast, attrs, in_test, joined, last_of, leaves, macro_args, nonblank, owner, rule, string_value, strip


@ast("rust_closure_param_position", "low", "A function takes one closure, last.")
def closure_param_position(file, p):
    for f in file.of("Fn"):
        o = owner(f)
        if o is not None and o.kind == "Impl" and o.trait is not None:
            continue
        bounds = {g.name: g.bounds for g in f.generics if g.kind == "TypeParam"}
        for w in f.where:
            if w.type is not None:
                bounds.setdefault(w.type.compact, [])
                bounds[w.type.compact] = [*bounds[w.type.compact], *w.bounds]

        def is_fn(bs):
            return any(b.path is not None and re.match(r"(Async)?Fn(Mut|Once)?$", b.path.names[-1]) for b in bs)

        flags = []
        for q in f.params:
            t = strip(q.type)
            flags.append(t is not None and ((t.kind == "ImplTraitType" and is_fn(t.bounds)) or (t.kind == "PathType" and is_fn(bounds.get(t.compact, [])))))
        if sum(flags) > 1:
            yield f, f"`{f.name}` takes several closures"
        if any(a and not b for a, b in zip(flags, flags[1:], strict=False)):
            yield f, f"`{f.name}` takes its closure before other parameters"


@ast("rust_dbg", "medium", "Debugging macros are removed.", fixable=True)
def dbg(file, p):
    for m in file.of("MacroCall"):
        if m.names == ["dbg"] and not in_test(m):
            yield m, "`dbg!` is left"


_GENERIC = {"failed", "error", "should not fail", "unexpected", "unreachable", "oops", "bug", "should work", "should never happen", "unexpected error", "cannot fail", "must succeed", "should succeed", "invariant", ""}


@ast("rust_expect_message", "low", "Messages of expect say what was expected.")
def expect_message(file, p):
    for c in file.of("MethodCallExpr"):
        if c.name == "expect" and len(c.args) == 1 and c.args[0].kind == "Literal" and c.args[0].lit == "str" and not in_test(c):
            if string_value(c.args[0].value).strip().lower() in _GENERIC:
                yield c, "a generic message"


@ast("rust_inline_test_module_size", "low", "Large test modules have their own file.", threshold=200)
def inline_test_module_size(file, p):
    from corposieve.rules.base import is_test_item

    for m in file.of("Module"):
        if m.items is not None and is_test_item(m):
            text = m.text
            n = nonblank(text[text.index("{") :])
            if n > p["threshold"]:
                yield m, f"a test module of {n} lines"


_LOG = frozenset("trace debug info warn error event log".split())


@ast("rust_log_in_loop", "low", "Loops don't log.")
def log_in_loop(file, p):
    for m in file.of("MacroCall"):
        if m.name in _LOG and not in_test(m) and any(x.body.pre <= m.pre < x.body.end_pre or x.kind != "ForExpr" for x in m.up("ForExpr", "WhileExpr", "LoopExpr")):
            yield m, f"`{m.name}!` in a loop"


@ast("rust_missing_assert_message", "low", "Assertions say what went wrong.")
def missing_assert_message(file, p):
    for m in file.of("MacroCall"):
        need = {"assert": 2, "assert_eq": 3, "assert_ne": 3}.get(m.name)
        if need and len(macro_args(m)) < need and not in_test(m):
            yield m, f"`{m.name}!` without a message"


@ast("rust_param_order_consistency", "low", "Alike functions take parameters in one order.", default=False)
def param_order_consistency(file, p):
    seen = {}
    for f in file.of("Fn"):
        o = owner(f)
        family = (o.type.compact if o is not None and o.kind == "Impl" else o.name if o is not None else None, f.parent.pre if o is None else 0, f.name.rpartition("_")[2])
        own = [(q.name, q.type.compact) for q in f.params if q.type is not None]
        known = seen.setdefault(family, {})  # the first function of each list of parameters
        for other, g in known.items() if len(own) > 1 else ():
            both = [x for x in own if x in other]
            if len(both) >= 2 and both != [x for x in other if x in own]:
                yield f, f"`{f.name}` and `{g}` order their parameters differently"
                break
        if own:
            known.setdefault(tuple(own), f.name)


@ast("rust_println", "medium", "Libraries don't print.")
def println(file, p):
    for m in file.of("MacroCall"):
        if len(m.names) == 1 and m.name in ("println", "eprintln", "print", "eprint") and not in_test(m):
            yield m, f"`{m.name}!` prints"


@ast("rust_subtractive_feature_cfg", "medium", "Features add.")
def subtractive_feature_cfg(file, p):
    for n in file.nodes:
        if n.f.get("vis") == "pub" and n.f.get("attrs"):
            for a in attrs(n):
                if a.name == "cfg" and "not(feature" in a.compact_body:
                    yield a, "a public item vanishes with a feature"


def _constant(tokens) -> str | None:
    s = joined(tokens).lstrip("&")
    if not s:
        return None
    ts = [t for t in tokens if t.text not in ("&", "-", "(", ")", "[", "]", ",", ";", "vec", "!")]
    if all(t.kind in ("num", "str", "char") or t.text in ("true", "false") for t in ts) and not re.match(r"\w+\(", s.replace("vec!", "")):
        return "literal"
    if re.match(r"(\w+::)*[A-Z][A-Z0-9_]+$", s) and len(s.rpartition("::")[2]) > 1:
        return "const"
    return None


@ast("rust_tautological_assert", "low", "Assertions compare something that varies.")
def tautological_assert(file, p):
    for m in file.of("MacroCall"):
        if m.name in ("assert_eq", "assert_ne") and in_test(m):
            a = macro_args(m)
            if len(a) >= 2:
                kinds = [_constant(a[0]), _constant(a[1])]
                if None not in kinds and "literal" in kinds:
                    yield m, f"`{m.name}!` compares constants"


@ast("rust_wildcard_imports", "medium", "Imports name what they take.")
def wildcard_imports(file, p):
    for u in file.of("Use"):
        if u.vis or in_test(u):
            continue
        for path, star, _, leaf in leaves(u.tree):
            if star and path:
                last, before = path[-1], path[-2] if len(path) > 1 else ""
                if last in ("prelude", "super") or last[:1].isupper() or before in ("super", "crate"):
                    continue
                yield leaf.line, f"wildcard import of `{'::'.join(path)}`"


def is_comment(line: str) -> bool:
    return line.strip().startswith("//")


@rule("rust_allow_reason", "rust-line", "low", "Allowed lints have a reason.")
def allow_reason(file, p):
    for i, line in enumerate(file.lines):
        if re.match(r"\s*#!?\[(allow|expect)\(", line):
            depth, span = 0, []
            for j in range(i, len(file.lines)):
                span.append(file.lines[j])
                depth += file.code[j].count("[") - file.code[j].count("]") if j < len(file.code) else 0
                if depth <= 0:
                    break
            text = "\n".join(span)
            before = file.lines[i - 1].strip() if i else ""
            if not re.search(r'reason\s*=\s*r?#*"', text) and "//" not in text and not (re.match("//(?![/!])", before)):
                yield i + 1, "a lint is allowed without a reason"


@rule("rust_cfg_not_test", "rust-line", "medium", "Code isn't hidden from tests.")
def cfg_not_test(file, p):
    for i, code in enumerate(file.code, 1):
        if re.search(r"#!?\[cfg\(not\(test\)\)\]", code):
            yield i, "code is hidden from tests"


@rule("rust_deny_warnings", "rust-line", "medium", "New compiler warnings don't break the build.", fixable=True)
def deny_warnings(file, p):
    for i, code in enumerate(file.code, 1):
        if "deny(warnings)" in code:
            yield i, "warnings are denied"


@rule("rust_expect_over_allow", "rust-line", "medium", "Expect a lint rather than allow it.", allowed_lints=[])
def expect_over_allow(file, p):
    spans = [(m.line, m.end_line) for m in file.of("MacroRules")]
    for i, code in enumerate(file.code, 1):
        if any(a <= i <= b for a, b in spans):
            continue
        m = re.match(r"\s*#!?\[allow\(", code)
        if m:
            text = code[m.end() :]
            for j in range(i, min(len(file.code), i + 20)):
                if ")]" in text:
                    break
                text += file.code[j]
            lints = [x.strip() for x in text.split(")]")[0].split(",")]
            lints = [x for x in lints if x and not x.startswith("reason")]
            if not lints or any(x not in p["allowed_lints"] for x in lints):
                yield i, "a lint is allowed, not expected"


@rule("rust_log_named_events", "rust-line", "low", "Events have names.")
def log_named_events(file, p):
    for i, code in enumerate(file.code):
        m = re.search(r"(?<!\w)event!\(", code)
        if not m or is_comment(file.lines[i]):
            continue
        text, depth, out = file.lines[i][m.end() :], 1, []
        for j in range(i, min(len(file.lines), i + 30)):
            for c in text:
                depth += (c == "(") - (c == ")")
                if depth == 0:
                    break
                out.append(c)
            if depth == 0 or j + 1 >= len(file.lines):
                break
            text = "\n" + file.lines[j + 1]
        args = "".join(out)
        at, level = args.find("name:"), args.find("Level::")
        if at < 0 or (0 <= level < at):
            yield i + 1, "an event has no name"


@rule("rust_todo", "rust-line", "low", "Notes to oneself name an owner.")
def todo(file, p):
    for i, line in enumerate(file.lines, 1):
        k = line.find("//")
        if k >= 0:
            text = line[k:]
            for word in ("TODO", "FIXME", "HACK", "XXX"):
                at = text.find(word)
                if at >= 0 and text[at + len(word) : at + len(word) + 1] != "(":
                    yield i, f"{word} without an owner"


@rule("rust_suppression_directives", "rust-line", "low", "Directives are well formed and in place.")
def suppression_directives(file, p):
    from corposieve.operators.directives import parse_directive

    header, before, last = True, None, None
    for i, line in enumerate(file.lines, 1):
        d = parse_directive(line)
        t = line.strip()
        if d and d["error"]:
            yield i, d["error"]
        if d and not d["error"] and d["scope"] == "file":
            if not header:
                yield i, "a file directive after the head of the file"
            elif before == (i - 1, d["reason"]):
                yield i, "file directives with one reason can be merged"
            before = (i, d["reason"])
            last = i if header else last
        elif t:
            if header and last == i - 1:
                yield i, "no blank line after the file directives"
            header = False
            last = None


__all__ = ["last_of"]
