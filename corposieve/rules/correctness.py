"""Rules on likely mistakes."""

from __future__ import annotations

import re

from corposieve.rules.base import ast, attrs, bare, callee, docs, has_attr, in_test, inherent, joined, last_of, macro_args, nearest_fn, owner, preceded, public, referent, result_args, returns_self, string_value, strip

_CAST_LINTS = ("cast_possible_truncation", "cast_precision_loss", "cast_sign_loss", "cast_possible_wrap", "cast_lossless", "as_conversions")


def panicking(n) -> str | None:
    if n.kind == "MacroCall" and n.name in ("panic", "todo", "unimplemented"):
        return n.name + "!"
    if n.kind == "MethodCallExpr" and (n.name == "unwrap" and not n.args or n.name == "expect"):
        return n.name
    return None


@ast("rust_assert_side_effects", "high", "Assertions that release builds drop have no effects.")
def assert_side_effects(file, p):
    for m in file.of("MacroCall"):
        if m.name.startswith("debug_assert") and any(re.fullmatch(r"(<<|>>|[-+*/%^&|])=", t.text) for t in m.body):
            yield m, f"`{m.name}!` assigns"


@ast("rust_catch_unwind", "high", "Catching panics needs a reason.")
def catch_unwind(file, p):
    for c in file.of("CallExpr", "MethodCallExpr"):
        name = (callee(c) or [""])[-1] if c.kind == "CallExpr" else c.name
        if name == "catch_unwind" and not preceded(file, c.line, "PANIC-BOUNDARY:"):
            yield c, "catch_unwind without its boundary's reason"


@ast("rust_deep_exit", "high", "Only main exits the process.")
def deep_exit(file, p):
    for c in file.of("CallExpr"):
        path = callee(c)
        if path and "process" in path and path[-1] == "exit" and not in_test(c):
            yield c, "the process exits deep within"


@ast("rust_drop_panic", "high", "Drop doesn't panic.")
def drop_panic(file, p):
    for i in file.of("Impl"):
        if last_of(i.trait) == "Drop" and not in_test(i):
            for n in i.all("MacroCall", "MethodCallExpr"):
                if what := panicking(n):
                    yield n, f"`{what}` in Drop"


@ast("rust_dup_expressions", "high", "Both sides of an operator are the same.")
def dup_expressions(file, p):
    for b in file.of("BinExpr"):
        if b.op in ("==", "!=", "&&", "||", "-", "/", "%", "^", "&") and b.lhs.compact == b.rhs.compact:
            yield b, f"both sides of `{b.op}` are `{b.lhs.compact}`"


@ast("rust_exotic_numeric_api", "low", "Public functions take plain numbers.")
def exotic_numeric_api(file, p):
    for f in file.of("Fn"):
        if public(f) and not in_test(f):
            for t in [*(q.type for q in f.params if q.type is not None), f.ret]:
                if t is not None and (m := next((x.text for x in t.tokens if re.match(r"(Saturating|Wrapping)$|NonZero", x.text)), None)):
                    yield t, f"public interface shows `{m}`"


def _is_float(e) -> bool:
    e = bare(e)
    if e is None:
        return False
    if e.kind == "Literal":
        return e.lit == "num" and bool(re.match(r"\d[\d_]*(\.[\d_]*([eE]|$|f)|[eE]|_?f(32|64)$|\.\d)|.*f(32|64)$", e.value)) and not e.value.startswith("0x")
    if e.kind == "PrefixExpr":
        return e.op == "-" and _is_float(e.expr)
    if e.kind == "CastExpr":
        return last_of(e.type) in ("f32", "f64")
    return False


@ast("rust_floating_point_eq", "high", "Floats are compared with a tolerance.")
def floating_point_eq(file, p):
    bound: dict[tuple[int, str], int] = {}
    for f in file.of("Fn"):
        for q in f.params:
            if last_of(referent(q.type)) in ("f32", "f64"):
                bound[f.pre, q.name] = q.start
        for s in f.all("LetStmt"):
            if nearest_fn(s) is f and s.pat.kind == "IdentPat" and (last_of(s.type) in ("f32", "f64") or (s.type is None and _is_float(s.value))):
                bound[f.pre, s.pat.name] = s.start
    for b in file.of("BinExpr"):
        if b.op not in ("==", "!=") or in_test(b):
            continue
        f = nearest_fn(b)

        def floats(e, f=f, b=b):
            e = bare(e)
            return _is_float(e) or (e is not None and e.kind == "PathExpr" and f is not None and bound.get((f.pre, "::".join(e.names)), 1 << 60) < b.start)

        def zero(e):
            e = bare(e)
            if e is not None and e.kind == "PrefixExpr" and e.op == "-":
                e = bare(e.expr)
            return e is not None and e.kind == "Literal" and bool(re.match(r"0+(\.0*(_?f(32|64))?|_?f(32|64))$", e.value))

        if (floats(b.lhs) or floats(b.rhs)) and not zero(b.lhs) and not zero(b.rhs):
            yield b, "floats are compared exactly"


@ast("rust_global_state", "medium", "State is passed, not global.")
def global_state(file, p):
    for s in file.of("Static"):
        m = next((t.text for t in (s.type.tokens if s.type is not None else []) if re.match(r"Atomic\w*$|(Cell|LazyCell|LazyLock|Mutex|OnceCell|OnceLock|RefCell|RwLock)$", t.text)), None)
        if m:
            yield s, f"static of `{m}`"
    for m in file.of("MacroCall"):
        if m.name == "thread_local":
            yield m, "thread-local state"


_WEAK = frozenset("bool char str String f32 f64 isize usize".split()) | {f"{k}{n}" for k in "iu" for n in (8, 16, 32, 64, 128)}


@ast("rust_infallible_from_weak", "medium", "A type that validates has no From of an unchecked value.")
def infallible_from_weak(file, p):
    fallible = {last_of(i.type) for i in file.of("Impl") if last_of(i.trait) == "TryFrom"}
    for f in file.of("Fn"):
        o = inherent(f)
        if o is not None and f.self_param is None and (a := result_args(f.ret)) and last_of(a[0]) in ("Self", last_of(o.type)):
            fallible.add(last_of(o.type))
    for i in file.of("Impl"):
        if last_of(i.trait) == "From" and last_of(i.type) in fallible and not in_test(i):
            a = strip(i.trait).args
            if a and last_of(referent(a[0])) in _WEAK:
                yield i, f"`{last_of(i.type)}` validates but converts from `{a[0].compact}`"


@ast("rust_lossy_cast", "medium", "Casts that lose values are written out.")
def lossy_cast(file, p):
    for c in file.of("CastExpr"):
        if last_of(c.type) in "u8 i8 u16 i16 f32".split() and not in_test(c):
            f = nearest_fn(c)
            if f is None or not any(a.name == "expect" and "reason" in a.compact_body and any(x in a.compact_body for x in _CAST_LINTS) for a in attrs(f)):
                yield c, f"cast to `{last_of(c.type)}` may lose"


@ast("rust_mem_forget", "high", "Leaks need a reason.")
def mem_forget(file, p):
    for c in file.of("CallExpr"):
        path = callee(c)
        if len(path) > 1 and path[-1] == "forget" and "mem" in path and not preceded(file, c.line, "LEAK:", "SAFETY:"):
            yield c, "mem::forget without a reason"


@ast("rust_newtype_pub_field", "medium", "A type that validates keeps its field private.")
def newtype_pub_field(file, p):
    for s in file.of("Struct"):
        if not public(s) or len(s.fields) != 1 or s.fields[0].vis != "pub" or last_of(referent(s.fields[0].type)) not in _WEAK or in_test(s):
            continue
        for i in s.parent.children:
            if i.kind == "Impl" and i.trait is None and last_of(i.type) == s.name:
                if any(f.kind == "Fn" and public(f) and f.self_param is None and last_of(f.ret) in ("Result", "Option") and returns_self(f, s.name) for f in i.items):
                    yield s.fields[0], f"`{s.name}` validates but its field is public"
                    break


@ast("rust_panic", "high", "No bare panics or unfinished code.")
def panic(file, p):
    for m in file.of("MacroCall"):
        if in_test(m):
            continue
        if m.name in ("todo", "unimplemented"):
            yield m, f"`{m.name}!` is left"
        elif m.name == "panic" and (not m.body or (len(m.body) == 1 and m.body[0].kind == "str" and not string_value(m.body[0].text).strip())):
            yield m, "panic without a message"


@ast("rust_panic_in_result_fn", "high", "A function that returns a Result doesn't panic.")
def panic_in_result_fn(file, p):
    for n in file.of("MacroCall", "MethodCallExpr"):
        what = panicking(n)
        if what and not in_test(n) and any(last_of(f.ret) == "Result" for f in n.up("Fn")):
            yield n, f"`{what}` where a Result is returned"


@ast("rust_panic_message", "medium", "Assertions say what went wrong.")
def panic_message(file, p):
    for m in file.of("MacroCall"):
        if in_test(m):
            continue
        if m.name == "unreachable" and (not m.body or (len(m.body) == 1 and m.body[0].kind == "str" and not string_value(m.body[0].text).strip())):
            yield m, "unreachable without a message"
        elif m.name in ("debug_assert", "debug_assert_eq", "debug_assert_ne") and len(macro_args(m)) < (2 if m.name == "debug_assert" else 3):
            yield m, f"`{m.name}!` without a message"


@ast("rust_transmute_in_safe_fn", "high", "Safe public functions don't transmute.")
def transmute_in_safe_fn(file, p):
    for c in file.of("CallExpr"):
        f = nearest_fn(c)
        if (callee(c) or [""])[-1] == "transmute" and f is not None and f.vis == "pub" and "unsafe" not in f.flags:
            yield c, f"`{f.name}` transmutes but is safe"


@ast("rust_transmute_usage", "high", "Transmutes are justified.")
def transmute_usage(file, p):
    for c in file.of("CallExpr"):
        if (callee(c) or [""])[-1] == "transmute" and not preceded(file, c.line, "SAFETY:"):
            yield c, "transmute without a SAFETY comment"


def _bound_comment(file, x) -> bool:
    """A ``// BOUNDS:`` comment that names the container and part of the index, right above code, in a block around the access."""
    base = x.base.compact.split(".")[-1]
    parts = {t.text for t in x.index.tokens if t.kind == "ident"}
    around = {b.pre for b in x.up("StmtList")}
    for i in range(x.line - 2, -1, -1):
        t = file.lines[i].strip()
        if not t.startswith("//") or "BOUNDS:" not in t or not re.search(r"(?<!\w)" + re.escape(base) + r"(?!\w)", t):
            continue
        if not any(re.search(r"(?<!\w)" + re.escape(p) + r"(?!\w)", t) for p in parts):
            continue
        below = i + 1
        while below < len(file.lines) and file.lines[below].strip().startswith("//"):
            below += 1
        inner = max((b for b in file.of("StmtList") if b.line <= i + 1 <= b.end_line), key=lambda b: b.pre, default=None)
        if below < len(file.lines) and file.lines[below].strip() and inner is not None and inner.pre in around:
            return True
    return False


@ast("rust_unchecked_indexing", "low", "Indexing is shown to be in bounds.", default=False)
def unchecked_indexing(file, p):
    for x in file.of("IndexExpr"):
        base, index = x.base.compact, x.index.compact
        if in_test(x) or (x.index.kind == "Literal" and x.index.lit == "num") or (x.index.kind == "RangeExpr" and x.index.lo is None and x.index.hi is None) or _bound_comment(file, x):
            continue
        proved, inside = False, x
        for up in x.up():
            if up.kind == "Fn":
                break
            if up.kind == "ForExpr" and up.body.pre <= x.pre:
                it, pat = up.iterable.compact, up.pat.compact
                if (pat == index and re.match(r"\(?0\.\.=?" + re.escape(base) + r"\.len\(\)\)?(\.rev\(\))?$", it) and "..=" not in it) or (re.match(r"\(" + re.escape(index) + r",", pat) and re.match(re.escape(base) + r"\.iter(_mut)?\(\)\.enumerate\(\)$", it)):
                    proved = not _shadowed(up.body, x, base, index)
            elif up.kind in ("WhileExpr", "IfExpr"):
                body = up.body if up.kind == "WhileExpr" else up.then
                if body.pre <= x.pre < body.end_pre and _implies(up.cond, base, index):
                    proved = not _shadowed(body, x, base, index, True)
            elif up.kind == "ClosureExpr" and up.parent.kind == "MethodCallExpr" and up.parent.name in ("find", "position", "any", "all", "filter", "map", "for_each"):
                r = up.parent.receiver.compact
                pats = [q.pat.compact.lstrip("&") for q in up.params]
                if index.lstrip("*") in pats and re.match(r"\(0\.\." + re.escape(base) + r"\.len\(\)\)$", r):
                    proved = True
            elif up.kind == "MatchArm" and re.match(r"Ok\(" + re.escape(index) + r"\)$", up.pat.compact) and re.match(re.escape(base) + r"\.binary_search(_by|_by_key)?\(", up.parent.expr.compact):
                proved = True
            if proved:
                break
            inside = up
        if not proved and not re.search(r"%" + re.escape(base) + r"\.len\(\)\)?$", index):
            yield x, f"`{base}[{index}]` may be out of bounds"


def _implies(cond, base, index) -> bool:
    cond = bare(cond)
    if cond.kind == "BinExpr" and cond.op == "&&":
        return _implies(cond.lhs, base, index) or _implies(cond.rhs, base, index)
    return cond.kind == "BinExpr" and ((cond.op == "<" and cond.lhs.compact == index and cond.rhs.compact == f"{base}.len()") or (cond.op == ">" and cond.rhs.compact == index and cond.lhs.compact == f"{base}.len()"))


def _shadowed(body, x, base, index, assigned=False) -> bool:
    names = {base.split(".")[0].split("[")[0], index.split(".")[0]}
    for n in body.all("LetStmt", "BinExpr", "ClosureExpr", "ForExpr", "MethodCallExpr"):
        if n.start >= x.start and n.kind != "ClosureExpr":
            continue
        if n.kind == "LetStmt" and n.end <= x.start and names & {t.text for t in n.pat.tokens}:
            return True
        if n.kind == "BinExpr" and n.op.endswith("=") and n.op not in ("==", "!=", "<=", ">=") and n.end <= x.start and n.lhs.compact in (base, index):
            return True
        if n.kind == "MethodCallExpr" and n.end <= x.start and n.receiver.compact == base and n.name in ("pop", "clear", "truncate", "remove", "drain", "retain", "swap_remove", "split_off"):
            return True
        if n.kind in ("ClosureExpr", "ForExpr") and n.pre < x.pre < n.end_pre:
            pats = [q.pat for q in n.params] if n.kind == "ClosureExpr" else [n.pat]
            if names & {t.text for q in pats for t in q.tokens}:
                return True
    return False


__all__ = ["docs", "has_attr", "joined", "owner"]
