"""Rules on needless work."""

from __future__ import annotations

import re

from corposieve.rules.base import args_of, ast, attrs, bare, callee, in_test, inherent, last_of, macro_args, nearest_fn, rule, size_of, strip


def loop_of(n):
    """The nearest loop whose body holds ``n``, within its function or closure."""
    x = n
    for u in n.up():
        if u.kind in ("Fn", "ClosureExpr"):
            return None
        if u.kind in ("ForExpr", "WhileExpr", "LoopExpr") and u.body is x:
            return u
        x = u
    return None


def in_async(n) -> bool:
    for u in n.up():
        if u.kind == "BlockExpr" and u.modifier == "async":
            return True
        if u.kind == "ClosureExpr":
            return bool(u.is_async)
        if u.kind == "Fn":
            return "async" in u.flags
    return False


def names_in(pat) -> set[str]:
    return {t.text for t in pat.tokens if t.kind == "ident" and t.text not in ("mut", "ref") and not t.text[:1].isupper()}


@ast("rust_alloc_in_loop", "medium", "What doesn't vary is made before the loop.", default=False)
def alloc_in_loop(file, p):
    for n in file.of("MethodCallExpr", "MacroCall"):
        if not ((n.kind == "MethodCallExpr" and n.name == "to_string" and not n.args) or (n.kind == "MacroCall" and n.name == "format")) or in_test(n):
            continue
        loop = loop_of(n)
        if loop is None:
            continue
        variant = set()
        if loop.kind == "ForExpr":
            variant |= names_in(loop.pat)
        if loop.kind == "WhileExpr":
            for e in [loop.cond, *loop.cond.all("LetExpr")]:
                if e.kind == "LetExpr":
                    variant |= names_in(e.pat)
        for x in loop.body.all("LetStmt", "BinExpr", "ForExpr", "LetExpr", "MatchArm", "RefExpr", "MethodCallExpr"):
            if x.kind in ("LetStmt", "ForExpr", "LetExpr", "MatchArm"):
                variant |= names_in(x.pat)
            elif x.kind == "BinExpr" and x.op.endswith("=") and x.op not in ("==", "!=", "<=", ">="):
                variant |= names_in(x.lhs)
            elif x.kind == "RefExpr" and x.mut:
                variant |= names_in(x.expr)
            elif x.kind == "MethodCallExpr" and re.match(r"(push|insert|push_str|next|pop|extend|clear|remove)", x.name):
                variant |= names_in(x.receiver)
        used = {t.text for t in n.tokens if t.kind == "ident"}
        for t in n.tokens:
            if t.kind == "str":
                used |= set(re.findall(r"\{(\w+)", t.text))
        if used & variant or (n.kind == "MethodCallExpr" and any(x.kind in ("CallExpr", "MacroCall") for x in n.receiver.all()) or n.receiver is not None and n.receiver.kind in ("CallExpr", "MacroCall")):
            continue
        if n.kind == "MacroCall" and any(re.search(r"\w\(", "".join(t.text for t in a)) for a in macro_args(n)[1:]):
            continue
        exempt = False
        for u in n.up():
            if u is loop:
                break
            if u.kind in ("ReturnExpr", "BreakExpr", "ClosureExpr", "MacroCall", "TryExpr", "RecordExpr"):
                exempt = True
            if u.kind == "MethodCallExpr" and u.name in ("push", "insert", "ok_or", "unwrap_or", "entry", "send", "push_back", "extend", "map_err", "with_context", "context", "expect"):
                exempt = True
            if u.kind == "CallExpr" and (callee(u) or [""])[-1] in ("Err", "Some", "Ok"):
                exempt = True
        if not exempt:
            yield n, "an allocation that doesn't vary in a loop"


@ast("rust_async_loop_no_yield", "low", "Async loops yield.")
def async_loop_no_yield(file, p):
    for n in file.of("WhileExpr", "LoopExpr"):
        if not in_async(n) or in_test(n):
            continue
        if any(True for _ in n.body.all("AwaitExpr")):
            continue
        calls = any(True for _ in n.body.all("CallExpr", "MethodCallExpr"))
        if calls or len(n.body.stmts) >= 3:
            yield n, "a loop in async code that never awaits"


@rule("rust_box_leak", "rust-line", "high", "Leaks need a reason.")
def box_leak(file, p):
    for i, line in enumerate(file.lines, 1):
        if "Box::leak" in line and not line.strip().startswith("//"):
            before = file.lines[i - 2] if i > 1 else ""
            if "SAFETY" not in before and "LEAK" not in before:
                yield i, "Box::leak without a reason"


@ast("rust_box_vec", "medium", "Containers that are on the heap need no box.")
def box_vec(file, p):
    for t in file.of("PathType"):
        if t.last_name == "Box" and (a := args_of(t)) and last_of(a[0]) in ("Vec", "String", "Box"):
            yield t, f"`{t.compact}` is boxed twice"


_POLLS = ("try_recv", "try_lock", "try_read", "try_write", "compare_exchange", "compare_exchange_weak")


@ast("rust_busy_wait", "medium", "Wait rather than poll.")
def busy_wait(file, p):
    for n in file.of("LoopExpr", "WhileExpr"):
        if in_test(n):
            continue

        def methods(e):
            return [x for x in [e, *e.all("MethodCallExpr")] if x.kind == "MethodCallExpr"]

        polls = any(c.name in _POLLS for c in methods(n.body))
        if n.kind == "WhileExpr":
            polls = polls or any(c.name in _POLLS or c.name == "load" for c in methods(n.cond))
        waits = any(True for _ in n.all("AwaitExpr")) or any((c.kind == "CallExpr" and (callee(c) or [""])[-1] in ("sleep", "yield_now", "park", "park_timeout")) or (c.kind == "MethodCallExpr" and c.name in ("recv", "sleep", "park", "yield_now", "wait", "recv_timeout", "wait_timeout")) for c in n.all("CallExpr", "MethodCallExpr"))
        if polls and not waits:
            yield n, "a loop polls without waiting"


_COLLECTIONS = ("Vec", "HashMap", "HashSet", "String", "BTreeMap", "BTreeSet", "VecDeque")
_GROW = ("push", "insert", "push_str", "extend", "push_back", "append", "extend_from_slice", "push_front")


@ast("rust_collection_new_in_loop", "medium", "Buffers are reused by loops.")
def collection_new_in_loop(file, p):
    for s in file.of("LetStmt"):
        if s.value is None or s.pat.kind != "IdentPat" or in_test(s) or loop_of(s) is None:
            continue
        v = bare(s.value)
        path = callee(v) if v.kind == "CallExpr" else []
        deferred = len(path) >= 2 and path[-2] in _COLLECTIONS[:6] and path[-1] in ("new", "default")
        eager = (len(path) >= 2 and path[-2] in _COLLECTIONS[:6] and path[-1] == "with_capacity") or (v.kind == "MacroCall" and v.name == "vec" and bool(v.body))
        if not (deferred or eager):
            continue
        name, block = s.pat.name, s.parent
        later = [x for x in block.all("MethodCallExpr", "PathExpr", "RefExpr", "MacroCall", "RecordExprField") if x.start > s.end]
        grown = any(x.kind == "MethodCallExpr" and x.name in _GROW and x.receiver.compact == name for x in later)
        escapes = False
        for x in later:
            if x.kind == "RecordExprField" and x.value is None and x.name == name:
                escapes = True
            if x.kind == "PathExpr" and x.compact == name:
                u = x.parent
                if u.kind in ("CallExpr", "MethodCallExpr") and any(a is x for a in u.args):
                    escapes = True
                if u.kind in ("ReturnExpr", "BreakExpr", "RecordExprField", "TupleExpr", "ArrayExpr", "BinExpr", "ExprStmt", "StmtList", "LetStmt") and not (u.kind == "BinExpr" and u.op in ("==", "!=", "<", ">", "<=", ">=")):
                    escapes = True
                if u.kind == "ForExpr" and u.iterable is x:
                    escapes = True
                if u.kind == "MethodCallExpr" and u.receiver is x and re.match(r"into_|drain$", u.name):
                    escapes = True
        if (eager or grown) and not escapes:
            yield s, f"`{name}` is made anew in each turn"


@ast("rust_default_hasher", "low", "Hash maps of trusted keys take a fast hasher.")
def default_hasher(file, p):
    fast = re.compile(r"(?i)fx|ahash|foldhash|fnv|nohash|xxh|seahash|hasher|buildhash")
    for t in file.of("PathType"):
        n = {"HashMap": 2, "HashSet": 1}.get(t.last_name)
        if n and len(args_of(t)) == n and not fast.search("::".join(t.path.names)) and not in_test(t):
            yield t, f"`{t.last_name}` with the default hasher"
    for c in file.of("CallExpr"):
        path = callee(c)
        if len(path) >= 2 and path[-2] in ("HashMap", "HashSet") and path[-1] in ("new", "with_capacity") and not fast.search(c.callee.compact) and not in_test(c):
            yield c, f"`{path[-2]}` with the default hasher"


_NUMBERS = r"(?:u8|u16|u32|u64|u128|usize|i8|i16|i32|i64|i128|isize|f32|f64)"


@ast("rust_from_instead_of_as", "low", "Literals are converted by From.", fixable=True)
def from_instead_of_as(file, p):
    for c in file.of("CastExpr"):
        e = c.expr
        if e.kind == "PrefixExpr" and e.op == "-":
            e = e.expr
        if e.kind == "Literal" and e.lit == "num" and re.search(_NUMBERS + "$", e.value) and re.fullmatch(_NUMBERS, last_of(c.type)) and not in_test(c) and c.nearest("Const", "Static") is None:
            yield c, f"cast of a literal to `{last_of(c.type)}`"


@ast("rust_large_async_local", "medium", "Large arrays stay out of futures.", threshold=1024)
def large_async_local(file, p):
    from corposieve.rules.base import int_value
    from corposieve.rules.complexity import _literal_size

    for s in file.of("LetStmt"):
        if in_async(s) and not in_test(s):
            t, v = strip(s.type), bare(s.value)
            size = size_of(t) if t is not None and t.kind == "ArrayType" else None
            if size is None and v is not None and v.kind == "ArrayExpr":
                size = _literal_size(v) if v.size is None or int_value(v.size) is not None else None
            if size is not None and size > p["threshold"]:
                yield s, f"{size} bytes in a future"
    for f in file.of("Fn"):
        if "async" in f.flags and not in_test(f):
            for q in f.params:
                t = strip(q.type)
                if t is not None and t.kind == "ArrayType" and (size_of(t) or 0) > p["threshold"]:
                    yield q, f"{size_of(t)} bytes in a future"


@ast("rust_missing_capacity", "low", "Collections of known size are made with it.")
def missing_capacity(file, p):
    for b in file.of("StmtList"):
        for k, s in enumerate(b.stmts):
            if s.kind != "LetStmt" or s.pat.kind != "IdentPat" or not s.pat.mut or s.value is None or in_test(s):
                continue
            path = callee(bare(s.value)) if bare(s.value).kind == "CallExpr" else []
            made = len(path) >= 2 and path[-1] in ("new", "default") and (path[-2] if path[-2] != "Default" else last_of(s.type)) in ("HashMap", "HashSet", "String", "Vec")
            if not made:
                continue
            for t in b.stmts[k + 1 :]:
                loop = t.expr if t.kind == "ExprStmt" else t
                if loop is None or loop.kind != "ForExpr":
                    continue
                it = loop.iterable
                known = it.kind == "RefExpr" or it.compact.startswith("&") or bare(it).kind == "RangeExpr" or (it.kind == "MethodCallExpr" and it.name in ("iter", "iter_mut"))
                if bare(it).kind == "RangeExpr" and (bare(it).hi is None or bare(it).lo is None):
                    known = False
                grows = any(
                    c.kind == "MethodCallExpr" and c.name in ("push", "insert", "push_str") and c.receiver.compact == s.pat.name and not any(u.kind in ("IfExpr", "MatchExpr", "ForExpr", "WhileExpr", "LoopExpr", "ClosureExpr") and u.pre > loop.pre for u in c.up())
                    for c in loop.body.all("MethodCallExpr")
                )
                early = any(True for _ in loop.body.all("BreakExpr", "ContinueExpr"))
                if known and grows and not early:
                    yield s, f"`{s.pat.name}` could be made with its capacity"
                    break


@ast("rust_nested_smart_pointers", "medium", "Pointers don't nest.")
def nested_smart_pointers(file, p):
    for t in file.of("PathType"):
        a = args_of(t)
        if not a or in_test(t):
            continue
        outer, inner = t.last_name, last_of(a[0])
        if (outer in ("Arc", "Box", "Rc") and inner in ("Arc", "Box", "Rc") and (outer, inner) != ("Box", "Box")) or (outer == "Arc" and inner in ("Vec", "String")):
            yield t, f"`{t.compact}` points twice"


_CHEAP = ("len", "is_empty", "as_str", "as_ref", "as_bytes", "as_slice", "get", "as_deref", "iter", "is_some", "is_none", "copied", "unwrap_or")


@ast("rust_ok_or_eager", "low", "Fallbacks are made when needed.", fixable=True)
def ok_or_eager(file, p):
    for c in file.of("MethodCallExpr"):
        if c.name in ("ok_or", "unwrap_or") and len(c.args) == 1 and not in_test(c):
            a = bare(c.args[0])
            if a.kind == "CallExpr" and callee(a) and callee(a)[-1][:1].isupper() and False:
                continue
            if a.kind in ("CallExpr", "MacroCall") or (a.kind == "MethodCallExpr" and a.name not in _CHEAP[:6]):
                yield c, f"`{c.name}` makes its fallback always"


@ast("rust_unnecessary_collect", "low", "Iterate without collecting.")
def unnecessary_collect(file, p):
    for c in file.of("MethodCallExpr"):
        r = c.receiver
        if c.name in ("iter", "into_iter") and r.kind == "MethodCallExpr" and r.name == "collect" and r.turbofish.startswith("::<Vec<") and not in_test(c):
            yield c, "collected only to be iterated"


@ast("rust_vec_init_then_push", "low", "Write out the vector.")
def vec_init_then_push(file, p):
    for b in file.of("StmtList"):
        for s, t in zip(b.stmts, b.stmts[1:], strict=False):
            if s.kind == "LetStmt" and s.pat.kind == "IdentPat" and s.pat.mut and s.type is None and s.value is not None and s.value.compact == "Vec::new()" and not in_test(s):
                e = t.expr if t.kind == "ExprStmt" else t
                if e is not None and e.kind == "MethodCallExpr" and e.name == "push" and e.receiver.compact == s.pat.name:
                    yield s, f"`{s.pat.name}` is pushed to at once"


@ast("rust_vec_string_field", "low", "Fields that don't grow are boxed slices.")
def vec_string_field(file, p):
    for s in file.of("Struct"):
        if in_test(s):
            continue
        for f in s.fields:
            t = strip(f.type)
            if f.vis == "pub" or last_of(t) != "Vec" or not args_of(t) or last_of(args_of(t)[0]) not in ("String", "Vec"):
                continue
            if last_of(args_of(t)[0]) == "String" and len(strip(args_of(t)[0]).path.names) > 3:
                continue
            mutated = False
            for c in file.of("MethodCallExpr"):
                i = inherent(nearest_fn(c)) if nearest_fn(c) is not None else None
                i = i or (c.nearest("Impl"))
                if i is not None and last_of(i.type) == s.name and c.name in ("iter_mut", "get_mut", "first_mut", "last_mut", "as_mut_slice") and c.receiver.compact == f"self.{f.name}":
                    mutated = True
            for x in file.of("IndexExpr"):
                i = x.nearest("Impl")
                if i is not None and last_of(i.type) == s.name and x.base.compact == f"self.{f.name}" and x.parent.kind in ("MethodCallExpr",) and x.parent.receiver is x and x.parent.name in _GROW:
                    mutated = True
            if not mutated:
                yield f, f"field `{f.name}` holds growable parts"


__all__ = ["attrs"]
