"""Rules on size and complexity."""

from __future__ import annotations

import re
from collections import Counter

from corposieve.rules.base import args_of, ast, bare, callee, inherent, last_of, nearest_fn, nonblank, owner, rule, size_of, strip


@ast("rust_bool_params", "medium", "Several bool parameters are mistaken for each other.", threshold=2)
def bool_params(file, p):
    for f in file.of("Fn"):
        o = owner(f)
        if o is not None and o.kind == "Impl" and o.trait is not None:
            continue
        n = sum(1 for q in f.params if q.type is not None and q.type.compact == "bool")
        if n >= p["threshold"]:
            yield f, f"`{f.name}` takes {n} bools"


@ast("rust_closure_dense_method_chain", "medium", "Long chains of closures are hard to follow.", closure_threshold=6, chain_threshold=12)
def closure_dense_method_chain(file, p):
    for c in file.of("MethodCallExpr"):
        up = c.parent
        while up is not None and up.kind in ("TryExpr", "AwaitExpr", "ParenExpr", "FieldExpr"):
            up = up.parent
        if up is not None and up.kind == "MethodCallExpr" and up.receiver.first == c.first and up.receiver.pre <= c.pre < up.receiver.end_pre:
            continue
        names, closures, e = [], 0, c
        while e is not None:
            if e.kind == "MethodCallExpr":
                names.append(e.name)
                closures += sum(1 for a in e.args if a.kind == "ClosureExpr")
                e = e.receiver
            elif e.kind in ("TryExpr", "AwaitExpr", "ParenExpr", "FieldExpr"):
                e = e.expr
            else:
                break
        if closures >= p["closure_threshold"]:
            yield c, f"a chain with {closures} closures"
        elif len(names) >= p["chain_threshold"] and len(set(names[1:-1])) > 1:
            yield c, f"a chain of {len(names)} calls"


def _simple(e) -> bool:
    e = bare(e)
    return e is not None and e.kind in ("Literal", "PathExpr") or (e is not None and e.kind in ("PrefixExpr", "RefExpr", "FieldExpr") and _simple(e.expr)) or (e is not None and e.kind == "TupleExpr" and all(map(_simple, e.items))) or (e is not None and e.kind == "CallExpr" and all(map(_simple, e.args))) or (e is not None and e.kind == "MacroCall")


@ast("rust_cyclomatic_complexity", "medium", "A function has too many paths.", threshold=15)
def cyclomatic_complexity(file, p):
    total = Counter()
    for e in file.of("IfExpr", "ForExpr", "WhileExpr", "LoopExpr", "MatchExpr"):
        f = e.nearest("Fn", "ClosureExpr")
        if f is None or f.kind != "Fn":
            continue
        if e.kind == "MatchExpr":
            guards = sum(1 for a in e.arms if a.guard is not None)
            total[f.pre] += 1 if not guards and all(_simple(a.body) for a in e.arms) else max(0, len(e.arms) - 1) + guards
        else:
            total[f.pre] += 1
    for f in file.of("Fn"):
        if total[f.pre] + 1 > p["threshold"]:
            yield f, f"`{f.name}` has complexity {total[f.pre] + 1}"


def _depth(t) -> int:
    t = strip(t)
    if t is None:
        return 0
    if t.kind == "PathType":
        inner = max((_depth(a) for a in (t.args or [])), default=0)
        return 1 + inner if t.args else 0
    return max((_depth(c) for c in t.children), default=0)


@ast("rust_deeply_nested_types", "low", "Name the parts of deeply nested types.")
def deeply_nested_types(file, p):
    types = [f.type for f in file.of("RecordField", "TupleField")] + [s.type for s in file.of("LetStmt") if s.type is not None]
    for f in file.of("Fn"):
        types += [q.type for q in f.params if q.type is not None] + ([f.ret] if f.ret is not None else [])
    for t in types:
        if _depth(t) > 3:
            yield t, f"a type nested {_depth(t)} deep"


@ast("rust_large_enum_variant", "medium", "One large variant makes all values large.", threshold=256)
def large_enum_variant(file, p):
    for e in file.of("Enum"):
        sizes = []
        for v in e.variants:
            parts = [size_of(f.type) for f in v.fields]
            if None not in parts:
                sizes.append((v, sum(parts)))
        if len(sizes) >= 2:
            low = min(s for _, s in sizes)
            for v, s in sizes:
                if s > low + p["threshold"]:
                    yield v, f"variant `{v.name}` takes {s} bytes, another {low}"


@ast("rust_large_fn_params", "medium", "Functions take few parameters.", threshold=6)
def large_fn_params(file, p):
    for f in file.of("Fn"):
        if len(f.params) > p["threshold"]:
            yield f, f"`{f.name}` takes {len(f.params)} parameters"


@ast("rust_large_stack_array", "high", "Large arrays don't belong on the stack.", threshold=4096)
def large_stack_array(file, p):
    from corposieve.rules.base import int_value

    for n in file.of("ArrayType", "ArrayExpr"):
        if n.nearest("Static") is not None:
            continue
        if n.kind == "ArrayType":
            size = size_of(n)
        elif n.size is not None:
            count, each = int_value(n.size), _literal_size(n.items[0])
            size = None if count is None or each is None else count * each
        else:
            continue
        if size is not None and size > p["threshold"]:
            yield n, f"an array of {size} bytes on the stack"


def _literal_size(e):
    e = bare(e)
    if e is None or e.kind not in ("Literal", "ArrayExpr"):
        return None
    if e.kind == "ArrayExpr":
        from corposieve.rules.base import int_value

        if e.size is not None:
            n, each = int_value(e.size), _literal_size(e.items[0])
            return None if n is None or each is None else n * each
        parts = [_literal_size(x) for x in e.items]
        return None if None in parts else sum(parts)
    if e.lit == "bool":
        return 1
    if e.lit == "num":
        from corposieve.rules.base import SIZES

        m = re.search(r"(u8|i8|u16|i16|u32|i32|u64|i64|usize|isize|u128|i128|f32|f64)$", e.value)
        return SIZES[m.group(1)] if m else 8 if "." in e.value else 4
    return 4 if e.lit == "char" else 16


@ast("rust_max_fn_lines", "medium", "Functions are short.", threshold=150)
def max_fn_lines(file, p):
    for f in file.of("Fn"):
        if f.body is not None and nonblank(f.body.text) > p["threshold"]:
            yield f, f"`{f.name}` has {nonblank(f.body.text)} lines"


def _nesting(n, depth: int = 0, is_else: bool = False) -> int:
    best = depth
    for c in n.children:
        if c.kind == "Fn":
            continue
        if c.kind == "IfExpr":
            inner = depth if n.kind == "IfExpr" and n.otherwise is c else depth + 1
            best = max(best, _nesting(c, inner))
        elif c.kind in ("ForExpr", "WhileExpr", "LoopExpr"):
            best = max(best, _nesting(c, depth + 1))
        elif c.kind == "MatchExpr":
            best = max(best, _nesting(c, depth + 1))
        else:
            best = max(best, _nesting(c, depth))
    return best


@ast("rust_max_nesting", "medium", "Control flow nests little.", threshold=5)
def max_nesting(file, p):
    for f in file.of("Fn"):
        if f.body is not None and (d := _nesting(f.body)) > p["threshold"]:
            yield f, f"`{f.name}` nests {d} deep"


@ast("rust_multiple_inherent_impl", "low", "A type has one inherent impl.")
def multiple_inherent_impl(file, p):
    seen = set()
    for i in file.of("Impl"):
        if i.trait is None:
            name = last_of(i.type)
            if name in seen:
                yield i, f"a second inherent impl of `{name}`"
            seen.add(name)


@ast("rust_recursive_fn", "high", "Recursion can exhaust the stack.")
def recursive_fn(file, p):
    for f in file.of("Fn"):
        if f.body is None:
            continue
        o = owner(f)
        ty = last_of(o.type) if o is not None and o.kind == "Impl" else None
        for c in f.body.all("CallExpr", "MethodCallExpr"):
            if nearest_fn(c) is not f:
                continue
            if c.kind == "CallExpr":
                path = callee(c)
                if (o is None and path == [f.name]) or (ty and len(path) == 2 and path[0] in ("Self", ty) and path[1] == f.name):
                    yield f, f"`{f.name}` calls itself"
                    break
            elif c.name == f.name and inherent(f) is not None and c.receiver.compact == "self":
                yield f, f"`{f.name}` calls itself"
                break


@rule("rust_too_many_lines_in_file", "rust-line", "medium", "Files are short.", threshold=1500, slack_percent=20)
def too_many_lines_in_file(file, p):
    from corposieve.rules.lines import budget

    n = sum(1 for x in file.lines if x.strip())
    own = budget(file.lines, "rust_too_many_lines_in_file")
    limit = p["threshold"] if own is None else own * (100 + p["slack_percent"]) // 100
    if n > limit:
        yield 1, f"{n} lines, {limit} allowed"


__all__ = ["args_of"]
