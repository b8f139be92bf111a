"""Rules on foreign interfaces, macros and types at boundaries."""

from __future__ import annotations

import re

from corposieve.rules.base import RustFile, args_of, ast, attrs, has_attr, in_test, inherent, last_of, leaves, owner, public, public_types, referent, rule, strip, uses

_BUILTIN_ROOTS = set("alloc core std super self crate".split())


def ffi_package(file) -> bool:
    return bool(file.package and re.search(r"[-_](ffi|sys)$|^(ffi|sys)$", file.package))


def no_mangle(n) -> bool:
    return any("no_mangle" in a.compact_body for a in attrs(n))


@ast("rust_asref_bound_on_type", "low", "Types don't bound parameters by AsRef.")
def asref_bound_on_type(file, p):
    for t in file.of("Struct", "Enum"):
        names = {g.name for g in t.generics if g.kind == "TypeParam" and any(b.path is not None and b.path.names[-1] == "AsRef" for b in g.bounds)}
        names |= {w.type.compact for w in t.where if w.type is not None and any(b.path is not None and b.path.names[-1] == "AsRef" for b in w.bounds)}
        fields = [x for v in t.variants for x in v.fields] if t.kind == "Enum" else t.fields
        for g in sorted(names):
            if any(q.kind == "Path" and q.names[0] == g for f in fields for q in f.all("Path")):
                yield t, f"`{t.name}` bounds `{g}` by AsRef"


@ast("rust_concrete_io_param", "low", "Take a reader or writer, not a file.", types="File Stdin Stdout TcpStream UnixStream".split())
def concrete_io_param(file, p):
    for f in file.of("Fn"):
        for q in f.params:
            t = strip(q.type)
            t = referent(t) if t is not None else None
            if t is not None and t.kind == "PathType" and t.last_name in p["types"] and not in_test(f):
                names = t.path.names
                if len(names) == 1 or names[0] in ("std", "fs", "io", "net", "os", "unix") or (names[0] == "tokio" and len(names) > 2):
                    yield q, f"parameter of type `{t.last_name}`"


@ast("rust_dll_boundary_types", "high", "Only plain types cross a C interface.")
def dll_boundary_types(file, p):
    if "wasm_bindgen" in file.text:
        return
    for f in file.of("Fn"):
        abi = f.abi or (f.parent.abi if f.parent is not None and f.parent.kind == "ExternBlock" else None)
        if not abi or not abi.startswith("C"):
            continue
        for t in [*(q.type for q in f.params if q.type is not None), f.ret]:
            m = t is not None and re.search(r"(?<!\w)(dyn|Box|Instant|String|TypeId|Vec)(?!\w)", t.text)
            if m:
                yield t, f"`{m.group(1)}` crosses a C interface"


@rule("rust_ffi_crate_naming", "rust-line", "low", "Crates of foreign interfaces are named so.")
def ffi_crate_naming(file, p):
    if not file.package or "wasm_bindgen" in file.text:
        return
    exports = [f for f in file.of("Fn") if f.abi == "C" and f.body is not None and no_mangle(f)]
    imports = [b for b in file.of("ExternBlock") if b.abi == "C"]
    if exports and not re.search(r"[-_]ffi$", file.package):
        yield exports[0].line, f"`{file.package}` exports C functions"
    if imports and not re.search(r"[-_]sys$", file.package):
        yield imports[0].line, f"`{file.package}` binds C functions"


@ast("rust_ffi_in_core", "medium", "Foreign interfaces have a crate of their own.")
def ffi_in_core(file, p):
    if not file.package or ffi_package(file) or "wasm_bindgen" in file.text:
        return
    for f in file.of("Fn"):
        if f.abi == "C" and no_mangle(f):
            yield f, f"`{f.name}` is exported from a core crate"
    for s in file.of("Struct"):
        if any(a.name == "repr" and re.search(r"\(.*\bC\b", a.compact_body) for a in attrs(s)) and any(strip(x.type).kind == "PtrType" for x in s.fields):
            yield s, f"`{s.name}` holds foreign pointers in a core crate"


@ast("rust_ffi_thin_glue", "low", "Foreign functions only call on.", threshold=25)
def ffi_thin_glue(file, p):
    if not ffi_package(file):
        return
    for f in file.of("Fn"):
        if f.abi == "C" and f.body is not None and f.body.end_line - f.body.line > p["threshold"]:
            yield f, f"`{f.name}` is {f.body.end_line - f.body.line} lines long"


@ast("rust_foreign_reexports", "medium", "Items of other crates aren't re-exported.", allowed=[], members=[])
def foreign_reexports(file, p):
    local = {m.name for m in file.of("Module")}
    for u in file.of("Use"):
        if u.vis != "pub" or in_test(u) or any(a.name == "doc" and "hidden" in a.compact_body for a in attrs(u)):
            continue
        if any(m.name in ("_private", "__private") for m in u.up("Module")):
            continue
        root = next((path[0] for path, *_ in leaves(u.tree) if path), None)
        if root and root not in _BUILTIN_ROOTS and root not in local and root not in p["allowed"] and root not in p["members"]:
            yield u, f"`{root}` is re-exported"


@ast("rust_future_send_assert", "low", "Futures written by hand are asserted to be Send.")
def future_send_assert(file, p):
    for i in file.of("Impl"):
        if last_of(i.trait) == "Future" and not re.search(r"assert_send\w*[^>]*?(?<!\w)" + re.escape(last_of(i.type)) + r"(?!\w)[^>]*>?", file.text):
            yield i, f"`{last_of(i.type)}` isn't asserted to be Send"


@ast("rust_manual_async_fn", "low", "Write async fn.")
def manual_async_fn(file, p):
    for f in file.of("Fn"):
        o = owner(f)
        if "async" in f.flags or f.body is None or (o is not None and (o.kind == "Trait" or o.trait is not None)) or f.ret is None or f.ret.kind != "ImplTraitType":
            continue
        if any(b.path is not None and b.path.names[-1] == "Future" for b in f.ret.bounds) and len(f.body.stmts) == 1:
            s = f.body.stmts[0]
            if s.kind == "BlockExpr" and s.modifier == "async":
                yield f, f"`{f.name}` returns an async block"


@ast("rust_native_escape_hatches", "low", "Wrappers of native handles convert both ways.")
def native_escape_hatches(file, p):
    for s in file.of("Struct"):
        if not public(s) or len(s.fields) != 1 or strip(s.fields[0].type).kind != "PtrType" or in_test(s):
            continue
        own = {f.name: f for f in file.of("Fn") if inherent(f) is not None and last_of(inherent(f).type) == s.name}
        if "from_native" not in own:
            yield s, f"`{s.name}` has no from_native"
        elif "unsafe" not in own["from_native"].flags:
            yield own["from_native"], "from_native isn't unsafe"
        for name in ("into_native", "to_native"):
            if name not in own:
                yield s, f"`{s.name}` has no {name}"


@ast("rust_nonsend_across_await", "medium", "Values that aren't Send don't live across await.")
def nonsend_across_await(file, p):
    blocks = [f.body for f in file.of("Fn") if "async" in f.flags and f.body is not None] + [b for b in file.of("BlockExpr") if b.modifier == "async"]
    for b in blocks:
        for k, s in enumerate(b.stmts):
            if s.kind == "LetStmt" and s.value is not None and re.match(r"(\w+::)*(Rc::(new|clone)|RefCell::new)\(", s.value.compact):
                if any(a.nearest("ClosureExpr", "Fn", "BlockAsync") is b.nearest("ClosureExpr", "Fn") and not any(u.modifier == "async" for u in a.up("BlockExpr") if u.pre > b.pre) for t in b.stmts[k + 1 :] for a in ([t, *t.all("AwaitExpr")]) if a.kind == "AwaitExpr") if b.parent.kind != "Fn" or b.modifier == "async" else any(a.nearest("ClosureExpr", "Fn") is b.parent and not any(u.modifier == "async" for u in a.up("BlockExpr") if u.pre > b.pre) for t in b.stmts[k + 1 :] for a in [t, *t.all("AwaitExpr")] if a.kind == "AwaitExpr"):
                    yield s, "a value that isn't Send lives across an await"


@ast("rust_owned_ref_param", "medium", "Borrow slices, not containers.")
def owned_ref_param(file, p):
    for f in file.of("Fn"):
        for q in f.params:
            t = strip(q.type)
            if t is not None and t.kind == "RefType" and not t.mut and last_of(t.type) in ("String", "PathBuf", "Vec", "OsString"):
                yield q, f"parameter of type `{t.compact}`"


@ast("rust_pub_api_foreign_types", "low", "Public interfaces show few foreign types.", allowed=[], assume_external=[])
def pub_api_foreign_types(file, p):
    external = set(p["assume_external"])
    if not external:
        return
    found = uses(file)
    types = list(public_types(file))
    for e in file.of("Enum"):
        if public(e) and not in_test(e):
            types += [(x.type, e) for v in e.variants for x in v.fields]
    types += [(a.type, a) for a in file.of("TypeAlias") if public(a) and a.type is not None and not in_test(a)]
    for t, item in types:
        if any(a.name == "cfg" and "feature" in a.compact_body for n in [item, *item.up()] for a in attrs(n)):
            continue
        for q in [t, *t.all()]:
            if q.kind == "PathType":
                names = q.path.names
                full = found.get(names[0]) or names[0]
                root = full.split("::")[0]
                if (len(names) > 1 or "::" in full) and root in external and root not in p["allowed"]:
                    yield q, f"public interface shows `{root}`"


@ast("rust_range_over_rangebounds", "low", "Take RangeBounds.")
def range_over_rangebounds(file, p):
    for f in file.of("Fn"):
        if public(f) and not in_test(f):
            for q in f.params:
                t = strip(q.type)
                if t is not None and t.kind == "PathType" and "::".join(t.path.names) in ("Range", "std::ops::Range"):
                    yield q, "parameter of type Range"


@ast("rust_macro_hidden_items", "medium", "Macros don't add public items of fixed names.")
def macro_hidden_items(file, p):
    for m in file.of("MacroCall"):
        if m.name not in ("quote", "quote_spanned") or not m.body:
            continue
        body = m.body
        if m.name == "quote_spanned":
            k = next((i for i, t in enumerate(body) if t.text == "=>"), -1)
            body = body[k + 1 :]
        if not body:
            continue
        text = file.text[body[0].start : body[-1].end]
        base = file.line_at(body[0].start)
        for i, t in enumerate(body[:-2]):
            if t.text == "pub":
                k = i + 1
                while k < len(body) and body[k].text in ("const", "async", "unsafe", "extern"):
                    k += 1
                if k + 1 < len(body) and body[k].text in ("struct", "enum", "trait", "fn") and body[k + 1].kind == "ident":
                    depth = sum((x.text == "{") - (x.text == "}") for x in body[:i])
                    inside_impl = depth > 0 and any(x.text == "impl" for x in body[:i])
                    if not inside_impl:
                        yield base + text[: t.start - body[0].start].count("\n"), f"a macro adds public `{body[k + 1].text}`"


@ast("rust_proc_macro_thin_shim", "low", "Procedural macros only call on.")
def proc_macro_thin_shim(file, p):
    for f in file.of("Fn"):
        if has_attr(f, "proc_macro", "proc_macro_derive", "proc_macro_attribute") and f.body is not None:
            body = f.body.stmts
            ok = len(body) == 1 and re.match(r"(\w+::)+\w+\((\w+(\.into\(\))?,?)*\)\.into\(\)$", body[0].compact)
            if not ok:
                yield f, f"`{f.name}` holds logic"


__all__ = ["RustFile", "args_of"]
