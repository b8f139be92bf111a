"""Rules on the design of public interfaces."""

from __future__ import annotations

import re
from collections import defaultdict

from corposieve.rules.base import (
    args_of, ast, attr_args, attrs, bare, derived, derives, docs, has_attr, in_test, inherent, last_of, leaves, nearest_fn, owner, public, public_types, referent, result_args, returns_self, rule, strip,
)

_ADAPTERS = {"map", "filter", "for_each", "filter_map", "flat_map", "any", "all", "find", "find_map", "position", "fold", "take_while", "skip_while", "map_while", "inspect", "partition", "scan"}
_TERMINAL = re.compile(r"(build|try_build|finish|into_\w+)$")


def methods(file, only_inherent=True):
    out = defaultdict(list)
    for f in file.of("Fn"):
        o = owner(f)
        if o is not None and o.kind == "Impl" and not (only_inherent and o.trait is not None):
            out[last_of(o.type)].append(f)
    return out


def impls(file):
    """(trait's last name, type's last name) of trait impls."""
    return {(last_of(i.trait), last_of(i.type)) for i in file.of("Impl") if i.trait is not None}


@ast("rust_assoc_fn_no_self", "low", "An associated function that names neither Self nor its type could be free.")
def assoc_fn_no_self(file, p):
    for f in file.of("Fn"):
        o = inherent(f)
        if o is None or f.self_param is not None or re.match(r"(new|default|builder)$|(from_|with_|try_|new_)", f.name):
            continue
        signature = " ".join(x.text for x in [*(q.type for q in f.params if q.type), f.ret] if x is not None)
        if "Self" not in signature and last_of(o.type) not in signature:
            yield f, f"associated function `{f.name}` doesn't involve its type"


@ast("rust_builder_conventions", "medium", "A builder has a terminal method, plain setters that take self, and an entry on its target.")
def builder_conventions(file, p):
    own = methods(file)
    structs = {s.name: s for s in file.of("Struct") if public(s)}
    for name, s in structs.items():
        if not name.endswith("Builder") or name == "Builder" or in_test(s) or not own.get(name):
            continue
        target, found = name.removesuffix("Builder"), own[name]
        if not any(_TERMINAL.match(f.name) for f in found):
            yield s, f"builder `{name}` has no terminal method"
        has_target = target in structs
        if has_target and any(f.name == "new" and public(f) for f in found):
            yield s, f"builder `{name}` has a public `new` beside `{target}`"
        for f in found:
            ref = f.ret is not None and referent(f.ret) is not None and last_of(referent(f.ret)) in ("Self", name)
            if f.self_param is None or not ref:
                continue
            if re.match(r"(set|with)_", f.name):
                yield f, f"setter `{f.name}` carries a prefix"
            if f.self_param.is_ref:
                yield f, f"setter `{f.name}` borrows self"
        if has_target and not any(f.name == "builder" or f.name.startswith("builder_") for f in own.get(target, [])):
            yield s, f"`{target}` has no `builder` function"


@ast("rust_builder_fallible_setter", "medium", "Builder methods other than the terminal one don't fail.")
def builder_fallible_setter(file, p):
    for f in file.of("Fn"):
        o = inherent(f)
        if o is not None and last_of(o.type).endswith("Builder") and f.self_param is not None and last_of(f.ret) == "Result" and not _TERMINAL.match(f.name) and not in_test(f):
            yield f, f"builder method `{f.name}` returns a Result"


@ast("rust_builder_param", "low", "Take the built value rather than its builder.")
def builder_param(file, p):
    for f in file.of("Fn"):
        for q in f.params:
            t = strip(q.type)
            if t is not None and t.kind == "RefType":
                if t.mut:
                    continue
                t = strip(t.type)
            if re.search(r"(Builder|Factory)$", last_of(t)) and not in_test(f):
                yield q, f"parameter of type `{last_of(t)}`"


@ast("rust_collection_trait_completeness", "low", "Iteration methods and collection traits come together.")
def collection_trait_completeness(file, p):
    have = set()
    ref_iter, mut_iter = set(), set()
    for i in file.of("Impl"):
        if i.trait is None:
            continue
        t = strip(i.type)
        name = last_of(referent(t))
        if last_of(i.trait) == "IntoIterator" and t.kind == "RefType":
            (mut_iter if t.mut else ref_iter).add(name)
        else:
            have.add((last_of(i.trait), name))
    for ty, found in methods(file).items():
        for f in found:
            if in_test(f) or f.self_param is None or f.params or not f.self_param.is_ref:
                continue
            if f.name == "iter" and not f.self_param.is_mut and ty not in ref_iter:
                yield f, f"`{ty}` has `iter` but no IntoIterator for &{ty}"
            if f.name == "iter_mut" and f.self_param.is_mut and ty not in mut_iter:
                yield f, f"`{ty}` has `iter_mut` but no IntoIterator for &mut {ty}"
    for i in file.of("Impl"):
        for a, b in (("FromIterator", "Extend"), ("Extend", "FromIterator")):
            if last_of(i.trait) == a and (b, last_of(i.type)) not in have and not in_test(i):
                yield i, f"`{last_of(i.type)}` has {a} but no {b}"


@ast("rust_ctor_new", "low", "A public type with private fields and a Default has a constructor.")
def ctor_new(file, p):
    have, own = impls(file), methods(file)
    for s in file.of("Struct"):
        if public(s) and not in_test(s) and any(f.vis != "pub" for f in s.fields) and (derived(s, "Default") or ("Default", s.name) in have):
            if not any(public(f) and f.self_param is None and returns_self(f, s.name) for f in own.get(s.name, [])):
                yield s, f"`{s.name}` has no public constructor"


_PRIMITIVE = frozenset("bool char str String f32 f64 isize usize".split()) | {f"{k}{n}" for k in "iu" for n in (8, 16, 32, 64, 128)}


@ast("rust_ctor_param_count", "medium", "Constructors with many parameters need a builder.", threshold=5)
def ctor_param_count(file, p):
    for f in file.of("Fn"):
        o = inherent(f)
        if o is None or f.self_param is not None or not (f.name == "new" or f.name.startswith(("new_", "with_"))) or not returns_self(f, last_of(o.type)):
            continue
        if len(f.params) >= p["threshold"]:
            yield f, f"constructor `{f.name}` takes {len(f.params)} parameters"
        run, best, before = 0, 0, None
        for q in f.params:
            t = strip(q.type)
            name = "&str" if t is not None and t.kind == "RefType" and last_of(t.type) == "str" else last_of(t) if last_of(t) in _PRIMITIVE else None
            run = run + 1 if name and name == before else 1 if name else 0
            best, before = max(best, run), name
        if best >= 3:
            yield f, f"constructor `{f.name}` takes {best} alike parameters in a row"


@ast("rust_dyn_wrapper_in_api", "low", "Public interfaces don't show wrapped trait objects.")
def dyn_wrapper_in_api(file, p):
    for t, _ in public_types(file):
        for x in [t, *t.all("PathType")]:
            if x.kind == "PathType" and x.last_name in ("Arc", "Box", "Rc"):
                for a in args_of(x)[:1]:
                    if a.kind == "DynTraitType" and "Error" not in a.text:
                        yield x, f"public interface shows `{x.compact}`"


def _error_types(file):
    return [t for t in file.of("Struct", "Enum") if public(t) and t.name.endswith("Error") and not in_test(t)]


@ast("rust_error_missing_traits", "medium", "Public error types implement Display and Error.")
def error_missing_traits(file, p):
    have = impls(file)
    for t in _error_types(file):
        by_derive = derived(t, "Error")
        marked = by_derive or has_attr(t, "error") or any(has_attr(v, "error") for v in t.variants or [])
        if not marked and ("Display", t.name) not in have:
            yield t, f"error `{t.name}` has no Display"
        if not by_derive and ("Error", t.name) not in have:
            yield t, f"error `{t.name}` doesn't implement Error"


@ast("rust_error_type_unit", "medium", "The unit type says nothing as an error.")
def error_type_unit(file, p):
    for f in file.of("Fn"):
        a = result_args(f.ret)
        if a and len(a) > 1 and a[1].kind == "TupleType" and not a[1].types and not in_test(f):
            yield f.ret, f"`{f.name}` returns a unit error"


@ast("rust_fallible_in_iterator", "medium", "Don't unwrap within iterator adapters.")
def fallible_in_iterator(file, p):
    for c in file.of("MethodCallExpr"):
        if c.name in ("unwrap", "expect") and not in_test(c):
            closure = c.nearest("ClosureExpr")
            call = closure.nearest("MethodCallExpr") if closure is not None else None
            if call is not None and call.name in _ADAPTERS:
                yield c, f"`{c.name}` within `{call.name}`"


@ast("rust_glob_reexport", "medium", "Re-export names, not globs.")
def glob_reexport(file, p):
    for u in file.of("Use"):
        if u.vis and not in_test(u) and not any(a.name == "cfg" and re.search(r"windows|unix|target_os=|target_arch=", a.compact_body) for a in attrs(u)):
            for _, star, _, leaf in leaves(u.tree):
                if star:
                    yield leaf, "a glob is re-exported"


@ast("rust_impl_into_for_owned", "medium", "Implement From rather than Into.")
def impl_into_for_owned(file, p):
    for i in file.of("Impl"):
        if last_of(i.trait) == "Into":
            yield i, "Into is implemented by hand"


@ast("rust_manual_error_impl", "low", "Derive error traits.")
def manual_error_impl(file, p):
    names = {f"{a}{b}" for b in ("Display",) for a in ("", "fmt::", "std::fmt::", "core::fmt::")} | {f"{a}Error" for a in ("", "error::", "std::error::", "core::error::")}
    for i in file.of("Impl"):
        if i.trait is not None and last_of(i.type).endswith("Error") and i.trait.compact in names and not in_test(i):
            yield i, f"`{i.trait.compact}` is implemented by hand for `{last_of(i.type)}`"


@ast("rust_map_err_pure_wrap", "low", "The question mark converts errors by itself.")
def map_err_pure_wrap(file, p):
    for c in file.of("MethodCallExpr"):
        if c.name != "map_err" or len(c.args) != 1 or c.parent.kind != "TryExpr" or c.args[0].kind != "PathExpr":
            continue
        path = c.args[0].path
        f = c.nearest("Fn", "ClosureExpr")
        if f is None or f.kind != "Fn" or (owner(f) is not None and owner(f).trait is not None):
            continue
        a = result_args(f.ret)
        error = a[1].compact if a and len(a) > 1 else None
        q = path.qself
        if path.names[-1] == "from" and q is not None and q.compact == error and re.match(r"<.*as(\w+::)*From<.*>>::from$", c.args[0].compact):
            yield c, "map_err only wraps what `?` converts"


@ast("rust_missing_debug", "low", "Public types have Debug.", fixable=True)
def missing_debug(file, p):
    have = impls(file)
    for t in file.of("Struct", "Enum"):
        if public(t) and not in_test(t) and not derived(t, "Debug") and ("Debug", t.name) not in have:
            yield t, f"`{t.name}` has no Debug"


@ast("rust_missing_error_context", "medium", "map_err keeps the error it got.")
def missing_error_context(file, p):
    for c in file.of("MethodCallExpr"):
        if c.name == "map_err" and c.args and c.args[0].kind == "ClosureExpr" and c.args[0].params and c.args[0].params[0].text.startswith("_") and not in_test(c):
            f = nearest_fn(c)
            if f is None or not any("clippy::map_err_ignore" in a.compact_body and a.name == "expect" and "reason" in a.compact_body for a in attrs(f)):
                yield c, "map_err drops the error it got"


@ast("rust_non_exhaustive_on_public", "medium", "Public enums are non_exhaustive.")
def non_exhaustive_on_public(file, p):
    for e in file.of("Enum"):
        if public(e) and not in_test(e) and not has_attr(e, "non_exhaustive"):
            yield e, f"enum `{e.name}` is exhaustive"


@ast("rust_pub_api_docs", "low", "Public items are documented.")
def pub_api_docs(file, p):
    for n in file.of("Fn", "Struct", "Enum", "Trait", "TypeAlias", "Const", "Static"):
        if public(n) and not in_test(n) and not docs(n) and not has_attr(n, "doc"):
            yield n, f"`{n.name}` has no documentation"


_STD = {"Vec", "Option", "Result", "Box", "Arc", "Rc", "HashMap", "HashSet", "BTreeMap", "BTreeSet", "VecDeque", "LinkedList", "BinaryHeap", "Cell", "RefCell", "Mutex", "RwLock", "Cow", "Pin", "PhantomData", "Weak"}


@ast("rust_pub_api_generic_nesting", "low", "Generic types of one's own aren't nested in public interfaces.")
def pub_api_generic_nesting(file, p):
    def local(t):
        return t.kind == "PathType" and bool(args_of(t)) and t.last_name not in _STD and (len(t.path.names) == 1 or t.path.names[0] in ("crate", "self", "super"))

    seen = []
    aliases = [a.type for a in file.of("TypeAlias") if public(a) and a.type is not None and not in_test(a)]
    for t in [*(t for t, _ in public_types(file)), *aliases]:
        for x in [t, *t.all("PathType")]:
            if x.kind == "PathType" and local(x) and any(local(a) for a in args_of(x)) and not any(s.first <= x.first and x.last <= s.last for s in seen):
                seen.append(x)
                yield x, f"nested generic type `{x.compact}`"


@ast("rust_pub_api_smart_pointers", "medium", "Smart pointers stay out of public interfaces.")
def pub_api_smart_pointers(file, p):
    for t, _ in public_types(file):
        name, a = last_of(t), args_of(t)
        if name in "Rc Arc Box Cell RefCell Mutex RwLock".split():
            inner = strip(a[0]) if a else None
            if inner is not None and ((name in ("Arc", "Box", "Rc") and inner.kind == "DynTraitType") or (name == "Box" and (inner.kind == "SliceType" or last_of(inner) == "str"))):
                continue
            yield t, f"public interface shows `{name}`"


@ast("rust_public_error_enum", "medium", "Error enums stay private behind a struct.")
def public_error_enum(file, p):
    for e in file.of("Enum"):
        if public(e) and re.search(r"Error(Kind)?$", e.name) and not in_test(e):
            yield e, f"error enum `{e.name}` is public"


@ast("rust_single_item_path", "medium", "An item has one public path.")
def single_item_path(file, p):
    for scope in [file.root, *file.of("Module")]:
        items = scope.items or []
        open_ = {m.name for m in items if m.kind == "Module" and public(m) and not m.name.startswith("_") and not any(a.name == "doc" and "hidden" in a.compact_body for a in attrs(m))}
        for u in items:
            if u.kind == "Use" and public(u) and not in_test(u) and not any(a.name == "doc" and "hidden" in a.compact_body for a in attrs(u)):
                for path, _, _, leaf in leaves(u.tree):
                    path = path[1:] if path[:1] == ["self"] else path
                    if path and path[0] in open_:
                        yield leaf, f"`{'::'.join(path)}` has a second public path"


@ast("rust_string_error", "medium", "Strings aren't errors.")
def string_error(file, p):
    for f in file.of("Fn"):
        a = result_args(f.ret)
        if a and len(a) > 1 and re.match(r"(String|&.*str)$", a[1].compact) and not in_test(f):
            yield f.ret, f"`{f.name}` returns a string as its error"


@ast("rust_trait_logic_not_inherent", "low", "Logic belongs in inherent methods.", threshold=3)
def trait_logic_not_inherent(file, p):
    local, own = {t.name for t in file.of("Trait")}, methods(file)
    for i in file.of("Impl"):
        if last_of(i.trait) in local:
            for f in i.items:
                if f.kind == "Fn" and f.body is not None and len(f.body.stmts) > p["threshold"] and not any(m.name == f.name for m in own.get(last_of(i.type), [])):
                    yield f, f"`{f.name}` of trait `{last_of(i.trait)}` holds its logic itself"


@ast("rust_unbalanced_crate_root", "low", "A crate's root shows its main items.", max_root_items=40, min_modules_for_empty_root=8)
def unbalanced_crate_root(file, p):
    if not file.rel.endswith("lib.rs"):
        return
    items = [n for n in file.root.items if n.kind in ("Fn", "Struct", "Enum", "Trait", "TypeAlias", "Const", "Static", "Union", "Use", "Module", "MacroRules") and not in_test(n)]
    modules = [n for n in items if n.kind == "Module" and public(n)]
    shown = [n for n in items if public(n) and n.kind not in ("Use", "Module")]
    uses_ = [n for n in items if public(n) and n.kind == "Use"]
    if len(shown) > p["max_root_items"]:
        yield 1, f"the root has {len(shown)} public items"
    elif not shown and not uses_ and len(modules) >= p["min_modules_for_empty_root"]:
        yield 1, f"the root has {len(modules)} public modules and nothing else"


@ast("rust_unwrap_in_lib", "medium", "Library code doesn't unwrap.")
def unwrap_in_lib(file, p):
    for c in file.of("MethodCallExpr"):
        if c.name == "unwrap" and not in_test(c):
            yield c, "`unwrap` may panic"


@rule("rust_no_prelude", "rust-line", "high", "Crates have no prelude.")
def no_prelude(file, p):
    if not file.package:
        return
    if re.search(r"/prelude(/mod)?\.rs$", file.rel):
        yield 1, "a prelude file"
    for i, code in enumerate(file.code, 1):
        if re.match(r"\s*(pub )?mod prelude\s*($|[;{])", code):
            yield i, "a prelude module"


__all__ = ["attr_args", "bare", "derives"]
