"""Rules on safety and secrets."""

from __future__ import annotations

import re

from corposieve.rules.base import ast, bare, callee, derived, docs, in_test, last_of, nearest_fn, owner, preceded, rule, string_value, strip, uses


_HOMES = r"/Users/ /home/ C:\\Users\\ C:\Users\ ".split()


@rule("rust_abs_home_path", "rust-line", "medium", "Code holds no home folder.")
def abs_home_path(file, p):
    for i, line in enumerate(file.lines, 1):
        if '"' in line and not line.strip().startswith("//"):
            m = next((x for x in _HOMES if x in line), None)
            if m:
                yield i, f"a path in a home folder: {m}"


_SYSCALLS = re.compile(
    r"(std::)?fs::\w+$|(std::)?env::(args|args_os|current_dir|home_dir|set_var|temp_dir|var|var_os|vars|remove_var|set_current_dir|current_exe)$|(std::)?thread::(sleep|spawn|park)$|(std::)?io::(stdin|stdout|stderr)$"
    r"|.*\bFile::(open|create)$|.*\bTcpStream::connect$|.*::bind$|.*\b(SystemTime|Instant)::now$|(std::)?process::Command::new$|Command::new$|rand::\w+$|.*\bthread_rng$"
)


@ast("rust_ambient_syscall", "medium", "Access to the system is passed in.")
def ambient_syscall(file, p):
    found = uses(file)
    for c in file.of("CallExpr"):
        path = callee(c)
        if not path or in_test(c):
            continue
        full = found.get(path[0])
        name = "::".join([full, *path[1:]]) if full else "::".join(path)
        if name.startswith("io::stdout") or name.endswith(("io::stdout", "io::stderr")):
            continue
        if _SYSCALLS.match(name):
            yield c, f"`{name}` reaches the system directly"


#: Compilers, which a build has anyway, and what crates that build a C library may run besides.
_COMPILERS = {"c++", "cargo", "cc", "clang", "gcc", "rustc"}
_MAKERS = {"bash", "cmake", "make", "ninja", "sh"}


@ast("rust_build_rs_external_tool", "medium", "Build scripts run no outside tools.")
def build_rs_external_tool(file, p):
    if not file.rel.endswith("build.rs"):
        return
    folder = file.rel.split("/")[-2] if "/" in file.rel else ""
    tools = _COMPILERS | (_MAKERS if re.search("[-_]sys$", folder) else set())
    for c in file.of("CallExpr", "MethodCallExpr", "TryExpr"):
        if c.kind == "CallExpr":
            path = callee(c)
            if len(path) >= 2 and path[-2:] == ["Command", "new"] and c.args and c.args[0].kind == "Literal":
                if string_value(c.args[0].value) not in tools:
                    yield c, f"the build runs {c.args[0].value}"
            elif path and path[0] in ("bindgen", "pkg_config"):
                yield c, f"the build calls {path[0]}"
        else:
            inner = c.receiver if c.kind == "MethodCallExpr" and c.name in ("unwrap", "expect") else c.expr if c.kind == "TryExpr" else None
            if inner is not None and inner.kind == "CallExpr" and (callee(inner) or [""])[-2:] == ["env", "var"]:
                yield c, "the build needs a variable"


_MATCHING = ("starts_with", "ends_with", "contains", "strip_prefix", "strip_suffix", "trim_start_matches", "trim_end_matches", "find", "rfind", "split", "replace", "eq", "matches")


@ast("rust_hardcoded_url", "medium", "Addresses are configured.")
def hardcoded_url(file, p):
    def address(token):
        return bool(re.match(r"\s*https?://\S", string_value(token)))

    for n in file.of("Literal"):
        if n.lit != "str" or not n.value.endswith(('"', "#")) or not address(n.value) or in_test(n) or n.nearest("Const", "Static", "Attr") is not None:
            continue
        u = n.parent
        if u.kind == "MethodCallExpr" and u.receiver is not n and (u.name in _MATCHING or "get_or" in u.name):
            continue
        if u.kind == "CallExpr" and "get_or" in ((callee(u) or [""])[-1]):
            continue
        yield n, "an address in code"
    for m in file.of("MacroCall"):
        if in_test(m) or m.nearest("Const", "Static") is not None:
            continue
        for t in m.body:
            if t.kind == "str" and address(t.text):
                yield m, "an address in code"
                break


@ast("rust_mutex_in_async", "high", "Async code takes async locks.", default=False)
def mutex_in_async(file, p):
    for n in file.of("PathExpr", "PathType"):
        names = n.path.names
        k = next((i for i in range(len(names) - 1) if names[i] == "sync" and names[i + 1] == "Mutex"), None)
        if k is not None and not (k and names[k - 1] == "tokio"):
            f = nearest_fn(n)
            if f is not None and "async" in f.flags:
                yield n, "a blocking lock in async code"


@ast(
    "rust_sensitive_debug", "high", "Debug output shows no secrets.", allowed_fields=[],
    markers="token signing_key secret private_key passwd password credentials credential bearer authorization api_key".split(), redacted_types="Secret SecretBox SecretString SecretVec Sensitive".split(),
)
def sensitive_debug(file, p):
    def secret(t):
        t = strip(t)
        if t is None:
            return False
        return (t.kind == "PathType" and (t.last_name in p["redacted_types"] or any(secret(a) for a in t.args or []))) or (t.kind == "RefType" and secret(t.type))

    for s in file.of("Struct"):
        if derived(s, "Debug"):
            bad = [f.name for f in s.fields if any(f.name == m or f.name.startswith(m + "_") or f.name.endswith("_" + m) for m in p["markers"]) and f.name not in p["allowed_fields"] and not secret(f.type)]
            if bad:
                yield s, f"`{s.name}` shows {', '.join(bad)}"


@ast("rust_unsafe_comment", "high", "Unsafe blocks are justified.")
def unsafe_comment(file, p):
    for b in file.of("BlockExpr"):
        if b.modifier == "unsafe" and not preceded(file, b.line, "SAFETY:"):
            yield b, "unsafe without a SAFETY comment"


@ast("rust_unsafe_fn_safety_doc", "high", "Unsafe functions document their contract.")
def unsafe_fn_safety_doc(file, p):
    for f in file.of("Fn"):
        o = owner(f)
        if "unsafe" not in f.flags or (o is not None and (o.kind != "Impl")):
            continue
        line = file.line_at(file.tokens[f.vis_at].start)
        if not any("# Safety" in d for d in docs(f)) and not preceded(file, f.line, "SAFETY:") and not preceded(file, line, "SAFETY:"):
            yield f, f"`{f.name}` doesn't document its contract"


@rule("rust_unsafe_impl_send", "rust-line", "high", "Send and Sync by hand are justified.")
def unsafe_impl_send(file, p):
    for i, code in enumerate(file.code, 1):
        m = re.match(r"\s*unsafe\s+impl\s*(<.*?>)?\s*(?:[\w:]*::)?(Send|Sync)\s+for\s", code)
        if m:
            if m.group(1) and re.search(r"<\s*(?!')\w|,\s*(?!')\w", m.group(1)):
                yield i, f"{m.group(2)} for all types"
            elif not preceded(file, i, "SAFETY:"):
                yield i, f"{m.group(2)} without a SAFETY comment"


@ast("rust_unsafe_without_ub_surface", "low", "Only functions that can go wrong are unsafe.")
def unsafe_without_ub_surface(file, p):
    for f in file.of("Fn"):
        if "unsafe" not in f.flags or f.abi or f.body is None or any("no_mangle" in a.compact_body for a in (f.attrs or []) if a.kind == "Attr"):
            continue
        o = owner(f)
        if o is not None and (o.kind == "Trait" or o.trait is not None):
            continue
        signature = "".join(x.compact for x in [*(q.type for q in f.params if q.type is not None), f.ret] if x is not None)
        deref = any(n.op == "*" for n in f.body.all("PrefixExpr")) or any(b.modifier == "unsafe" for b in f.body.all("BlockExpr"))
        if "*" not in signature and "NonNull" not in signature and not deref:
            yield f, f"`{f.name}` has no need to be unsafe"


__all__ = ["bare", "last_of"]
