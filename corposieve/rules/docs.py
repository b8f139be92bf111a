"""Rules on documentation comments."""

from __future__ import annotations

import re

from corposieve.rules.base import ast, attrs, callee, docs, in_test, last_of, owner, public, rule


def _heading(lines, *names) -> bool:
    return any(re.match(r"\s*#+\s*(" + "|".join(names) + r")\s*$", x) for x in lines)


@ast("rust_doc_errors_section", "medium", "Fallible functions document their errors.")
def doc_errors_section(file, p):
    for f in file.of("Fn"):
        o = owner(f)
        if public(f) and docs(f) and last_of(f.ret).endswith("Result") and not (o is not None and o.kind != "Impl") and not in_test(f) and not _heading(docs(f), "Errors"):
            yield f, f"`{f.name}` doesn't document its errors"


@ast("rust_doc_panics_section", "medium", "Functions that panic document it.")
def doc_panics_section(file, p):
    items = ("Fn", "Impl", "Struct", "Enum", "Module", "Trait", "Const", "Static")
    for f in file.of("Fn"):
        if not public(f) or not docs(f) or f.body is None or in_test(f) or any(a.name == "doc" and "hidden" in a.compact_body for a in attrs(f)) or _heading(docs(f), "Panics"):
            continue
        for n in f.body.all("MacroCall", "MethodCallExpr", "CallExpr"):
            if n.nearest(*items) is not f:
                continue
            path = (callee(n) or [""]) if n.kind == "CallExpr" else [""]
            if (n.kind == "MacroCall" and re.match(r"(panic|assert|assert_eq|assert_ne)$", n.name)) or (n.kind == "MethodCallExpr" and (n.name == "expect" or n.name == "unwrap" and not n.args)) or (len(path) > 1 and path[-1] in ("unwrap", "expect")):
                yield f, f"`{f.name}` doesn't document its panics"
                break


def doc_content(line: str) -> str | None:
    t = line.strip()
    return t[3:] if t.startswith(("///", "//!")) else None


@rule("rust_doc_param_table", "rust-line", "low", "Parameters are described in prose.")
def doc_param_table(file, p):
    fenced = False
    for i, line in enumerate(file.lines, 1):
        d = doc_content(line)
        if d is None:
            fenced = False
            continue
        t = d.strip()
        if t.startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and re.match(r"#+\s*(parameters|arguments|params)\s*:?$", t, re.I):
            yield i, "a section of parameters"


@rule("rust_doc_comment_period", "rust-line", "low", "Documentation lines end in punctuation.")
def doc_comment_period(file, p):
    fenced = False
    for i, line in enumerate(file.lines, 1):
        d = doc_content(line)
        if d is None:
            fenced = False
            continue
        t = d.strip()
        if t.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        after = file.lines[i] if i < len(file.lines) else ""
        if fenced or not t or t.startswith("#") or d.startswith("  ") or d.startswith(" \t"):
            continue
        nxt = doc_content(after)
        if nxt is not None and nxt.strip() and not nxt.strip().startswith(("#", "```", "- ", "* ", "|")) and False:
            continue
        if t[-1] not in ".):!?`]":
            yield i, "a documentation line doesn't end in punctuation"


@rule("rust_first_doc_sentence", "rust-line", "low", "The first sentence is short and on the first line.", max_words=15)
def first_doc_sentence(file, p):
    block: list[tuple[int, str]] = []

    def judge():
        lines, fenced = [], False
        for i, d in block:
            if d.strip().startswith(("```", "~~~")):
                fenced = not fenced
            elif not fenced:
                lines.append((i, d.strip()))
        if not lines:
            return
        i, first = lines[0]
        if not first:
            if any(d for _, d in lines):
                yield i, "the first documentation line is empty"
            return
        if first.startswith("#"):
            return
        m = re.search(r"[.!?](?=\s|$)", first)
        if not m and not first.endswith((":", ")", "`")) and len(lines) > 1 and lines[1][1]:
            yield i, "the first sentence goes on beyond its line"
        elif len(re.split(r"\s+", (first[: m.end()] if m else first).strip())) > p["max_words"]:
            yield i, "the first sentence is long"

    kind = None
    for i, line in enumerate([*file.lines, ""], 1):
        t = line.strip()
        now = t[:3] if t.startswith(("///", "//!")) and not t.startswith("////") else None
        if now is None or (kind is not None and now != kind):
            yield from judge()
            block = []
        kind = now
        if now:
            block.append((i, t[3:]))


@rule("rust_doc_inline_reexport", "rust-line", "low", "Re-exports of one's own items are inlined, others aren't.")
def doc_inline_reexport(file, p):
    for i, line in enumerate(file.lines, 1):
        t, before = line.strip(), file.lines[i - 2].strip() if i > 1 else ""
        if re.match(r"pub use (crate|self|super)::", t) and not re.search(r"#\[doc\((inline|hidden)\)\]", before):
            yield i, "a re-export isn't inlined in the documentation"
        if t.startswith("#[doc(inline)]"):
            rest = t.removeprefix("#[doc(inline)]").strip() or (file.lines[i].strip() if i < len(file.lines) else "")
            if re.match(r"pub use (std|core|alloc)::", rest):
                yield i, "a foreign item is inlined in the documentation"


@rule("rust_module_docs", "rust-line", "medium", "A file starts with its documentation.")
def module_docs(file, p):
    rel = file.rel
    name = rel.rpartition("/")[2]
    if name != "lib.rs" and (file.test_only or name in ("main.rs", "build.rs") or "/bin/" in "/" + rel):
        return
    depth = 0
    for i, line in enumerate(file.lines, 1):
        t = line.strip()
        if depth > 0 or t.startswith("#!["):
            depth += t.count("[") - t.count("]")
            continue
        if not t or t.startswith("// #rw(") or (t.startswith("#!") and not t.startswith("#![")):
            continue
        if not t.startswith("//!"):
            yield i, "the file has no module documentation"
        return
    yield 1, "the file has no module documentation"
