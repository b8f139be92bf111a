"""Rules on style."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from corposieve.rules.base import ast, attr_args, attrs, bare, camel, derives, in_test, inherent, is_test_item, joined, last_of, leaves, nearest_fn, owner, public, returns_self, rule, uses


def comment_content(line: str) -> str | None:
    t = line.strip()
    return re.sub(r"^//[/!]?", "", t) if t.startswith("//") else None


@ast("rust_attr_order", "low", "Attributes come in order: documentation, derives, others.", fixable=True)
def attr_order(file, p):
    for n in file.nodes:
        a = [x for x in n.f.get("attrs") or [] if not x.inner]
        if len(a) > 1 and n.kind in ("Fn", "Struct", "Enum", "Union", "Trait", "Impl", "Module", "Const", "Static", "TypeAlias", "Use"):
            ranks = [0 if x.kind == "Doc" or x.name == "doc" else 1 if x.name == "derive" else 2 for x in a]
            if ranks != sorted(ranks):
                yield n, "attributes are out of order"


@rule("rust_banner_comments", "rust-line", "low", "Comments have no banners.", fixable=True)
def banner_comments(file, p):
    for i, line in enumerate(file.lines, 1):
        t = line.strip()
        if t.startswith("//") and not t.startswith(("///", "//!")):
            d = t[2:].strip()
            if (re.fullmatch(r"[\s\-=*#~_]+", d) and re.search(r"[-=*#~_]{4}", d)) or re.match(r"[-=*#~_]{4,}.*[-=*#~_]{4,}$", d):
                yield i, "a banner"


@rule("rust_comment_space", "rust-line", "low", "A space follows the slashes.", fixable=True)
def comment_space(file, p):
    for i, line in enumerate(file.lines, 1):
        t = line.strip()
        if t.startswith("//") and len(t) > 2 and t[2] not in " /!#[":
            yield i, "no space after the slashes"


_CODE_PREFIX = ("let ", "fn ", "pub ", "if ", "for ", "while ", "match ", "return ", "use ", "struct ", "enum ", "impl ", "mod ", "const ", "static ", "} else", "}", "self.", "loop {", "break;", "continue;", "async fn", "unsafe {", "#[", "#![", "type ")
_CODE_PART = ("();", ") {", "; }", " = ", "::new(", ".unwrap()", "=> {", "->", "?;")


@rule("rust_commented_code", "rust-line", "low", "Dead code is removed.")
def commented_code(file, p):
    run = 0
    for i, line in enumerate(file.lines, 1):
        t = line.strip()
        d = t[3:] if t.startswith("// ") else None
        if d is None or d.startswith(("#rw(", "SAFETY", "NOTE", "TODO", "FIXME", "http", "- ", "* ", "e.g.", "i.e.")):
            run = 0
            continue
        s = d.strip()
        code = (s.startswith(_CODE_PREFIX) and s.endswith((";", "{", "}", ",", ")"))) or (s.endswith((";", "{")) and any(x in s for x in _CODE_PART)) or s in ("}", "};", ")", ");")
        run = run + 1 if code else 0
        if run >= 2:
            yield i, "code in a comment"


@ast("rust_conversion_self_convention", "medium", "Names of conversions tell how they take self.")
def conversion_self_convention(file, p):
    copy = {t.name for t in file.of("Struct", "Enum") if any(d.rpartition("::")[2] == "Copy" for d in derives(t))} | {last_of(i.type) for i in file.of("Impl") if last_of(i.trait) == "Copy"}
    for f in file.of("Fn"):
        o, s = owner(f), f.self_param
        if s is None or s.type is not None or (o is not None and o.kind == "Impl" and o.trait is not None):
            continue
        ty = last_of(o.type) if o is not None and o.kind == "Impl" else ""
        if not s.is_ref and (f.name.startswith("as_") or (f.name.startswith("to_") and ty not in copy)):
            yield f, f"`{f.name}` consumes self"
        if f.name.startswith("into_") and s.is_ref:
            yield f, f"`{f.name}` borrows self"


@ast("rust_derive_order", "low", "Derives are sorted.", fixable=True)
def derive_order(file, p):
    for a in file.of("Attr"):
        if a.name == "derive":
            names = [joined(x) for x in attr_args(a)]
            if names != sorted(names):
                yield a, "derives aren't sorted"


@rule("rust_duplicate_words", "rust-line", "low", "Words aren't repeated.", fixable=True)
def duplicate_words(file, p):
    for i, line in enumerate(file.lines, 1):
        d = comment_content(line)
        if d is not None:
            w = d.split()
            for a, b in zip(w, w[1:], strict=False):
                if a.lower() == b.lower():
                    yield i, f"`{a.lower()}` is repeated"
                    break


@ast("rust_excessive_float_precision", "low", "Floats have no more digits than they hold.")
def excessive_float_precision(file, p):
    for n in file.of("Literal"):
        m = n.lit == "num" and re.match(r"([\d_]*\.[\d_]*(?:[eE][+-]?[\d_]+)?)_?(f32|f64)$", n.value)
        if m:
            digits = re.sub(r"\D", "", re.split("[eE]", m.group(1))[0]).lstrip("0")
            if len(digits) > (8 if m.group(2) == "f32" else 17):
                yield n, f"{len(digits)} digits for an {m.group(2)}"


@ast("rust_getter_prefix", "low", "Getters are named for what they get.")
def getter_prefix(file, p):
    for f in file.of("Fn"):
        o = owner(f)
        if f.self_param is not None and not f.params and "async" not in f.flags and f.name.startswith("get_") and len(f.name) > 4 and not (o is not None and o.kind == "Impl" and o.trait is not None):
            if f.name not in ("get_mut", "get_ref", "get_unchecked", "get_unchecked_mut", "get_or_init", "get_or_insert_with", "get_or_insert", "get_pin_mut", "get_many_mut"):
                yield f, f"getter `{f.name}`"


def member_rank(i, x) -> int:
    if x.kind in ("Const", "TypeAlias"):
        return 0
    if x.kind == "MacroCall":
        return 5
    ctor = x.self_param is None and (x.name in ("new", "default", "try_new") or re.match(r"(new|with|from|try_new)_", x.name)) and returns_self(x, last_of(i.type))
    return 1 if ctor else 2 if x.vis == "pub" else 3 if x.vis else 4


@ast("rust_impl_member_order", "medium", "Members come in order: constants, constructors, public, others.", fixable=True)
def impl_member_order(file, p):
    for i in file.of("Impl"):
        ranks = [member_rank(i, x) for x in i.items if x.kind in ("Const", "TypeAlias", "MacroCall", "Fn")] if i.trait is None else []
        if ranks != sorted(ranks):
            yield i, "members are out of order"


@ast("rust_inherent_before_trait_impl", "low", "A type's own impl comes before its traits'.")
def inherent_before_trait_impl(file, p):
    first = {}
    for i in file.of("Impl"):
        if i.trait is None:
            first.setdefault((i.parent.pre, i.type.compact), i.start)
    for i in file.of("Impl"):
        if i.trait is not None and first.get((i.parent.pre, i.type.compact), -1) > i.start:
            yield i, f"trait impl of `{i.type.compact}` before its own"


@ast("rust_long_compound_name", "low", "Names have few parts.", threshold=4)
def long_compound_name(file, p):
    for n in file.of("Struct", "Enum", "Trait", "TypeAlias", "Union"):
        if owner(n) is None and len(camel(n.name)) > p["threshold"]:
            yield n, f"`{n.name}` has {len(camel(n.name))} parts"


@ast("rust_loop_to_while", "low", "Write while.")
def loop_to_while(file, p):
    for n in file.of("LoopExpr"):
        s = n.body.stmts[0] if n.body.stmts and not n.label else None
        e = s.expr if s is not None and s.kind == "ExprStmt" else s
        if e is not None and e.kind == "IfExpr" and e.otherwise is None and len(e.then.stmts) == 1 and not any(x.kind == "LetExpr" for x in [e.cond, *e.cond.all("LetExpr")]):
            b = e.then.stmts[0]
            b = b.expr if b.kind == "ExprStmt" else b
            if b.kind == "BreakExpr" and b.expr is None and b.compact == "break":
                yield n, "a loop that begins with its exit"


@ast("rust_magic_numbers", "low", "Numbers that recur have names.", default=False, allowed="0 1 0.0 1.0".split(), min_occurrences=3)
def magic_numbers(file, p):
    groups = defaultdict(list)
    for n in file.of("Literal"):
        if n.lit != "num" or in_test(n) or n.nearest("Const", "Static", "Attr", "LiteralPat", "RangePat", "Variant") is not None:
            continue
        top, e = n, n.parent
        if e.kind == "PrefixExpr" and e.op == "-":
            top, e = e, e.parent
        slot = None
        if e.kind == "BinExpr" and e.op in ("==", "!=", "<", ">", "<=", ">="):
            other = e.rhs if e.lhs is top else e.lhs
            slot = ("compare", other.compact.split(".")[-1])
        elif e.kind in ("CallExpr", "MethodCallExpr"):
            name = e.callee.compact if e.kind == "CallExpr" else e.name
            if e.kind == "MethodCallExpr" and (top is e.receiver or re.match(r"(chunks|windows|step_by|skip|take|nth|pow|powi|split_at|rem_euclid|wrapping_\w+|saturating_\w+|checked_\w+)", name)):
                continue
            slot = ("call", name, e.args.index(top))
        elif e.kind in ("LetStmt", "RecordExprField", "ReturnExpr", "ArrayExpr"):
            slot = (e.kind, e.name or "")
        if slot is None:
            continue
        value = re.sub(r"_?(u8|u16|u32|u64|u128|usize|i8|i16|i32|i64|i128|isize|f32|f64)$", "", n.value).replace("_", "")
        value = str(int(value, 0)) if re.fullmatch(r"0[xob][0-9a-fA-F]+", value) else value
        value = ("-" if top is not n else "") + value
        if value in p["allowed"]:
            continue
        f = nearest_fn(n)
        groups[f.pre if f is not None else -1, slot, value].append(top)
    for (_, _, value), found in groups.items():
        if len(found) >= p["min_occurrences"]:
            yield found[0], f"{value} recurs {len(found)} times"


@ast("rust_match_layout", "low", "Arms are set apart if any takes lines.", fixable=True)
def match_layout(file, p):
    for m in file.of("MatchExpr"):
        arms = m.arms
        if any(a.body is not None and a.body.kind == "BlockExpr" and not a.body.stmts and re.fullmatch(r"\{\s+\}", a.body.text) for a in arms):
            yield m, "an empty block is spread out"
            continue
        if len(arms) < 2:
            continue
        many = any(a.line != a.end_line for a in arms)
        for a, b in zip(arms, arms[1:], strict=False):
            gap = file.text[a.end : b.start]
            gap = gap.split("//")[0] if "//" in gap else gap
            blank = bool(re.search(r"\n[ \t]*\r?\n", file.text[a.end : b.start]))
            if many != blank and "\n" in file.text[a.end : b.start]:
                yield m, "arms aren't set apart alike"
                break


def runs_of(items, test):
    run = []
    for n in [*items, None]:
        if n is not None and test(n):
            run.append(n)
        else:
            if run:
                yield run
            run = []


@ast("rust_mod_order", "low", "Modules are declared in order.", fixable=True)
def mod_order(file, p):
    for scope in [file.root, *file.of("Module")]:
        for run in runs_of(scope.items or [], lambda n: n.kind == "Module" and n.items is None):
            for part in _contiguous(file, run):
                names = [n.name for n in part]
                if len(names) > 1 and names != sorted(names):
                    yield part[0], "module declarations aren't sorted"


def _contiguous(file, run):
    part = [run[0]]
    for a, b in zip(run, run[1:], strict=False):
        if re.search(r"\n[ \t]*\r?\n", file.text[a.end : b.start]):
            yield part
            part = []
        part.append(b)
    yield part


_CONTROL = ("IfExpr", "MatchExpr", "ForExpr", "WhileExpr", "LoopExpr")


@ast("rust_padding", "low", "Blank lines set statements apart.", fixable=True, boundaries="functions control-flow let-runs returns tail-expressions".split())
def padding(file, p):
    want = set(p["boundaries"])

    def blank(a, b):
        return bool(re.search(r"\n[ \t]*\r?\n", file.text[a.end : b.start]))

    def core(s):
        return s.expr if s.kind == "ExprStmt" else s

    if "functions" in want:
        after: dict[int, dict] = {}  # of each parent: a child's place -> the child that follows it
        for f in file.of("Fn"):
            if f.parent.pre not in after:
                around = [n for n in f.parent.children if n.kind not in ("Doc", "Attr", "Attrs")]
                after[f.parent.pre] = {a.pre: b for a, b in zip(around, around[1:], strict=False)}
            b = after[f.parent.pre].get(f.pre)
            if b is not None and b.kind == "Fn" and not blank(f, b):
                yield b, "no blank line between functions"
    for block in file.of("StmtList"):
        for a, b in zip(block.stmts, block.stmts[1:], strict=False):
            ea, eb = core(a), core(b)
            if ea is None or eb is None or blank(a, b):
                continue
            returns = "returns" in want and eb.kind == "ReturnExpr"
            tail = "tail-expressions" in want and block.tail is b and a.kind == "LetStmt"
            lets = "let-runs" in want and a.kind == "LetStmt" and b.kind != "LetStmt"
            if returns or tail or lets or ("control-flow" in want and (ea.kind in _CONTROL or eb.kind in _CONTROL)):
                yield b, "a blank line is missing"


@ast("rust_pub_use_grouping", "low", "Re-exports of one origin come together.", fixable=True)
def pub_use_grouping(file, p):
    for scope in [file.root, *file.of("Module")]:
        for run in runs_of(scope.items or [], lambda n: n.kind == "Use" and n.vis == "pub"):
            seen, before = set(), None
            for u in run:
                origin = next((path[0] for path, *_ in leaves(u.tree) if path), "")
                if origin != before and origin in seen:
                    yield u, f"re-exports of `{origin}` are apart"
                    break
                seen.add(origin)
                before = origin


@ast("rust_pub_use_position", "low", "Re-exports follow imports.", fixable=True)
def pub_use_position(file, p):
    run = []
    for n in file.root.items:
        if n.kind == "Use":
            run.append(n)
        elif n.kind not in ("Attrs", "Module", "ExternCrate") or run:
            break
    plain, shown = [k for k, u in enumerate(run) if u.vis != "pub"], [k for k, u in enumerate(run) if u.vis == "pub"]
    if plain and shown:
        if max(plain) > min(shown):
            yield run[min(shown)], "a re-export comes before an import"
        elif not re.search(r"\n[ \t]*\r?\n", file.text[run[max(plain)].end : run[min(shown)].start]):
            yield run[min(shown)], "no blank line before re-exports"


@ast("rust_redundant_field_names", "low", "Fields are named once.", fixable=True)
def redundant_field_names(file, p):
    for f in file.of("RecordExprField"):
        if f.colon and f.value is not None and f.value.kind == "PathExpr" and f.value.compact == f.name:
            yield f, f"redundant name `{f.name}`"


@ast("rust_thiserror_qualified", "low", "Derive thiserror::Error by its full name.", fixable=True)
def thiserror_qualified(file, p):
    if uses(file).get("Error") == "thiserror::Error":
        for n in file.of("Struct", "Enum"):
            if "Error" in derives(n):
                yield n, f"`{n.name}` derives a bare Error"


@ast("rust_type_def_ordering", "low", "Types come before their impls.")
def type_def_ordering(file, p):
    at = {n.name: n.line for n in file.root.items if n.kind in ("Struct", "Enum")}
    for i in file.root.items:
        if i.kind == "Impl" and i.trait is None and i.line < at.get(last_of(i.type), 0):
            yield i, f"impl of `{last_of(i.type)}` before the type"


@ast("rust_weasel_words", "medium", "Names say what a type does.", words=["Factory", "Manager", "Service"])
def weasel_words(file, p):
    for n in file.of("Struct", "Enum", "Trait", "TypeAlias", "Union"):
        if owner(n) is None:
            w = next((w for w in p["words"] if w in camel(n.name)), None)
            if w:
                yield n, f"`{n.name}` says {w}"


@ast("rust_where_clauses", "low", "Bounds go in where clauses.")
def where_clauses(file, p):
    for g in file.of("TypeParam"):
        if g.bounds and g.default is None and g.parent.kind in ("Fn", "Impl", "Struct", "Enum"):
            yield g, f"`{g.name}` is bounded inline"


@ast("rust_yoda_conditions", "low", "The literal comes second.")
def yoda_conditions(file, p):
    def literal(e):
        e = bare(e)
        return e.kind == "Literal" or (e.kind == "PrefixExpr" and e.op == "-" and e.expr.kind == "Literal")

    for b in file.of("BinExpr"):
        if b.op in ("==", "!=") and b.lhs.kind == "Literal" and not literal(b.rhs):
            yield b, "the literal comes first"


@rule("rust_style", "rust-line", "low", "No trailing white space, tabs or carriage returns.", fixable=True)
def style(file, p):
    for i, line in enumerate(file.lines, 1):
        if line != line.rstrip():
            yield i, "white space at the end"
        if "\t" in line:
            yield i, "a tab"
        if "\r" in line:
            yield i, "a carriage return"


def regions(lines, name):
    """Rows below a ``// <name>`` marker, to the blank line or closing bracket after them."""
    for i, line in enumerate(lines):
        t = line.strip()
        if re.fullmatch(r"// #rw:" + name + r"(\((asc|desc)\))?", t):
            rows = []
            for j in range(i + 1, len(lines)):
                s = lines[j].strip()
                if not s or s in ("}", "};", ")", ");", "]", "];", "},"):
                    break
                rows.append((j + 1, lines[j]))
            yield i + 1, rows


def sort_key(line: str) -> tuple[int, str]:
    t = re.sub(r"^(pub(\([^)]*\))?\s+)?((use|mod)\s+)?", "", line.strip())
    return (1 if re.match(r"_\s*(=>|if)|\.\.", t) else 0, t.lower())


@rule("rust_sorted", "rust-line", "low", "Marked rows are sorted.", fixable=True)
def sorted_rows(file, p):
    for at, rows in regions(file.lines, "sorted"):
        before, down = None, "(desc)" in file.lines[at - 1]
        for i, line in rows:
            if line.strip().startswith("//"):
                continue
            k = sort_key(line)
            if before is not None and (k > before if down else k < before):
                yield i, "rows aren't sorted"
                break
            before = k


def _code_columns(line: str) -> tuple[int | None, list[int], int | None]:
    """UTF-8 columns of ``=>``, of top-level commas within a tuple row, and of a trailing comment."""
    from corposieve.syntax.lexer import tokenize

    tokens, _ = tokenize(line)
    col = lambda at: len(line[:at].encode())
    arrow = next((col(t.start) for t in tokens if t.text == "=>" and t.kind == "punct"), None)
    comment = next((col(t.start) for t in tokens if t.kind in ("comment", "doc")), None)
    commas, depth = [], 0
    for k, t in enumerate(tokens):
        if t.kind == "punct" and t.text in "([{":
            depth += 1
        elif t.kind == "punct" and t.text in ")]}":
            depth -= 1
        elif t.text == "," and depth == 1 and k + 1 < len(tokens) and tokens[k + 1].text not in (")", "]", "}"):
            commas.append(col(tokens[k + 1].start))
    return arrow, commas, comment


def _odd(values):
    known = [v for _, v in values if v is not None]
    if len(known) < 2:
        return []
    counts = Counter(known)
    most = min(counts, key=lambda v: (-counts[v], v))
    return [i for i, v in values if v is not None and v != most]


@rule("rust_aligned", "rust-line", "low", "Marked rows are aligned.", fixable=True)
def aligned(file, p):
    for _, rows in regions(file.lines, "aligned"):
        rows = [(i, line) for i, line in rows if not line.strip().startswith("//")]
        if len(rows) < 2:
            continue
        for i, line in rows:
            if line.strip() == "(":
                yield i, "a tuple row is wrapped"
        cols = [(i, _code_columns(line)) for i, line in rows]
        arrows = [(i, c[0]) for i, c in cols]
        if any(a is not None for _, a in arrows):
            for i in _odd(arrows):
                yield i, "the arrow isn't aligned"
        else:
            counts = [(i, len(c[1])) for i, c in cols if c[1]]
            for i in _odd(counts):
                yield i, "a row has another number of fields"
            for k in range(max((n for _, n in counts), default=0)):
                for i in _odd([(i, c[1][k] if k < len(c[1]) else None) for i, c in cols]):
                    yield i, "a field isn't aligned"
        for i in _odd([(i, c[2]) for i, c in cols]):
            yield i, "a comment isn't aligned"


__all__ = ["attrs", "inherent", "is_test_item", "public"]
