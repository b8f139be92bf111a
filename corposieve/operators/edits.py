"""Mechanical fixes: edits, greedy application, and a fixpoint over a corpus."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposieve.rules.base import RustFile, attr_args, derives, joined

MAX_PASSES = 10


class Edit(NamedTuple):
    start: int  # first line, from 1
    end: int  # last line
    replacement: str | None  # None deletes the lines


def line_ending(text: str) -> str:
    return "\r\n" if "\r\n" in text and not re.search(r"(?<!\r)\n", text) else "\n"


def apply_edits(text: str, edits: list[Edit]) -> tuple[str, int]:
    """Apply from the end of the file; an edit that reaches into one already applied waits for the next pass."""
    eol = line_ending(text)
    final = text.endswith("\n")
    lines = text.split("\n")
    if final:
        lines.pop()
    if any(e.start < 1 or e.end < e.start or e.end > len(lines) for e in edits):
        raise ValueError("an edit lies outside its file")
    lowest, done = len(lines) + 1, 0
    for e in sorted(edits, key=lambda e: (-e.start, -e.end)):
        if e.end >= lowest:
            continue
        lines[e.start - 1 : e.end] = [] if e.replacement is None else e.replacement.replace("\n", eol).split("\n") if eol == "\n" else [x + "\r" for x in e.replacement.split("\n")]
        lowest, done = e.start, done + 1
    return "\n".join(lines) + ("\n" if final and lines else ""), done


def _line(f: RustFile, n: int) -> str:
    return f.lines[n - 1]


def _splice(text: str, start: int, end: int, new: str) -> str:
    return text[:start] + new + text[end:]


def line_fixes(f: RustFile, rule: str, line: int) -> Edit | None:
    """The edit that mends a finding of a line rule or of a rule with a fix within its line."""
    old = _line(f, line)
    if rule == "rust_style":
        new = old.replace("\t", "    ").replace("\r", "").rstrip()
    elif rule == "rust_banner_comments":
        return Edit(line, line, None)
    elif rule == "rust_comment_space":
        new = old.replace("//", "// ", 1)
    elif rule == "rust_deny_warnings":
        return Edit(line, line, None) if old.strip() == "#![deny(warnings)]" else None
    elif rule == "rust_duplicate_words":
        m = re.search(r"(?i)(?<!\S)(\S+)(\s+)\1(?!\S)", old[old.index("//") :])
        if not m:
            return None
        at = old.index("//") + m.start()
        new = old[:at] + m.group(1) + old[at + len(m.group()) :]
    elif rule == "rust_redundant_field_names":
        new = re.sub(r"\b(\w+):\s*\1\b(?!\s*[.(:\[?])", r"\1", old, count=1)
    elif rule == "rust_from_instead_of_as":
        if old.count(" as ") != 1:
            return None
        new = re.sub(r"(-?[\w.]+) as (\w+)", r"\2::from(\1)", old)
    elif rule == "rust_ok_or_eager":
        m = re.search(r"\.(ok_or|unwrap_or)\(", old)
        if not m:
            return None
        depth, k = 1, m.end()
        while k < len(old) and depth:
            depth += (old[k] == "(") - (old[k] == ")")
            k += 1
        if depth:
            return None
        new = old[: m.start()] + f".{m.group(1)}_else(|| " + old[m.end() : k] + old[k:]
    elif rule == "rust_missing_debug":
        return Edit(line, line, re.match(r"\s*", old).group() + "#[derive(Debug)]\n" + old)
    elif rule == "rust_sorted":
        return _sorted(f, line)
    elif rule == "rust_aligned":
        return _aligned(f, line)
    else:
        return None
    return Edit(line, line, new) if new != old else None


def _sorted(f: RustFile, line: int) -> Edit | None:
    from corposieve.rules.style import regions, sort_key

    for at, rows in regions(f.lines, "sorted"):
        if any(i == line for i, _ in rows):
            code = sorted((t for _, t in rows if not t.strip().startswith("//")), key=sort_key, reverse="(desc)" in f.lines[at - 1])
            it = iter(code)
            return Edit(rows[0][0], rows[-1][0], "\n".join(t if t.strip().startswith("//") else next(it) for _, t in rows))
    return None


def tree_fix(f: RustFile, rule: str) -> str | None:
    """The whole text with all findings of a rule over trees mended."""
    cuts: list[tuple[int, int, str]] = []
    if rule == "rust_dbg":
        for m in f.of("MacroCall"):
            if m.names == ["dbg"] and m.body and not any(m.first > u.first and u.kind == "MacroCall" for u in m.up()):
                cuts.append((m.start, m.end, f.text[m.body[0].start : m.body[-1].end]))
    elif rule == "rust_derive_order":
        for a in f.of("Attr"):
            names = [joined(x) for x in attr_args(a)] if a.name == "derive" else []
            if names != sorted(names):
                cuts.append((a.start, a.end, f"#[derive({', '.join(sorted(names))})]"))
    elif rule == "rust_mod_order":
        from corposieve.rules.style import _contiguous, runs_of

        for scope in [f.root, *f.of("Module")]:
            for run in runs_of(scope.items or [], lambda n: n.kind == "Module" and n.items is None):
                for part in _contiguous(f, run):
                    order = sorted(part, key=lambda n: n.name)
                    if order != part:
                        cuts += [(a.start, a.end, b.text) for a, b in zip(part, order, strict=True)]
    elif rule == "rust_attr_order":
        for n in f.nodes:
            a = [x for x in n.f.get("attrs") or [] if not x.inner]
            rank = lambda x: 0 if x.kind == "Doc" or x.name == "doc" else 1 if x.name == "derive" else 2
            if len(a) > 1 and [rank(x) for x in a] != sorted(map(rank, a)):
                cuts += [(x.start, x.end, y.text) for x, y in zip(a, sorted(a, key=rank), strict=True)]
    elif rule == "rust_padding":
        from corposieve.rules.base import BUILTIN

        r = BUILTIN.rules[rule]
        for n, _ in r.check(f, dict(r.params)):
            at = f.starts[n.line - 1]
            if not f.text[at : n.start].strip():
                while at and f.lines[f.line_at(at) - 2].strip().startswith("//"):
                    at = f.starts[f.line_at(at) - 2]
                cuts.append((at, at, "\n"))
    elif rule == "rust_impl_member_order":
        from corposieve.rules.style import member_rank

        for i in f.of("Impl"):
            if i.trait is None and len(i.items) > 1:
                ranks = [member_rank(i, x) for x in i.items]
                if ranks != sorted(ranks):
                    order = [x for _, x in sorted(zip(ranks, i.items, strict=True), key=lambda p: p[0])]
                    cuts += [(a.start, a.end, b.text) for a, b in zip(i.items, order, strict=True)]
    elif rule == "rust_pub_use_grouping":
        from corposieve.rules.base import leaves
        from corposieve.rules.style import runs_of

        for scope in [f.root, *f.of("Module")]:
            for run in runs_of(scope.items or [], lambda n: n.kind == "Use" and n.vis == "pub"):
                origin = [next((p[0] for p, *_ in leaves(u.tree) if p), "") for u in run]
                first = {o: k for k, o in reversed(list(enumerate(origin)))}
                order = [u for _, u in sorted(zip(origin, run, strict=True), key=lambda p: first[p[0]])]
                if order != run:
                    cuts += [(a.start, a.end, b.text) for a, b in zip(run, order, strict=True)]
    elif rule == "rust_match_layout":
        for m in f.of("MatchExpr"):
            many = any(a.line != a.end_line for a in m.arms)
            for a in m.arms:
                if a.body is not None and a.body.kind == "BlockExpr" and re.fullmatch(r"\{\s+\}", a.body.text):
                    cuts.append((a.body.start, a.body.end, "{}"))
            for a, b in zip(m.arms, m.arms[1:], strict=False):
                gap = f.text[a.end : b.start]
                if "\n" in gap and "//" not in gap and many != bool(re.search(r"\n[ \t]*\r?\n", gap)):
                    indent, comma = gap.rpartition("\n")[2], gap.split("\n")[0].rstrip()
                    cuts.append((a.end, b.start, comma + ("\n\n" if many else "\n") + indent))
    elif rule == "rust_thiserror_qualified":
        from corposieve.rules.base import uses

        if uses(f).get("Error") == "thiserror::Error":
            for n in f.of("Struct", "Enum"):
                for a in n.attrs or []:
                    if a.kind == "Attr" and a.name == "derive" and "Error" in derives(n):
                        cuts.append((a.start, a.end, f"#[derive({', '.join('thiserror::Error' if joined(x) == 'Error' else joined(x) for x in attr_args(a))})]"))
            for u in f.of("Use"):
                if u.compact == "usethiserror::Error;":
                    end = u.end + 1 if f.text[u.end : u.end + 1] == "\n" else u.end
                    cuts.append((u.start, end, ""))
    elif rule == "rust_pub_use_position":
        run = []
        for n in f.root.items:
            if n.kind == "Use":
                run.append(n)
            elif n.kind not in ("Attrs", "Module", "ExternCrate") or run:
                break
        plain, shown = [u for u in run if u.vis != "pub"], [u for u in run if u.vis == "pub"]
        if plain and shown:
            cuts.append((run[0].start, run[-1].end, "\n".join(u.text for u in plain) + "\n\n" + "\n".join(u.text for u in shown)))
    if not cuts:
        return None
    text, low = f.text, len(f.text) + 1
    for a, b, new in sorted(cuts, key=lambda c: (-c[0], -c[1])):
        if b <= low:
            text, low = _splice(text, a, b, new), a
    return text if text != f.text else None


def _aligned(f: RustFile, line: int) -> Edit | None:
    """Pad the cells of a marked region to a common width; wrapped tuples are put on one line."""
    from corposieve.rules.style import _code_columns, regions

    for _, rows in regions(f.lines, "aligned"):
        if not any(i == line for i, _ in rows):
            continue
        flat: list[str] = []
        wrapped: list[str] | None = None
        for _, t in rows:
            if wrapped is not None:
                wrapped.append(t.strip())
                if t.strip() in (")", "),"):
                    inner = " ".join(wrapped[:-1]).rstrip(",")
                    flat[-1] += inner + wrapped[-1]
                    wrapped = None
            elif t.strip() == "(":
                flat.append(t.rstrip())
                wrapped = []
            else:
                flat.append(t)
        cut = []
        for t in flat:
            if t.strip().startswith("//"):
                cut.append(None)
                continue
            arrow, commas, comment = _code_columns(t)
            raw = t.encode()
            at = [arrow] if arrow is not None else commas
            points = [0, *at, *([comment] if comment is not None else [])]
            cells = [raw[a:b].decode().rstrip() for a, b in zip(points, [*points[1:], len(raw)], strict=True)]
            cut.append((cells, comment is not None))
        body = [c[0][: len(c[0]) - c[1]] for c in cut if c]
        widths = [max(len(c[k].encode()) for c in body if k < len(c) - 1) if any(k < len(c) - 1 for c in body) else 0 for k in range(max(map(len, body)))]
        out = []
        for t, c in zip(flat, cut, strict=True):
            if c is None:
                out.append(t)
                continue
            own = c[0][: len(c[0]) - c[1]]
            text = "".join(x + " " * (widths[k] - len(x.encode()) + 1) if k < len(own) - 1 else x for k, x in enumerate(own))
            out.append((text, c[0][-1] if c[1] else None))
        wide = max((len(x[0].encode()) for x in out if isinstance(x, tuple) and x[1]), default=0)
        done = [x if isinstance(x, str) else x[0] + (" " * (wide - len(x[0].encode()) + 1) + x[1] if x[1] else "") for x in out]
        if done != [t for _, t in rows]:
            return Edit(rows[0][0], rows[-1][0], "\n".join(done))
    return None


TREE = ("rust_attr_order", "rust_dbg", "rust_derive_order", "rust_impl_member_order", "rust_match_layout", "rust_mod_order", "rust_padding", "rust_pub_use_grouping", "rust_pub_use_position", "rust_thiserror_qualified")


def mend(text: str, rel: str, rules: list, params) -> tuple[str, int]:
    """One file to its fixpoint: tree fixes first, one rule at a time; then line fixes. At most ten passes; a pass
    that would break a source that parsed is undone."""
    from corposieve.plans.engine import file_findings

    for turn in range(MAX_PASSES):
        f = RustFile(text, rel)
        found = [x for x in file_findings(f, rules, params) if x[5]]
        if not found:
            return text, turn
        new = None
        for rule in sorted({x[3] for x in found} & set(TREE)):
            new = tree_fix(f, rule)
            if new is not None:
                break
        if new is None:
            edits = [e for x in found if x[3] not in TREE and (e := line_fixes(f, x[3], x[1]))]
            new, _ = apply_edits(text, list(dict.fromkeys(edits))) if edits else (text, 0)
        if new == text or (not f.errors and RustFile(new, rel).errors):
            return text, turn
        text = new
    return text, MAX_PASSES


def fix(files: DataFrame, rules: list, params) -> DataFrame:
    """``rel, before, after, passes`` of files that fixes change. Files are independent, so each is mended in its
    own task; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rel, text in zip(batch["rel"], batch["contents"], strict=True):
                after, passes = mend(text, rel, rules, params)
                if after != text:
                    rows.append([rel, text, after, passes])
            yield pd.DataFrame(rows, columns=["rel", "before", "after", "passes"])

    return files.where("ext = 'rs'").select("rel", "contents").mapInPandas(run, "rel string, before string, after string, passes int")


def preview(rel: str, before: str, after: str) -> str:
    """A unified diff."""
    return "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{rel}", f"b/{rel}"))


def greedy(edits: DataFrame) -> DataFrame:
    """Of each file's edits (``rel, start_line, end_line, seq``) those that one pass applies, from the last line up.

    A scan over edits that are sorted by file and place within their partition: a task holds one batch and where the
    edit before began, however many edits a file has.
    """
    names = edits.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, lowest = None, 0
        for batch in batches:
            rel, start, end = (batch.column(names.index(c)).to_pylist() for c in ("rel", "start_line", "end_line"))
            keep = []
            for k in range(batch.num_rows):
                ok = rel[k] != file or end[k] < lowest
                if ok:
                    file, lowest = rel[k], start[k]
                keep.append(ok)
            yield batch.filter(pa.array(keep, pa.bool_()))

    placed = edits.repartition("rel").sortWithinPartitions("rel", F.desc("start_line"), F.desc("end_line"), "seq")
    return placed.mapInArrow(scan, edits.schema)


__all__ = ["F"]
