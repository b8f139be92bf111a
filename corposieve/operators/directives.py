"""Suppression directives in comments: ``// #rw(scope: rule, rule) reason``."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corposieve.model import DIRECTIVES

PREFIX = "// #rw("
_CLOSERS = ("}", "};", ")", ");")


def parse_directive(line: str, known: Iterable[str] | None = None) -> dict | None:
    """A directive's fields; ``error`` tells what is wrong with it; None for any other line."""
    t = line.strip()
    if not t.startswith(PREFIX):
        return None
    out = {"scope": "next", "rules": [], "values": {}, "wildcard": False, "reason": "", "error": None}
    inside, close, after = t[len(PREFIX) :].partition(")")
    if not close:
        return out | {"error": "a directive doesn't close"}
    if not inside:
        return out | {"error": "a directive names no rule"}
    m = re.match(r"(file|block|fn):", inside)
    if m:
        out["scope"], inside = m.group(1), inside[m.end() :]
    out["reason"] = after.strip()
    targets = [x.strip() for x in inside.split(",") if x.strip()]
    if inside.strip() == "*":
        out["wildcard"] = True
    elif not targets:
        return out | {"error": "a directive names no rule"}
    else:
        for x in targets:
            name, eq, value = (y.strip() for y in x.partition("="))
            if not name:
                return out | {"error": "a value without a rule"}
            if eq:
                if out["scope"] != "file":
                    return out | {"error": "only file directives take values"}
                if not re.fullmatch(r"\+?\d+", value) or int(value) == 0:
                    return out | {"error": "a value must be a positive integer"}
                out["values"][name] = int(value)
            out["rules"].append(name)
        if "*" in out["rules"]:
            return out | {"error": "a wildcard stands alone"}
    if not out["reason"]:
        return out | {"error": "a directive needs a reason"}
    return out


def _braces(line: str) -> tuple[int, bool]:
    code = re.sub(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)\'', "", line).split("//")[0]
    return code.count("{") - code.count("}"), "{" in code


def directives_of(rel: str, lines: list[str], known: set[str] | None = None) -> Iterator[dict]:
    """Directives of a file with the last line that each covers."""
    for i, line in enumerate(lines):
        d = parse_directive(line)
        if d is None:
            continue
        end = i + 1
        if d["scope"] == "next":
            end = i + 2
        elif d["scope"] == "block":
            for j in range(i + 1, len(lines)):
                t = lines[j].strip()
                if not t or t in _CLOSERS:
                    break
                end = j + 1
        elif d["scope"] == "fn":
            depth, opened = 0, False
            for j in range(i + 1, len(lines)):
                change, has = _braces(lines[j])
                depth, opened, end = depth + change, opened or has, j + 1
                if opened and depth <= 0:
                    break
        yield {"rel": rel, "line": i + 1, "end_line": None if d["scope"] == "file" else end} | d
        if known is not None and not d["error"]:
            for name in d["rules"]:
                if name not in known:
                    yield {"rel": rel, "line": i + 1, "end_line": None, "scope": "unknown", "rules": [], "values": {}, "wildcard": False, "reason": "", "error": f"unknown rule `{name}`"}


def directives(files: DataFrame, known: Iterable[str] | None = None) -> DataFrame:
    """Directives of all files (see ``model.DIRECTIVES``); a file's lines are needed at once, for its braces."""
    names = set(known) if known is not None else None
    columns = [x.split()[0] for x in DIRECTIVES.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [d for rel, text in zip(batch["rel"], batch["contents"], strict=True) if text and PREFIX in text for d in directives_of(rel, text.split("\n"), names)]
            out = pd.DataFrame([[d[c] for c in columns] for d in rows], columns=columns)
            out["end_line"] = out["end_line"].astype("Int32") if len(out) else out["end_line"]
            yield out

    return files.where(files.contents.contains(PREFIX)).select("rel", "contents").mapInPandas(scan, DIRECTIVES)
