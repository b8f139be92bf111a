"""Globs as regular expressions that Spark, Java and Python all read alike."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str | None:
    """``*`` and ``?`` stay in a path component, ``**`` crosses; ``[..]`` and ``{a,b}`` as usual; None if malformed."""
    out, i, depth, n = [], 0, 0, len(glob)
    while i < n:
        c = glob[i]
        if glob.startswith("**", i):
            starts, j = i == 0 or glob[i - 1] == "/", i + 2
            if starts and glob.startswith("/", j):
                out.append("(?:[^/]+/)*")
                i = j + 1
            elif starts and j == n:
                out.append(".*")
                i = j
            else:
                out.append("[^/]*")
                i = j
            continue
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 1 + (glob[i : i + 1] in ("!", "^")))
            if end < 0:
                return None
            body = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[^/" + body[1:] + "]" if body[0] in "!^" else "[" + body + "]")
            i = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            if i == n:
                return None
            out.append(re.escape(glob[i]))
            i += 1
        else:
            out.append(re.escape(c) if c not in "/" else c)
    return None if depth else "^" + "".join(out) + "$"


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    """Whether ``path`` matches one of the globs; a malformed one never does."""
    found = [path.rlike(r) for g in globs if (r := glob_regex(g))]
    return reduce(lambda a, b: a | b, found) if found else F.lit(False)


def in_scope(path: Column, only: Iterable[str] = (), ignore: Iterable[str] = ()) -> Column:
    """``(only is empty or matches) and not ignored``."""
    only = list(only)
    return (matches_any(path, only) if only else F.lit(True)) & ~matches_any(path, ignore)
