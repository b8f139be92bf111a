"""Examples and guidance of the builtin rules, from ``examples.txt``.

``== rule [at=path] [package=name]`` begins a rule's part; ``> `` its guidance; ``- fail`` and ``+ pass`` a source that the
rule finds fault with, and one that it doesn't (rules across files have none). ``@rep n line`` stands for n such lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from pathlib import Path


@dataclass(frozen=True)
class Examples:
    guidance: str
    fails: str
    passes: str
    path: str
    package: str | None


@cache
def examples() -> dict[str, Examples]:
    out: dict[str, Examples] = {}
    head: list[str] = []
    parts: dict[str, list[str]] = {}
    now = ""

    def close() -> None:
        if head:
            given = dict(x.split("=", 1) for x in head[1:])
            text = {k: "\n".join(v) + "\n" if v else "" for k, v in parts.items()}
            out[head[0]] = Examples(" ".join(parts["> "]), text.get("- fail", ""), text.get("+ pass", ""), given.get("at", "src/part.rs"), given.get("package"))

    for line in (Path(__file__).parent / "examples.txt").read_text(encoding="utf-8").split("\n")[:-1]:
        if line.startswith("== "):
            close()
            head, parts, now = line[3:].split(), {"> ": []}, ""
        elif line.startswith("> ") and not now:
            parts["> "].append(line[2:])
        elif line in ("- fail", "+ pass"):
            now = line
            parts[now] = []
        elif line.startswith("@rep "):
            _, n, text = line.split(" ", 2)
            parts[now] += [text] * int(n)
        else:
            parts[now].append(line)
    close()
    return out
