"""Line rules over text alone."""

from __future__ import annotations

import re

from corposieve.functions.text import BIDI, confusables
from corposieve.rules.base import rule

_ALIKE = confusables()
_FIRST = re.compile("[" + "".join(map(re.escape, _ALIKE)) + "]")
_BIDI = re.compile("[" + BIDI + "]")


def budget(lines: list[str], name: str) -> int | None:
    """The value that a file directive gives a rule."""
    from corposieve.operators.directives import parse_directive

    for line in lines:
        d = parse_directive(line)
        if d and not d["error"] and d["scope"] == "file" and name in d["values"]:
            return d["values"][name]
    return None


def ambiguous(lines: list[str]):
    for i, line in enumerate(lines, 1):
        m = None if line.isascii() else _FIRST.search(line)
        if m:
            yield i, f"U+{ord(m.group()):04X} looks like `{_ALIKE[m.group()]}`"


def bidirectional(lines: list[str]):
    for i, line in enumerate(lines, 1):
        m = None if line.isascii() else _BIDI.search(line)
        if m:
            yield i, f"U+{ord(m.group()):04X} turns the direction of text"


@rule("rust_ambiguous_unicode", "rust-line", "high", "Characters aren't mistaken for others.")
def ambiguous_unicode(file, p):
    yield from ambiguous(file.lines)


@rule("rust_bidirectional_unicode", "rust-line", "high", "Text runs one way.")
def bidirectional_unicode(file, p):
    yield from bidirectional(file.lines)


@rule("rust_static_mut", "rust-line", "high", "Statics aren't mutable.")
def static_mut(file, p):
    for i, code in enumerate(file.code, 1):
        if re.search(r"(?<!\w)static mut ", code):
            yield i, "a mutable static"
