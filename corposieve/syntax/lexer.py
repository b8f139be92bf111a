"""Rust tokens, with where comments start and what of each line is code."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # ident, life, num, str, char, punct, doc, comment
    text: str
    start: int
    end: int


_RAW = re.compile(r'(?:br|cr|r)(#*)"')
_IDENT = re.compile(r"(?:r#)?[^\W\d]\w*")
_NUM = re.compile(r"0[xob][0-9a-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*(?![\w.])|\.(?=[^\w.]|$)|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?\w*")
_LIFE = re.compile(r"'[^\W\d]\w*(?!')")
_CHAR = re.compile(r"b?'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^'\\])'")
_STR = re.compile(r'[bc]?"(?:[^"\\]|\\.)*"', re.S)
_PUNCT = tuple("<<= >>= ... ..= :: -> => == != <= >= && || += -= *= %= /= ^= |= &= .. << >>".split())
_SIGN = re.compile("|".join(map(re.escape, _PUNCT)))
#: Characters that nothing but punctuation begins with.
_PLAIN = frozenset("!#$%&()*+,-.:;<=>?@[\\]^`{|}~")
_SPACE = re.compile(r"\s*")
_ANY = (("char", _CHAR), ("life", _LIFE), ("ident", _IDENT), ("num", _NUM))
_WORD = (("ident", _IDENT),)


def tokenize(text: str) -> tuple[list[Token], list[str]]:
    """All tokens with comments, and lexical errors."""
    out: list[Token] = []
    errors: list[str] = []
    i, n = 0, len(text)
    if text.startswith("#!") and not text.startswith("#!["):
        i = text.find("\n") if "\n" in text else n
    while i < n:
        c = text[i]
        if c.isspace():
            i = _SPACE.match(text, i + 1).end()
            continue
        if c in _PLAIN:
            p = m.group() if (m := _SIGN.match(text, i)) else c
            out.append(Token("punct", p, i, i + len(p)))
            i += len(p)
            continue
        if text.startswith("//", i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            body = text[i:end].rstrip("\r")
            doc = (body.startswith("///") and not body.startswith("////")) or body.startswith("//!")
            out.append(Token("doc" if doc else "comment", body, i, i + len(body)))
            i = end
            continue
        if text.startswith("/*", i):
            depth, j = 1, i + 2
            while j < n and depth:
                if text.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                elif text.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                else:
                    j += 1
            if depth:
                errors.append("a block comment doesn't end")
            doc = (text.startswith("/**", i) and not text.startswith(("/***", "/**/"), i)) or text.startswith("/*!", i)
            out.append(Token("doc" if doc else "comment", text[i:j], i, j))
            i = j
            continue
        if c in "bcr" and (m := _RAW.match(text, i)):
            close = '"' + m.group(1)
            end = text.find(close, m.end())
            if end < 0:
                errors.append("a raw string doesn't end")
                end = n
            out.append(Token("str", text[i : end + len(close)], i, min(n, end + len(close))))
            i = min(n, end + len(close))
            continue
        if c == '"' or (c in "bc" and text.startswith('"', i + 1)):
            if m := _STR.match(text, i):
                out.append(Token("str", m.group(), i, m.end()))
                i = m.end()
            else:
                errors.append("a string doesn't end")
                out.append(Token("str", text[i:], i, n))
                i = n
            continue
        for kind, pattern in _WORD if c != "b" and (c.isalpha() or c == "_") else _ANY:
            if m := pattern.match(text, i):
                # a range's dots and a method's dot aren't a number's
                got = m.group()
                if kind == "num" and got.endswith(".") and (text.startswith(".", m.end()) or _IDENT.match(text, m.end())):
                    got = got[:-1]
                out.append(Token(kind, got, i, i + len(got)))
                i += len(got)
                break
        else:
            p = m.group() if (m := _SIGN.match(text, i)) else c
            out.append(Token("punct", p, i, i + len(p)))
            i += len(p)
    return out, errors


def code_only(text: str, tokens: list[Token]) -> str:
    """``text`` with comments and what strings and chars hold blanked, line breaks kept."""
    out, at = [], 0
    for t in tokens:
        if t.kind in ("comment", "doc", "str", "char"):
            out.append(text[at : t.start])
            out.append(re.sub(r"[^\n]", " ", text[t.start : t.end]))
            at = t.end
    return "".join([*out, text[at:]])
