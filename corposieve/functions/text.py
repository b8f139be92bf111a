"""Scalar text functions as Spark expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\p{Z}\x{85}]"
BIDI = "؜‎‏‪‫‬‭‮⁦⁧⁨⁩"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once though body names it often, also within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_end(c: Column) -> Column:
    """Trim all Unicode white space at the end (``rtrim`` takes the space character alone)."""
    return F.regexp_replace(c, BLANK + "+$", "")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def split_lines(contents: Column) -> Column:
    """LF-separated lines without one CR before an LF; no entry after a final LF and none for an empty text."""
    parts = F.split(contents, "\n", -1)
    last = F.element_at(parts, -1)
    body = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(contents.isNull() | (contents == ""), F.array().cast("array<string>")).when(last == "", body).otherwise(F.concat(body, F.array(last)))


def comment_content(text: Column) -> Column:
    """What follows ``//``, ``///`` or ``//!`` on a trimmed line; null if that isn't a comment."""
    t = trim(text)
    return F.when(t.startswith("//"), F.regexp_replace(t, "^//[/!]?", ""))


def tokens(text: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def repeated_word(text: Column) -> Column:
    """The first token that its neighbour repeats, ASCII case aside, in lower case; null if none."""
    again = lambda w, i: (i < F.size(w)) & (F.lower(F.get(w, i - 1)) == F.lower(F.get(w, i)))
    places = lambda w: F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 1)), lambda i: again(w, i))
    return let(tokens(text), lambda w: F.lower(F.get(w, F.get(places(w), F.lit(0)) - 1)))


def camel_words(name: Column) -> Column:
    """CamelCase words; a run of capitals before a capitalised word is one."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(spaced, r"[ _]+"), lambda w: w != "")


def n_grams(items: Column, n: int) -> Column:
    """Runs of ``n`` neighbours; none if there are fewer items."""
    return let(items, lambda x: F.transform(F.when(F.size(x) >= n, F.sequence(F.lit(1), F.size(x) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.slice(x, i, n)))


_LOOKALIKE = {
    "а": "a", "А": "A", "В": "B", "с": "c", "С": "C", "е": "e", "Е": "E", "Н": "H", "і": "i", "І": "I", "ј": "j", "Ј": "J", "К": "K", "М": "M", "о": "o", "О": "O", "р": "p",
    "Р": "P", "ѕ": "s", "Ѕ": "S", "Т": "T", "х": "x", "Х": "X", "у": "y", "Ү": "Y", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "γ": "y", "ι": "i", "ρ": "p", "ɑ": "a", "ɡ": "g", "ı": "i", "ӏ": "l",
    "×": "x", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "‘": "'", "’": "'", "‚": ",", "‛": "'", "′": "'", "“": '"', "”": '"', "″": '"', "․": ".", "‥": "..", "…": "...", "∕": "/", "⁄": "/", "∶": ":", "；": ";",
    "։": ":", "׃": ":", "ǃ": "!", "∣": "|", "ǀ": "|", "∗": "*", "⁎": "*", "‹": "<", "›": ">", "᐀": "=", "﹦": "=", ";": ";", "⸵": ";", "՚": "'", "׳": "'", "״": '"', "‵": "`", "｀": "`", "ˋ": "`",
}


def confusables() -> dict[str, str]:
    """Characters beyond ASCII to the ASCII that they look like: compatibility forms, and letters and marks alike in shape."""
    found = {k: v for k, v in _LOOKALIKE.items() if not k.isascii()}
    for block in (range(0x2000, 0x2070), range(0x2100, 0x2150), range(0xFE10, 0xFF5F), range(0x1D400, 0x1D800), range(0x2460, 0x2500)):
        for code in block:
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain.isascii() and plain != " ":
                found.setdefault(chr(code), plain)
    return found


def first_of(text: Column, chars: str) -> Column:
    """The first character of ``text`` among ``chars``, all beyond ASCII, which is passed over first; empty if none."""
    escaped = "".join(f"\\x{{{ord(c):X}}}" for c in chars)
    return F.regexp_extract(F.regexp_replace(text, r"[\x00-\x7F]+", ""), f"[{escaped}]", 0)
