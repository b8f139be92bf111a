"""Line rules as Spark expressions, fused into one pass over the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corposieve.functions import text

#: More branches than this in one expression would outgrow the JVM's limit of compiled methods.
CHUNK = 20


def rules(comments: bool = True) -> dict[str, list[tuple[Column, Column]]]:
    """rule -> (condition, message) over the column ``text``; ``comments``: rules on comments look at comments alone."""
    t = F.col("text")
    inner = text.comment_content(t) if comments else t
    word = text.repeated_word(inner)
    plain = text.trim(t)
    slashes = F.when(F.lit(comments), F.regexp_extract(t, "//.*$", 0)).otherwise(t)
    note = lambda w: F.regexp_extract(slashes, f"{w}(?!\\()", 0) == w
    alike, turn = text.first_of(t, "".join(text.confusables())), text.first_of(t, text.BIDI)
    return {
        "rust_style": [(t != text.trim_end(t), F.lit("white space at the end")), (t.contains("\t"), F.lit("a tab")), (t.contains("\r"), F.lit("a carriage return"))],
        "rust_duplicate_words": [(word.isNotNull(), F.concat(F.lit("`"), word, F.lit("` is repeated")))],
        "rust_todo": [(note(w), F.lit(f"{w} without an owner")) for w in ("TODO", "FIXME", "HACK", "XXX")],
        "rust_ambiguous_unicode": [(alike != "", F.concat(F.lit("`"), alike, F.lit("` looks like another character")))],
        "rust_bidirectional_unicode": [(turn != "", F.lit("text changes its direction"))],
        "rust_abs_home_path": [(t.contains('"') & t.rlike(r"/Users/|/home/|C:\\{1,2}Users\\{1,2}") & ~plain.startswith("//"), F.lit("a path in a home folder"))],
        "rust_banner_comments": [(plain.rlike(r"^//(?![/!])[\s\-=*#~_]*[-=*#~_]{4}[\s\-=*#~_]*$"), F.lit("a banner"))],
        "rust_comment_space": [(plain.rlike(r"^//[^ /!#\[]"), F.lit("no space after the slashes"))],
    }


def scan(lines: DataFrame, wanted: dict[str, list[tuple[Column, Column]]]) -> DataFrame:
    """Findings of all rules over ``lines`` (rel, line, text): one projection and one explode, not a scan a rule."""
    cases = [F.when(cond, F.struct(F.lit(rule).alias("rule"), message.alias("message"))) for rule, own in wanted.items() for cond, message in own]
    out = None
    for k in range(0, len(cases), CHUNK):
        found = lines.select("rel", "line", F.explode(F.filter(F.array(*cases[k : k + CHUNK]), lambda x: x.isNotNull())).alias("f"))
        found = found.select("rel", "line", F.lit(None).cast("int").alias("column"), "f.rule", "f.message", F.lit(False).alias("fixable"))
        out = found if out is None else out.unionByName(found)
    return out
