"""Benchmark decontamination by spaced seeds; DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corposieve.llm._common import bounded, stage

#: Word positions that a seed reads; those between are ignored, so a word changed there does no harm.
#: The third mask meets the pairs of changes that hit every place of the other two.
MASKS = ((0, 1, 3, 6, 7), (0, 2, 3, 4, 8), (0, 1, 2, 4, 5))
#: An overlap counts if of so many words in a row on one diagonal at least so many are equal; of shorter items as large a part.
WINDOW, EQUAL = 12, 10
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words: runs of letters and digits (all beyond ASCII count as letters), lower case."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATOR), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def _places(h: Column, span: int) -> Column:
    return F.when(F.size(h) > span, F.sequence(F.lit(0), F.size(h) - span - 1)).otherwise(F.array().cast("array<int>"))


def seeds(h: Column) -> Column:
    """Every mask at every place that has room for it: structs of ``place`` and ``seed``, a hash."""
    def placed(k: int, m: tuple[int, ...]) -> Column:
        return F.transform(_places(h, m[-1]), lambda i: F.struct(i.alias("place"), F.xxhash64(F.lit(k), *(F.get(h, i + o) for o in m)).alias("seed")))

    return F.concat(*(placed(k, m) for k, m in enumerate(MASKS)))


def _whole(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, equal`` where a text holds all words in a row of an item of fewer than WINDOW."""
    short = items.where(F.size("item") < WINDOW).select("item_id", F.size("item").alias("equal"), F.xxhash64("item").alias("key"))
    lengths = sorted(r.equal for r in short.select("equal").distinct().collect())
    h = F.col("h")

    def runs(n: int) -> Column:
        return F.transform(_places(h, n - 1), lambda i: F.struct(F.lit(n).alias("equal"), F.xxhash64(F.slice(h, i + 1, n)).alias("key")))

    found = docs.select("doc_id", word_hashes(F.col("text")).alias("h")).select("doc_id", F.explode(F.concat(*(runs(n) for n in lengths))).alias("run"))
    return found.select("doc_id", "run.*").join(bounded(stage(short, "short")), ["equal", "key"]).select("doc_id", "item_id", "equal")


def _best(doc: Column, item: Column, diagonal: Column) -> Column:
    """The most equal words in a window of WINDOW places of the item laid on the text at ``diagonal``."""
    low, high = F.greatest(F.lit(0), -diagonal), F.least(F.size(item), F.size(doc) - diagonal)
    flags = F.transform(F.sequence(low, high - 1), lambda j: (F.get(item, j) == F.get(doc, j + diagonal)).cast("int"))
    sums = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(flags) - WINDOW)), lambda s: F.aggregate(F.slice(flags, s + 1, WINDOW), F.lit(0), lambda x, y: x + y))
    return F.array_max(sums)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_items, equal_words`` of the doc_ids whose text overlaps a benchmark item.

    Two texts overlap if a seed agrees and, on the diagonal of the hit, at least EQUAL of WINDOW words in a row are
    equal, or as large a part of a shorter item; or if the text holds a shorter item whole. A row per doc_id; n_items counts items, equal_words is the best window's.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text").cast("string")).alias("item")).where(F.size("item") > 0)
    items = stage(items.distinct(), "items")
    marks = stage(
        items.select("item_id", F.explode(seeds(F.col("item"))).alias("mark")).select("item_id", "mark.*"), "marks",
    )
    probes = docs.select("doc_id", word_hashes(F.col("text")).alias("h")).select("doc_id", F.explode(seeds(F.col("h"))).alias("probe")).select("doc_id", F.col("probe.place").alias("at"), "probe.seed")
    hits = (
        probes.join(bounded(marks.select("seed", "item_id", "place")), "seed")
        .select("doc_id", "item_id", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    )
    hits = stage(hits.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal")).alias("hits")).withColumnRenamed("doc_id", "hit_id"), "hits")
    met = docs.join(bounded(hits), F.col("doc_id").eqNullSafe(F.col("hit_id"))).select("doc_id", word_hashes(F.col("text")).alias("h"), F.explode("hits").alias("hit"))
    met = met.select("doc_id", "h", "hit.*").join(bounded(items.withColumnRenamed("item_id", "of_item")), F.col("item_id").eqNullSafe(F.col("of_item")))
    least = F.least(F.lit(EQUAL), F.ceil(F.size("item") * EQUAL / WINDOW))
    found = met.select("doc_id", "item_id", _best(F.col("h"), F.col("item"), F.col("diagonal")).alias("equal"), least.alias("least")).where("equal >= least").drop("least")
    if not items.where(F.size("item") < WINDOW).isEmpty():
        found = found.unionByName(_whole(docs, items))
    return found.groupBy("doc_id").agg(F.countDistinct(F.coalesce("item_id", F.lit(-1))).alias("n_items"), F.max("equal").cast("long").alias("equal_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The verdict on each row of ``docs``: ``doc_id, contaminated, n_items, equal_words``.

    Rows that share a doc_id (null is one too) are judged together: an overlap of one is an overlap of all. Texts
    that are null or without words overlap nothing, and such items catch nothing. Repeated items count once
    an item_id. An empty benchmark leaves all clean; no rows in, none out. Other columns are neither read nor
    returned.
    """
    found = stage(contaminated(docs, benchmark), "leaks").toDF("_id", "n_items", "equal_words")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(bounded(found), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("equal_words", F.lit(0)).alias("equal_words"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id isn't contaminated."""
    found = stage(contaminated(docs, benchmark).select(F.col("doc_id").alias("_leak")), "leaks")
    return docs.join(bounded(found), F.col("doc_id").cast("long").eqNullSafe(F.col("_leak")), "left_anti")
