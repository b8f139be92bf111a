"""Sharding by proportional stratified interleaving: every shard matches the mixture of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corposieve.llm._common import bounded, stage

SHARDS = 24
GOLDEN = 0.6180339887498949


def _numbered(df: DataFrame, *order: str, tag: str) -> DataFrame:
    """``df`` sorted over the cluster and written, with its partition ``_part`` and place ``_at`` in it."""
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stage(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), low.alias("_at")), tag)


def _step(n: Column) -> Column:
    """A number near 0.618 n that has no factor in common with n: rank times it, modulo n, is a permutation of ranks."""
    first = F.greatest(F.lit(1), F.round(n * F.lit(GOLDEN)).cast("long"))

    def coprime(a: Column) -> Column:
        left = F.aggregate(
            F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), n.alias("b")),
            lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))),
        )
        return left["a"] == 1

    return F.get(F.filter(F.sequence(first, first + 99), coprime), F.lit(0))  # of 100 numbers in a row one at least is coprime to a long


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = "shard", source: str = "source", texts: bool = False) -> DataFrame:
    """Put all rows into shards; counts of rows are at most one apart (law ``rows``).

    Rows are ranked within their source in an order hashed from ``seed`` and doc_id; a permutation puts rows that are
    neighbours there, such as the copies of a document, about 0.618 of the source apart; all rows are sorted by
    ``(rank + 0.5) / rows of the source`` and cut into equal parts. Returns ``doc_id, size, text_crc32, law, shard,
    slot, grown_shard, source``, one row per input row: size is 8 more than the text's UTF-8 bytes, slot a row's
    place in its shard from 0, grown_shard null under this law. With ``texts``, all other columns of ``docs`` come too
    (those that carry a name of an output are replaced); ``write_shards`` then writes files.

    Null text: size 8, CRC-32 0, as for an empty one. A null source is a source of its own. Ties of the hash (rows
    that share a doc_id) go by doc_id, size and CRC-32; rows equal in all have interchangeable places. No rows in,
    none out. Without ``texts`` other columns are neither read nor returned.

    Plan: two global sorts of narrow rows. No window spans a source or the table: a row's rank is its place in its
    sorted, written partition plus the counts of the partitions before, which are aggregates of a few rows. Texts move
    once to meet their place, and once more when they are written in its order.
    """
    if texts:
        docs = stage(docs.withColumn("_sieve_row", F.monotonically_increasing_id()), "rows")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = ["_sieve_row"] if texts else []
    rows = docs.select(
        *own, F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary")).alias("_key"),
    )
    ranked = _numbered(rows, "source", "_key", "doc_id", "size", "text_crc32", tag="ranked")
    parts = stage(ranked.groupBy("_part", "source").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")), "parts")
    whole = Window.partitionBy("source")  # a row for each partition that holds rows of the source
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(F.col("_part").alias("_p"), F.col("source").alias("_s"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("_of"))
    starts = stage(starts.withColumn("_step", _step(F.col("_of"))), "starts")
    placed = ranked.join(bounded(starts), (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    rank = (F.col("_at") + F.col("_shift")).cast("decimal(19,0)") * F.col("_step").cast("decimal(19,0)") % F.col("_of").cast("decimal(19,0)")
    at = (2 * rank.cast("long") + 1).cast("double") / (2 * F.col("_of")).cast("double")
    mixed = placed.select(*own, "doc_id", "source", "size", "text_crc32", "_key", at.alias("_rank"))
    mixed = _numbered(mixed, "_rank", "_key", "source", "doc_id", "size", "text_crc32", tag="mixed")
    counts = sorted(mixed.groupBy("_part").count().collect())  # as many as there are shuffle partitions
    total, offsets = 0, []
    for part, n in counts:
        offsets.append((part, total))
        total += n
    shifts = F.broadcast(docs.sparkSession.createDataFrame(offsets, "_part int, _before long"))
    place = mixed.join(shifts, "_part").withColumn("_place", F.col("_before") + F.col("_at"))
    place = place.withColumn("shard", F.expr(f"cast(_place * {shards} div {max(total, 1)} as int)"))
    slot = F.col("_place") - F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    out = place.select(*own, "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")
    if not texts:
        return out
    rest = docs.select("_sieve_row", *(c for c in docs.columns if c not in out.columns))
    return out.join(rest, "_sieve_row").drop("_sieve_row")


def write_shards(placed: DataFrame, path: str) -> None:
    """Write rows that have ``shard`` and ``slot`` as Parquet, a folder a shard, each file sorted by slot.

    A shard may have several files; their names follow the order of its slots.
    """
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
