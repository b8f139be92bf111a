"""From raw documents to training shards: each stage works on all rows that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corposieve.llm import decontaminate, mixing, near_dup, quality_model, sharding
from corposieve.llm._common import bound_batches, bounded, clear_staged, stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical quality classifier rejects go.

    A null or empty text is judged like any other, by what the classifier makes of no words. Repeated rows share a
    verdict. An empty table gives an empty one; without labels all stay. Other columns pass through, whatever their names.
    """
    bound_batches(spark)
    return quality_model.quality_classifier(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id.

    Texts that are null, empty or of white space, and rows without a doc_id, are linked with nothing and stay. Rows
    that share a doc_id are one document, kept or dropped together. An empty table gives an empty one. Other columns
    pass through.
    """
    bound_batches(spark)
    found = near_dup.near_dup(docs)
    gone = stage(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "copies")
    return docs.join(bounded(gone), docs.doc_id.cast("long") == gone._gone, "left_anti")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go.

    Null and empty texts overlap nothing and stay. Rows that share a doc_id (null is one, too) go together. An empty
    table or benchmark drops nothing. Other columns pass through.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that sources come to their target weights; some small shares of large sources go.

    Texts aren't looked at; a null source is a source of its own. Rows that share a doc_id are repeated alike; copies
    are equal rows. An empty table gives an empty one. Other columns pass through, but for one named ``copy``.
    """
    return mixing.mix(docs).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and slot; the text and all other columns come along.

    A null text has the size of an empty one. Equal rows, such as the copies that mixing made, have interchangeable
    places, far apart in the order. An empty table gives an empty one. A column that carries a name of the
    assignment's (size, text_crc32, law, shard, slot, grown_shard) is replaced.
    """
    return sharding.shard(docs, texts=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("near-dedup", near_dup_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier is fitted, so SQL can't express it; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Run all stages and write the shards under ``path``, a folder a shard, rows by slot; then delete what was staged."""
    sharding.write_shards(run(spark, sf_dir), path)
    clear_staged(spark)
