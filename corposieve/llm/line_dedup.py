"""Line dedup: explode normalised lines, hash, count distinct documents, drop, reassemble by position."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposieve.llm._common import stage
from corposieve.llm._text import slices


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line of a text its 16-byte key, or None for a line too short to count."""
    keys: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # bytes.lower folds A-Z alone
        line = line.strip()  # bytes.strip takes [\x20\x09-\x0D]
        n = len(line)
        if n >= min_chars and (n >= 4 * min_chars or len(line.decode("utf-8", "replace")) >= min_chars):
            keys.append(xxhash.xxh3_128_digest(line))
        else:
            keys.append(None)
    return keys


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines found in at least ``min_docs`` documents everywhere but in the smallest doc_id that holds them.

    A line's key is the line with ASCII white space stripped and A-Z folded; keys of fewer than ``min_chars``
    code points always stay. Returns ``doc_id, n_lines, n_dropped, text`` (what stays, joined by newlines),
    one row per input row. Null or empty text: one empty line. Rows that share a doc_id count as one document
    and lose the same keys; rows whose doc_id is null are kept whole and count nowhere. No rows in, none out;
    other columns of ``docs`` are neither read nor returned.

    Plan: texts are split and hashed once, into a staged row a line that counts: doc_id, the text's own hash, the line's place and its
    16-byte key. Keys are counted with map-side aggregation (one that a third of all documents hold costs a row a
    task) and joined back to their lines, a join that AQE can split, as the side of shared keys is unique. A document's
    text moves once, to meet the places of its dropped lines, and is put together again by place.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("of", F.when(F.col("doc_id").isNotNull() & (F.col("text") != ""), F.xxhash64("text", F.octet_length("text"))))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, of, places, keys = [], [], [], []
                for d, t, h in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    if h is not None:
                        own = [(i, k) for i, k in enumerate(line_keys(t.encode(), min_chars)) if k]
                        ids += [d] * len(own)
                        of += [h] * len(own)
                        places += [i for i, _ in own]
                        keys += [k for _, k in own]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(of, pa.int64()), pa.array(places, pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "of", "place", "key"])

    lines = stage(docs.mapInArrow(explode, "doc_id long, of long, place int, key binary"), "lines")
    held = lines.groupBy("key")
    if min_docs == 2:  # the least and the largest id tell whether two distinct documents hold it
        shared = held.agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last")
    else:
        shared = held.agg(F.min("doc_id").alias("keeper"), F.countDistinct("doc_id").alias("n")).where(F.col("n") >= min_docs)
    lost = (
        lines.join(shared.select("key", "keeper"), "key").where(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id", "of").agg(F.collect_set("place").alias("lost"))  # no more than the document's own lines
    )

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, dropped, kept = [], [], []
                for t, out in zip(part.column("text").to_pylist(), part.column("lost").to_pylist(), strict=True):
                    rows = (t or "").split("\n")
                    n.append(len(rows))
                    if out:
                        gone = set(out)
                        rows = [r for i, r in enumerate(rows) if i not in gone]
                    dropped.append(n[-1] - len(rows))
                    kept.append("\n".join(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_lines", "n_dropped", "text"],
                )

    return docs.join(stage(lost, "lost"), ["doc_id", "of"], "left").select("doc_id", "text", "lost").mapInArrow(rebuild, "doc_id long, n_lines long, n_dropped long, text string")
