"""MinHash near-dedup with sequential Bayesian verification.

1. Each document's set of word shingles gives a fingerprint, its size and its minhashes, as many as the threshold's bands need. Documents
   with one and the same set form a class; one of them stands for it from here on.
2. Representatives that agree on a whole band share a bucket. In rounds, each bucket's next leaders (1, 8, 64, ...)
   are paired with its other members, except those already known to be in the leader's component; a used leader
   leaves its bucket. So every pair of a bucket is compared or else already joined, yet a bucket of n close copies
   costs about n pairs, not n squared. There is no cap.
3. Pairs are compared on batches of minhashes. A pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold is below ``miss``; survivors are verified on their full sets.
4. Components of the links come from alternating large-star and small-star steps over DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corposieve.llm._common import bounded, stage, unstage
from corposieve.llm._text import U, shingles, slices, words

#: Minhashes a document at most, those compared at once, and the chosen probability that no band of a link at the threshold agrees.
MOST, BATCH, BAND_MISS = 200, 30, 7e-7
_RNG = np.random.default_rng(77)
_ODD32 = _RNG.integers(0, 2**31, (2, MOST), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR32 = _RNG.integers(0, 2**32, MOST, dtype=np.uint32)
_BAND = _RNG.integers(1, 2**63, (MOST, MOST), dtype=U) * U(2) + U(1)
_BLOCK = 1 << 15


def banding(threshold: float, miss: float = BAND_MISS, most: int = MOST) -> tuple[int, int]:
    """(rows, bands): the longest bands that miss a link at ``threshold`` with probability ``miss`` at most, of ``most`` minhashes at most."""
    rows, found = 1, None
    while rows <= most:
        bands = max(1, ceil(log(miss) / log1p(-(threshold**rows)))) if threshold < 1 else 1
        if rows * bands > most:
            break
        found, rows = (rows, bands), rows + 1
    if found is None:
        raise ValueError(f"links at {threshold} can't be found with {most} minhashes")
    return found


def minhashes(values: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) uint32; rows of empty sets are zero."""
    out = np.zeros((len(offsets) - 1, n), np.uint32)
    short = (values ^ (values >> U(32))).astype(np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(offsets[full + 1], offsets[full[at]] + _BLOCK, "right")))
        a, b = int(offsets[full[at]]), int(offsets[full[to - 1] + 1])
        x, starts, y, z = short[a:b], offsets[full[at:to]] - a, np.empty(b - a, np.uint32), np.empty(b - a, np.uint32)
        for k in range(n):
            np.bitwise_xor(x, _XOR32[k], out=y)
            np.multiply(y, _ODD32[0, k], out=y)
            np.right_shift(y, np.uint32(15), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, _ODD32[1, k], out=y)
            out[full[at:to], k] = np.minimum.reduceat(y, starts)
        at = to
    return out


def least_matches(threshold: float, miss: float, marks: int) -> list[tuple[int, int]]:
    """(minhashes compared, matches below which a pair is dropped), batch by batch.

    With a uniform prior, the posterior of similarity >= t after m matches of n is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in [*range(BATCH, marks, BATCH), marks]:
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < miss:
            m += 1
        out.append((n, min(m, n)))
    return out


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``u, v``; root is the least node that can be reached."""
    e = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "cc")
    said = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        unstage(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == said:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
            out._of = e
            return out
        said = now


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def near_dup(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """Link documents whose shingle sets have ``100 * intersection >= percent * union``.

    Returns ``doc_id, n_shingles, component_id, kept``, one row per input row: component_id is the smallest
    doc_id reachable over links, kept tells whether that is the row itself. Words are runs of bytes that aren't
    ASCII white space, A-Z folded; sets hold ``size``-word shingles, or the whole sequence for a shorter text.

    Null or empty texts and those of white space have an empty set and are linked with nothing. Rows with words
    that share a doc_id are one node: each keeps its own n_shingles, and they share component and verdict. A row
    whose doc_id is null is linked with nothing: component_id null, kept true. No rows in, none out. Other columns
    are neither read nor returned.

    A link is missed if no band agrees (probability BAND_MISS at most: rows and bands follow from ``percent``, 36 of 5 at
    80) or its signature is an outlier (``miss``). A ``percent`` too low for MOST minhashes (below about 7) is an error.
    """
    rows, bands = banding(percent / 100)
    marks_ = rows * bands
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, offsets = shingles(words(part.column(1)), size)
                n = np.diff(offsets)
                prints = []
                for salt in (U(0x51ED270B0A1F39C1), U(0xA24BAED4963EE407)):
                    total = np.concatenate((np.zeros(1, U), np.cumsum((values ^ salt) * (values | U(1)) + (values >> U(29)))))
                    prints.append(total[offsets[1:]] - total[offsets[:-1]])
                marks = minhashes(values, offsets, marks_)
                sig = pa.Array.from_buffers(pa.binary(marks.shape[1] * 4), len(marks), [None, pa.py_buffer(marks.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), *map(_signed, prints), sig.cast(pa.binary())],
                    ["doc_id", "n", "f1", "f2", "sig"],
                )

    signed = stage(docs.mapInArrow(sign, "doc_id long, n long, f1 long, f2 long, sig binary"), "signed")
    classes = stage(
        signed.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min_by("sig", "doc_id").alias("sig"), F.min("doc_id").alias("rep")),
        "classes",
    )

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _marks(batch.column(1), marks_)
            keys = np.zeros((len(marks), bands), U)
            for r in range(rows):
                keys ^= keys >> U(31)
                keys = (keys + marks[:, r::rows]) * _BAND[r, :bands]
            yield pa.RecordBatch.from_arrays(
                [_signed((keys ^ (keys >> U(32))).ravel()), *(pa.array(np.repeat(batch.column(k).to_numpy(), bands)) for k in (0, 2))], ["bucket", "rep", "n"]
            )

    banded_ = stage(classes.select("rep", "sig", "n").mapInArrow(banded, "bucket long, rep long, n long"), "bands")
    shared = stage(banded_.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("bucket"), "shared")
    members = stage(banded_.join(shared, "bucket").distinct(), "members")
    unstage(banded_, shared)
    sigs = stage(classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "sig"), "sigs")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, offsets = shingles(words(part.column(1)), size)
                cells = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells, pa.binary())], ["rep", "cells"])

    whole = stage(docs.join(bounded(sigs.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi").mapInArrow(sets, "rep long, cells binary"), "sets")
    steps = least_matches(percent / 100, miss, marks_)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _marks(batch.column(2), marks_), _marks(batch.column(3), marks_)
            alive, matches, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
            for n, least in steps:
                matches[alive] += (a[alive, at:n] == b[alive, at:n]).sum(axis=1)
                alive, at = alive[matches[alive] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], ["u", "v"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for x, y, p, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, q = np.frombuffer(p, U), np.frombuffer(q, U)
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    both = np.concatenate((p, q))
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    if 100 * same >= percent * (len(both) - same):
                        u.append(x)
                        v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def ends(pairs: DataFrame, side: DataFrame, what: str) -> DataFrame:
        for k in ("u", "v"):
            pairs = pairs.join(side.select(F.col("rep").alias(k), F.col(what).alias(f"{what}_{k}")), k)
        return pairs.select("u", "v", f"{what}_u", f"{what}_v")

    named = signed.where("n > 0 and doc_id is not null").select("doc_id", "f1", "f2", "n").distinct()
    twice = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    bridges = named.join(twice, "doc_id").join(classes, ["f1", "f2", "n"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    roots, done, count, known = None, None, 1, members.withColumn("comp", F.col("rep"))
    used = [members]
    sized = 100 * F.least("n", "n_lead") >= percent * F.greatest("n", "n_lead")  # sets of other sizes can't be alike enough
    while True:
        if done is None:
            lead = known.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("x")).select("bucket", F.col("x.rep").alias("lead"), F.col("x.rep").alias("of"), F.col("x.n").alias("n_lead"))
        else:
            lead = (
                known.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("rep"))).where(F.col("k") <= count)
                .select("bucket", F.col("rep").alias("lead"), F.col("comp").alias("of"), F.col("n").alias("n_lead"))
            )
        lead = stage(lead, "lead")
        pairs = known.join(lead, "bucket").where("rep != lead and comp != of").where(sized).select(F.least("rep", "lead").alias("u"), F.greatest("rep", "lead").alias("v")).distinct()
        pairs = stage(pairs if done is None else pairs.join(done, ["u", "v"], "left_anti"), "pairs")
        used.append(pairs)
        done = pairs if done is None else done.union(pairs)
        survivors = stage(ends(pairs, sigs, "sig").mapInArrow(likely, "u long, v long"), "likely")
        links = ends(survivors, whole, "cells").mapInArrow(verified, "u long, v long")
        before, roots = roots, components(links.union(bridges if roots is None else roots.where("node != root").toDF("u", "v")))
        known = (
            known.select("bucket", "rep", "n").join(lead.select("bucket", F.col("lead").alias("rep")), ["bucket", "rep"], "left_anti")
            .join(roots.toDF("rep", "root"), "rep", "left").select("bucket", "rep", "n", F.coalesce("root", "rep").alias("comp"))
        )
        open_ = known.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        known, count = stage(known.join(open_.select("bucket"), "bucket"), "known"), count * 8
        unstage(lead, survivors, getattr(before, "_of", None))
        used.append(known)
        if known.isEmpty():
            break
    unstage(*used, sigs, whole)
    of_class = classes.select("f1", "f2", "n", "rep").join(roots.toDF("rep", "root"), "rep", "left").select("f1", "f2", "n", F.coalesce("root", "rep").alias("component_id"))
    out = signed.select("doc_id", "n", "f1", "f2").join(of_class, ["f1", "f2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def _marks(column: pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, n), np.uint32)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    a, b = np.frombuffer(offsets, kind)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(data, np.uint8)[a:b].view(np.uint32).reshape(-1, n)
