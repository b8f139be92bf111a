"""LM scoring by masked pseudo-likelihood with a bidirectional window network in numpy.

The network sees ``SIDE`` words on either side of a position, never the word there, and gives that word's
probability in two steps (its group, then its place in the group). The network knows the frequent words and buckets
of all others. A word of a bucket has the bucket's probability times its own within the bucket:
``(count elsewhere + A * spelling) / (the bucket's words elsewhere + A)``. Counts are those of the whole corpus, from
a table that has every word; "elsewhere" leaves the scored document's own words out, so that a document doesn't vouch
for itself. A is a bucket's share of the words that the corpus has once (the mass that Good and Turing give to words not seen),
and spelling is the word's probability by pairs of bytes, so that a word no other document has is paid for by its
letters. A text's score is the sum of the logarithms of these probabilities over all its words.

Training deals all positions of every text into sevenths and masks some of these each round, so that every position
is a target once, in tasks that each improve the common weights on their own rows, after which the weights are
averaged over tasks in two levels of grouped sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposieve.llm._common import stage
from corposieve.llm._text import FOLD, SPACE, U, Words, mix, slices, words

SIDE, GROUPS, HIDDEN, BUCKETS = 2, 32, 16, 63
VOCABULARY = GROUPS * GROUPS  # edge of text, frequent words, buckets of the others
BATCH = 4096
#: Counts of so many words at most go to every task; those of the others are joined.
HEAD = 1 << 18
_SHAPES = {"w": (2 * SIDE, VOCABULARY, HIDDEN), "b": (HIDDEN,), "u": (HIDDEN, GROUPS), "ub": (GROUPS,), "l": (HIDDEN, GROUPS), "lb": (GROUPS, GROUPS)}
_SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())
_BLOCK = 8192
_BYTE = np.where(SPACE, 32, FOLD).astype(np.int64)


def start(seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 0.1, _SIZE).astype(np.float32)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k], at = flat[at : at + n].reshape(s), at + n
    return out


class Tokens:
    """Word hashes to ids: 0 is the edge of a text; then the frequent words by rank; then buckets of the others."""

    def __init__(self, frequent: list[int]) -> None:
        hashes = np.array(frequent, np.int64).view(U)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], (order + 1).astype(np.int32)
        self.first = len(hashes) + 1

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        other = (self.first + hashes % U(BUCKETS)).astype(np.int32)
        if not len(self.hashes):
            return other
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[k] == hashes, self.ids[k], other)


def windows(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(2 * SIDE, words): the ids around each position, 0 beyond its text."""
    n = len(ids)
    position = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    left = np.repeat(np.diff(first), np.diff(first)) - 1 - position
    out = np.zeros((2 * SIDE, n), np.int32)
    for k in range(1, SIDE + 1):
        out[k - 1, k:] = np.where(position[k:] >= k, ids[:-k], 0)
        out[SIDE + k - 1, : n - k] = np.where(left[: n - k] >= k, ids[k:], 0)
    return out


def _hidden(p: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    h = p["w"][0][around[0]]
    for k in range(1, 2 * SIDE):
        h += p["w"][k][around[k]]
    h += p["b"]
    h /= 1 + np.abs(h)  # softsign: as tanh, but cheap
    return h


def _odds(p: dict[str, np.ndarray], h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits of groups and of places in the group, and the sums of both."""
    n = len(h)
    x = np.empty((n, 2 * GROUPS), np.float32)
    np.matmul(h, p["u"], out=x[:, :GROUPS])
    np.matmul(h, p["l"], out=x[:, GROUPS:])
    x[:, :GROUPS] += p["ub"]
    x[:, GROUPS:] += p["lb"][group]
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    return x, x.reshape(n, 2, GROUPS) @ np.ones(GROUPS, np.float32)


def log_probabilities(p: dict[str, np.ndarray], around: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids))
    for a in range(0, len(ids), BATCH):
        y, h = ids[a : a + BATCH], _hidden(p, around[:, a : a + BATCH])
        k, group = np.arange(len(y)), y // GROUPS
        x, total = _odds(p, h, group)
        out[a : a + BATCH] = np.log(x[k, group] / total[:, 0]) + np.log(x[k, GROUPS + y % GROUPS] / total[:, 1])
    return out


def train_step(p: dict[str, np.ndarray], square: dict[str, np.ndarray], around: np.ndarray, y: np.ndarray, rate: float) -> None:
    """One Adagrad step on the masked positions ``y``."""
    h, n, k = _hidden(p, around), len(y), np.arange(len(y))
    group, place = y // GROUPS, y % GROUPS
    x, total = _odds(p, h, group)
    d = (x.reshape(n, 2, GROUPS) / (total * n)[:, :, None]).reshape(n, 2 * GROUPS)
    d[k, group] -= np.float32(1 / n)
    d[k, GROUPS + place] -= np.float32(1 / n)
    dg, dp = d[:, :GROUPS], d[:, GROUPS:]
    dh = d @ np.concatenate((p["u"], p["l"]), axis=1).T
    slope = 1 - np.abs(h)
    dh *= slope
    dh *= slope

    def move(name: str, where, g: np.ndarray) -> None:
        square[name][where] += g * g
        p[name][where] -= rate * g / np.sqrt(square[name][where] + 1e-8)

    gw = h.T @ d
    one = np.zeros((GROUPS, n), np.float32)
    one[group, k] = 1
    cells = (around + np.arange(2 * SIDE)[:, None] * VOCABULARY).ravel()
    each, rows = np.tile(dh.T.astype(np.float64), (1, 2 * SIDE)), np.empty((2 * SIDE * VOCABULARY, HIDDEN), np.float32)
    for j in range(HIDDEN):
        rows[:, j] = np.bincount(cells, each[j], 2 * SIDE * VOCABULARY)
    move("w", slice(None), rows.reshape(2 * SIDE, VOCABULARY, HIDDEN))
    move("lb", slice(None), one @ dp)
    for name, g in (("u", gw[:, :GROUPS]), ("l", gw[:, GROUPS:]), ("ub", dg.sum(0)), ("b", dh.sum(0))):
        move(name, slice(None), g)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def byte_pairs(w: Words) -> np.ndarray:
    """(256 * 256) counts of pairs of bytes within words, with a space (32) before and after each word."""
    if not len(w.starts):
        return np.zeros(1 << 16, np.int64)
    f = _BYTE[w.data[w.starts[0] : w.ends[-1]]]
    counts = np.bincount(f[:-1] * 256 + f[1:], minlength=1 << 16)
    close = w.starts[1:][w.starts[1:] == w.ends[:-1]] - w.starts[0]  # words of two texts that no byte parts
    for sign, x, y in ((-1, f[close - 1], f[close]), (1, f[close - 1], 32), (1, 32, f[close]), (1, 32, f[:1]), (1, f[-1:], 32)):
        np.add.at(counts, x * 256 + y, sign)
    counts[32 * 257] = 0  # runs of spaces
    return counts


def spelling(w: Words, at: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities of the words ``at``, by pairs of bytes."""
    if not len(at):
        return np.zeros(0)
    low = int(w.starts[at[0]])
    f = _BYTE[w.data[low : int(w.ends[at].max())]]
    total = np.concatenate(([0.0, 0.0], np.cumsum(letters[f[:-1] * 256 + f[1:]])))  # total[i + 1]: pairs up to the one that ends at i
    s, e = w.starts[at] - low, w.ends[at] - low
    return letters[32 * 256 + f[s]] + letters[f[e - 1] * 256 + 32] + total[e] - total[s + 1]


def gather(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``h, n``, staged: the hash of every word of all texts and how often it is there; and logarithms of byte pairs' probabilities."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.zeros(1 << 16, np.int64)
        for batch in batches:
            hashes = []
            for part in slices(batch):
                w = words(part.column(0))
                hashes.append(w.hashes)
                letters += byte_pairs(w)
            h, n = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), np.int8)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "h", "n"])
        k = np.flatnonzero(letters)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(k), np.int8)), pa.array(k), pa.array(letters[k])], ["kind", "h", "n"])

    both = stage(_texts(docs).select("text").mapInArrow(count, "kind byte, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")), "words")
    pairs = np.full(1 << 16, 0.1)
    for r in both.where("kind = 1").collect():  # 65,536 rows at most
        pairs[r.h] += r.n
    pairs = pairs.reshape(256, 256)
    return both.where("kind = 0").select("h", "n"), np.log(pairs / pairs.sum(axis=1, keepdims=True)).ravel()


def frequent_first(counts: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words: all of a count or none, ``most`` at most, by count, then hash.

    At least the VOCABULARY - BUCKETS - 1 first ones are there, ties by hash.
    """
    band = F.floor(8 * F.log2("n")).cast("int")
    sizes = sorted(((r.band, r.words) for r in counts.groupBy(band.alias("band")).agg(F.count("*").alias("words")).collect()), reverse=True)  # a few hundred
    least, words_ = None, 0
    for band_, size in sizes:
        words_ += size
        if words_ > most:
            break
        least = band_
    known = VOCABULARY - BUCKETS - 1
    top = counts.where(band >= least) if least is not None else counts.limit(0)
    got = top.toPandas()
    if len(got) < known:
        got = counts.orderBy(F.desc("n"), "h").limit(known).toPandas()
    got = got.sort_values(["n", "h"], ascending=[False, True])
    return got["h"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def bucket_sizes(counts: DataFrame, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many words of the corpus fall into each bucket, without the ``hashes`` whose counts are ``n``."""
    bucket = F.pmod(F.pmod("h", F.lit(BUCKETS)) + F.when(F.col("h") < 0, 2**64 % BUCKETS).otherwise(0), F.lit(BUCKETS))
    out = np.zeros(BUCKETS)
    for r in counts.groupBy(bucket.cast("int").alias("bucket")).agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out - np.bincount((hashes.view(U) % U(BUCKETS)).astype(np.int64), n, BUCKETS)


def targets(hashes: np.ndarray, first: np.ndarray, ids: np.ndarray, turn: int, rounds: int, folds: int) -> np.ndarray:
    """The positions masked in a turn. Over all rounds each position is masked once; in ``rounds`` beyond ``folds``, again.

    A position's fold hangs on its word, its place and its text's id.
    """
    count = np.diff(first)
    order = (np.arange(len(hashes)) - np.repeat(first[:-1], count)).astype(U)
    own = np.repeat(mix(ids.astype(np.int64).view(U) + U(1)), count)
    fold = mix(hashes + order * U(0x9E3779B97F4A7C15) + own) % U(folds)
    return np.flatnonzero(np.isin(fold, [f % folds for f in range(max(folds, rounds)) if f % rounds == turn]))


def _average(parts: DataFrame, into: int) -> DataFrame:
    """Sum weighted blocks; a task holds one sum a block, however many rows come."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, weight, cells in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                x = np.frombuffer(cells, np.float64)
                if block in sums:
                    sums[block] = [sums[block][0] + weight, sums[block][1] + x]
                else:
                    sums[block] = [weight, x]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([0] * len(sums), pa.int64()), pa.array([v[0] for v in sums.values()], pa.float64()), pa.array([v[1].tobytes() for v in sums.values()], pa.binary())],
            ["block", "salt", "weight", "cells"],
        )

    return parts.repartition(into, "block", "salt").mapInArrow(add, parts.schema)


def train(docs: DataFrame, frequent: list[int], rounds: int = 2, rate: float = 0.15, masked: float = 1 / 7) -> np.ndarray:
    """The weights."""
    weights = start()
    folds = max(1, round(1 / masked))
    for turn in range(rounds):
        given, step = weights, rate / (1 + turn)

        def learn(batches: Iterator[pa.RecordBatch], given=given, step=step, turn=turn) -> Iterator[pa.RecordBatch]:
            flat = given.copy()
            p, square, tokens, seen = views(flat), views(np.full(_SIZE, 1e-4, np.float32)), Tokens(frequent), 0
            waiting, waits = [], 0

            def flush() -> None:
                x, y = np.concatenate([w[0] for w in waiting], axis=1), np.concatenate([w[1] for w in waiting])
                for a in range(0, len(y), BATCH):
                    train_step(p, square, x[:, a : a + BATCH], y[a : a + BATCH], step)
                waiting.clear()

            for batch in batches:
                for part in slices(batch):
                    w = words(part.column(1))
                    ids = tokens(w.hashes)
                    pick = targets(w.hashes, w.first, part.column(0).fill_null(0).to_numpy(zero_copy_only=False), turn, rounds, folds)
                    if len(pick):
                        waiting.append((windows(ids, w.first)[:, pick], ids[pick]))
                        waits, seen = waits + len(pick), seen + len(pick)
                        if waits >= 4 * BATCH:
                            flush()
                            waits = 0
            if waiting:
                flush()
            if seen:
                cells = [(flat[a : a + _BLOCK].astype(np.float64) * seen).tobytes() for a in range(0, _SIZE, _BLOCK)]
                salt = int(mix(np.array([seen], U))[0] % U(16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(cells)), pa.int64()), pa.array([salt] * len(cells), pa.int64()), pa.array([float(seen)] * len(cells)), pa.array(cells, pa.binary())],
                    ["block", "salt", "weight", "cells"],
                )

        parts = _texts(docs).mapInArrow(learn, "block long, salt long, weight double, cells binary")
        sums = _average(_average(parts, 16), 4).orderBy("block").collect()  # one copy of the weights
        if sums:
            weights = np.concatenate([np.frombuffer(r.cells, np.float64) / r.weight for r in sums]).astype(np.float32)
    return weights


@dataclass
class Model:
    """What scoring needs: the network, the most frequent words' counts (by count), all words' counts and the letters."""

    weights: np.ndarray
    hashes: np.ndarray
    n: np.ndarray
    counts: DataFrame
    letters: np.ndarray
    sizes: np.ndarray
    unseen: float

    @property
    def frequent(self) -> list[int]:
        return self.hashes[: VOCABULARY - BUCKETS - 1].tolist()


def fit(docs: DataFrame, rounds: int = 2) -> Model:
    """Count the words of all texts and train the network on all their positions."""
    counts, letters = gather(docs)
    hashes, n = frequent_first(counts)
    known = VOCABULARY - BUCKETS - 1
    once = counts.where("n = 1").count()
    sizes = bucket_sizes(counts, hashes[:known], n[:known])
    return Model(train(docs, hashes[:known].tolist(), rounds), hashes, n, counts, letters, sizes, max(1.0, once / BUCKETS))


def score(docs: DataFrame, model: Model, own: bool = False) -> DataFrame:
    """``doc_id, n_words, log_likelihood, per_word``, one row per input row; ``own``: the model's counts hold these texts."""
    frequent, hashes, n, letters, sizes, unseen, weights = model.frequent, model.hashes, model.n, model.letters, model.sizes, model.unseen, model.weights

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, tokens = views(weights.copy()), Tokens(frequent)
        order = np.argsort(hashes.view(U))
        head, head_n = hashes.view(U)[order], n[order]
        for batch in batches:
            for part in slices(batch):
                w = words(part.column(1))
                ids, texts = tokens(w.hashes), part.num_rows
                text = np.repeat(np.arange(texts), w.count)
                total = np.bincount(text, log_probabilities(p, windows(ids, w.first), ids), texts).astype(float)
                rare = np.flatnonzero(ids >= tokens.first)
                bucket = ids[rare] - tokens.first
                # each text's own rare words, once, with their number there
                _, one, times = np.unique(mix(w.hashes[rare]) + text[rare].astype(U) * U(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
                order_ = np.argsort(one)
                one, times = one[order_], times[order_]
                at, of_bucket = rare[one], bucket[one]
                row, h = text[at], w.hashes[at]
                here = np.bincount(text[rare] * BUCKETS + bucket, minlength=texts * BUCKETS) if own else np.zeros(texts * BUCKETS, np.int64)
                rest = np.log(np.maximum(sizes[of_bucket] - here[row * BUCKETS + of_bucket], 0) + unseen)
                new = unseen * BUCKETS * np.exp(spelling(w, at, letters))
                total -= np.bincount(row, times * rest, texts)
                k = np.minimum(np.searchsorted(head, h), max(0, len(head) - 1))
                there = (head[k] == h) if len(head) else np.zeros(len(h), bool)
                seen = (head_n[k[there]] - (times[there] if own else 0)).clip(0)
                total += np.bincount(row[there], times[there] * np.log(seen + new[there]), texts)
                tail = ~there  # their counts are joined
                ends = np.searchsorted(row[tail], np.arange(texts + 1)).astype(np.int32)
                cells = pa.StructArray.from_arrays([pa.array(h[tail].view(np.int64)), pa.array(times[tail].astype(np.int32)), pa.array(new[tail])], ["h", "times", "new"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.count.astype(np.int64)), pa.array(total), pa.ListArray.from_arrays(pa.array(ends), cells)], ["doc_id", "n_words", "own", "tail"])

    scored = _texts(docs).mapInArrow(of, "doc_id long, n_words long, own double, tail array<struct<h:long,times:int,new:double>>")
    scored = stage(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    seen = F.coalesce("n", F.lit(0)) - (F.col("t.times") if own else F.lit(0))
    shares = (
        scored.select("row", F.explode("tail").alias("t")).join(model.counts, F.col("t.h") == F.col("h"), "left")
        .groupBy("row").agg(F.sum(F.col("t.times") * F.log(F.greatest(seen, F.lit(0)) + F.col("t.new"))).alias("share")).withColumnRenamed("row", "of_row")
    )
    out = scored.select("row", "doc_id", "n_words", "own").join(shares, F.col("row") == F.col("of_row"), "left")
    out = out.select("doc_id", "n_words", (F.col("own") + F.coalesce("share", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def lm_score(docs: DataFrame, rounds: int = 2, corpus: DataFrame | None = None) -> DataFrame:
    """Train on ``corpus`` (``docs`` itself if there is none) and score ``docs``: ``doc_id, n_words, log_likelihood, per_word``.

    log_likelihood is the sum over all words of a text of log P(word | words on both sides); per_word is its mean.
    Where ``docs`` are the corpus, a text's own words aren't counted among those seen; the network has been trained on
    them. Null or empty text: 0 words, 0.0, and null per word. Repeated rows count each in training, vouch for one
    another and get equal scores. No rows in, none out. Other columns are neither read nor returned. The network's
    weights are means over the tasks of its training, so they hang on how the input is split into tasks; the counts don't.

    Plan: counts are pre-aggregated by task; those of the HEAD most frequent words go to every task (4 MB at most), and only a
    text's other words are shuffled, each once, to meet theirs. The driver holds the weights, the head and byte pairs.
    """
    return score(docs, fit(docs if corpus is None else corpus, rounds), corpus is None)


__all__ = ["Model", "Tokens", "bucket_sizes", "byte_pairs", "fit", "frequent_first", "gather", "lm_score", "log_probabilities", "score", "spelling", "start", "targets", "train", "train_step", "views", "windows"]
