"""Quality classifier: a document's own evidence, shrunk hierarchically with its host's and path's posteriors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corposieve.llm._common import bounded, stage
from corposieve.llm._text import U, mix, slices, words
from corposieve.llm.quality_rules import per_text, repeated_words

#: Labelled documents that the document classifier is fitted on, at most: those of the least hash of doc_id.
FIT_ROWS = 12_000


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_BYTES = {
    "symbol": _class(b"#*$%&<>@^~+=\\{}[]_"), "bar": _class(b"|"), "bang": _class(b"!?"), "digit": _class(b"0123456789"),
    "upper": _class(bytes(range(65, 91))), "stop": _class(b".,;:"), "line": _class(b"\n"), "high": np.arange(256) >= 0xC0,
}
#: Buckets of hashed words and pairs of neighbouring words; texts measured at once.
GRAMS, _ROWS = 512, 2048
FEATURES = [*_BYTES, "length", "word_length", "distinct", "repeat", "short", "long"]
WIDTH = 2 * len(FEATURES) + GRAMS


def features(column: pa.Array) -> np.ndarray:
    """(texts, WIDTH) float32: surface features, each as it is and as its square root, and roots of the shares of hashed words and pairs of words."""
    parts = [_features(column.slice(a, _ROWS)) for a in range(0, len(column), _ROWS)]
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)


def _features(column: pa.Array) -> np.ndarray:
    w = words(column)
    n, size = w.count.astype(float), np.diff(w.offsets).astype(float)
    per_word = np.maximum(n, 1)
    lengths = w.ends - w.starts

    def counted(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(flags), w.first))

    # distinct words: one sort of 24 bits of the text's number in its slice and 40 of the hash
    text = np.repeat(np.arange(len(n), dtype=U), w.count)
    keys = np.sort((text << U(40)) | (w.hashes >> U(24)))
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    distinct = np.bincount((keys[new] >> U(40)).astype(np.int64), minlength=len(n))
    cols = [per_text(flags[w.data], w.offsets) / per_word for flags in _BYTES.values()]
    cols += [np.log1p(n) / 10, size / per_word / 10, distinct / per_word, repeated_words(w.hashes, w.first, 5) / per_word, counted(lengths <= 3) / per_word, counted(lengths >= 12) / per_word]
    x = np.minimum(np.stack(cols, axis=1), 20)
    bag = np.bincount((text * U(GRAMS) + w.hashes % U(GRAMS)).astype(np.int64), minlength=len(n) * GRAMS)
    if len(w.hashes) > 1:
        inside = np.flatnonzero(text[1:] == text[:-1])
        pairs = mix(w.hashes[inside] * U(3) + w.hashes[inside + 1])
        bag = bag + np.bincount((text[inside] * U(GRAMS) + pairs % U(GRAMS)).astype(np.int64), minlength=len(n) * GRAMS)
    return np.concatenate((x, np.sqrt(x), np.sqrt(bag.reshape(len(n), GRAMS) / per_word[:, None])), axis=1).astype(np.float32)


class Logistic:
    """Ridge logistic regression by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
        z = np.concatenate(((x - self.mean) / self.scale, np.ones((len(x), 1))), axis=1)
        self.weight = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(30 if len(np.unique(y)) > 1 else 0):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.weight)
            self.weight += step
            if np.abs(step).max() < 1e-8:
                break

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality, each part of a text's features limited, so that no odd text overflows."""
        return np.clip(np.clip((x - self.mean) / self.scale, -30, 30) @ self.weight[:-1] + self.weight[-1], -30, 30)


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Logistic:
    """Fit on at most ``most`` labelled documents (a documented bound), picked by a hash of doc_id."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().dropDuplicates(["doc_id"])
    picked = stage(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(bounded(picked), "doc_id")

    def measure(batches):
        for batch in batches:
            for part in slices(batch):
                x = features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    # one row a label, though a doc_id may be repeated: the number of rows that come to the driver stays bounded (27 MB)
    own = rows.select("doc_id", "text", "quality").mapInArrow(measure, "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r"))
    got = own.orderBy("doc_id").select("r.*").toPandas()
    x = np.stack([np.frombuffer(v, np.float32) for v in got["x"]]) if len(got) else np.zeros((0, WIDTH), np.float32)
    return Logistic(x, got["quality"].to_numpy().astype(float))


def rates_prior(groups: DataFrame, centre: Column | None = None) -> tuple[float, float]:
    """Mean of all and concentration of the beta distribution of groups' rates around it (or around ``centre``), by moments.

    ``groups``: a row a group, of ``n``, ``good`` and ``square``, the sums of its documents' probabilities and of their
    squares. Means of n probabilities differ by chance as much as these differ within the group, over n: less than the same number of zeros
    and ones would. That is taken off the spread.
    """
    rate = F.col("good") / F.col("n")
    total, good = groups.agg(F.sum("n"), F.sum("good")).first()
    if not total:
        return 0.5, 1e6
    mean = min(1 - 1e-6, max(1e-6, good / total))
    around = F.lit(mean) if centre is None else centre
    chance = F.greatest(F.lit(0.0), F.col("square") - F.col("n") * rate * rate) / F.greatest(F.lit(1), F.col("n") - 1)  # n times the mean's variance
    between = groups.agg(F.sum(F.col("n") * (rate - around) ** 2 - chance) / F.lit(float(total))).first()[0]
    return mean, min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6


def quality_verdicts(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, host, path, evidence, host_rate, path_rate, p_quality, kept, of``, one row per input row, staged.

    A path is a host's subdivision. ``evidence`` is the log odds of the text alone. A host's rate of good documents
    is shrunk towards the mean of all, a path's towards its host's; weights are those of beta priors fitted by
    moments, a host's around the mean, a path's around its host. Both rates leave the document's own evidence out, so that it
    counts once. A document's log odds are its evidence plus what its path's rate has over the mean's; it is kept
    if their probability is at least ``least``. ``of`` is a hash of the text.

    Null or empty texts have no words and get what the classifier gives such a text. A null host or path is a value
    of its own. Repeated rows count each and get equal verdicts; no rows in, none out. Other columns are neither read
    nor returned. Without both kinds of labels evidence is 0 and only rates, all a half, remain: all is kept.

    Plan: each text is scored once and stays in its task; only sums by path are shuffled (pre-aggregated: a hot host
    costs a row a task). The document classifier sees at most ``fit_rows`` labels.
    """
    model = fit(docs, labels, fit_rows)

    def score(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (0, 1, 2, 3)), pa.array(model.evidence(features(part.column(4))))], ["doc_id", "host", "path", "of", "evidence"])

    text = F.col("text").cast("string")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.xxhash64(text).alias("of"), text.alias("text"))
    scored = stage(given.mapInArrow(score, "doc_id long, host string, path string, of long, evidence double"), "evidence")
    good = 1 / (1 + F.exp(-F.col("evidence")))
    paths = stage(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).alias("good"), F.sum(good * good).alias("square")), "paths")
    hosts = stage(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("square").alias("square")), "hosts")
    mean, weight = rates_prior(hosts)
    of_host = hosts.select(F.col("host").alias("h"), F.col("n").alias("h_n"), F.col("good").alias("h_good"))
    nested = paths.join(bounded(of_host), F.col("host").eqNullSafe(F.col("h"))).select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "good", "square", "h_n", "h_good")
    nested = stage(nested, "nested")
    _, within = rates_prior(nested, F.col("h_good") / F.col("h_n"))
    joined = scored.join(bounded(nested.drop("square")), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    joined = joined.withColumn("host_rate", (F.col("h_good") - good + mean * weight) / (F.col("h_n") - 1 + weight))
    joined = joined.withColumn("path_rate", (F.col("good") - good + F.col("host_rate") * within) / (F.col("n") - 1 + within))
    sure = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("path_rate")))
    odds = F.col("evidence") + F.log(sure / (1 - sure)) - math.log(mean / (1 - mean))
    out = joined.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-odds))).alias("p_quality"), "of")
    return out.withColumn("kept", F.col("p_quality") >= least)


def quality_classifier(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_verdicts`` keeps.

    Rows with one doc_id, text, host and path share a verdict, so that those rejected are found again without a second
    look at the text: an anti join, with a broadcast if the rejected ids are measured to be few.
    """
    found = quality_verdicts(docs, labels, host, path, least, fit_rows)
    gone = stage(found.where("not kept").select(*(F.col(c).alias(f"_gone_{c}") for c in ("doc_id", "of", "host", "path"))).distinct(), "rejected")
    own = [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")), F.col(host).cast("string"), F.col(path).cast("string")]
    match = [a.eqNullSafe(F.col(f"_gone_{c}")) for a, c in zip(own, ("doc_id", "of", "host", "path"), strict=True)]
    return docs.join(bounded(gone), match[0] & match[1] & match[2] & match[3], "left_anti")


__all__ = ["FEATURES", "Logistic", "features", "fit", "quality_classifier", "quality_verdicts", "rates_prior"]
