"""Quality rules with host verdicts: rule failures by domain, rates shrunk by an empirical beta prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposieve.llm._common import bounded, stage
from corposieve.llm._text import U, bytes_of, mix, slices, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: rule -> its failure, as SQL over COUNTS; a document that fails one of these goes.
RULES = {"few_words": "n_words < 20", "repeats": "100 * n_repeat_words > 30 * n_words"}
#: Further failures that count against a host alone: a document may have them and stay.
HOST_RULES = {"symbols": "10 * n_symbols > n_words", "dup_lines": "n_dup_lines >= 3", "word_length": "word_chars < 3 * n_words or word_chars > 12 * n_words"}


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text's bytes; few are, so their places are searched."""
    low = int(offsets[0])
    return np.diff(np.searchsorted(np.flatnonzero(flags[low : int(offsets[-1])]), offsets - low)).astype(np.int64)


def repeated_words(hashes: np.ndarray, first: np.ndarray, size: int = 8) -> np.ndarray:
    """Per text, its words in ``size``-word windows that the text holds twice or more."""
    out = np.zeros(len(first) - 1, np.int64)
    rolled = np.zeros(max(0, len(hashes) - size + 1), U)
    for k in range(size):
        rolled = mix(rolled + hashes[k : k + len(rolled)] + U(k + 1))
    # texts that may repeat a window: one sort of 24 bits of the text's number and 40 of the window's hash
    text = np.repeat(np.arange(len(first) - 1, dtype=U), np.diff(first))
    inside = np.flatnonzero(text[: len(rolled)] == text[size - 1 :]) if len(rolled) else np.zeros(0, np.int64)
    keys = np.sort((text[inside] << U(40)) | (rolled[inside] >> U(24)))
    for i in np.unique(keys[1:][keys[1:] == keys[:-1]] >> U(40)).tolist():
        x = rolled[first[i] : first[i + 1] - size + 1]
        y = np.sort(x)
        twice = y[1:][y[1:] == y[:-1]]
        if len(twice):
            hit = np.isin(x, twice)
            edge = np.zeros(len(x) + size, np.int64)
            edge[:-size] += hit
            edge[size:] -= hit
            out[i] = (np.cumsum(edge) > 0).sum()
    return out


def counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    w = words(column, fold=False)
    lead = (w.data & 0xC0) != 0x80
    low = int(w.offsets[0])
    chars = np.concatenate(([0], np.cumsum(lead[low : int(w.offsets[-1])], dtype=np.int64)))
    in_words = np.concatenate(([0], np.cumsum(chars[w.ends - low] - chars[w.starts - low])))
    dup = np.zeros(len(w.count), np.int64)
    for i, text in enumerate(column.to_pylist()):
        if text and "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": w.count.astype(np.int64), "word_chars": in_words[w.first[1:]] - in_words[w.first[:-1]],
        "n_symbols": per_text(SYMBOL[w.data], w.offsets), "n_dup_lines": dup, "n_repeat_words": repeated_words(w.hashes, w.first),
    }


def beta_prior(hosts: DataFrame, failed: str) -> tuple[float, float]:
    """Mean and concentration of the beta distribution of hosts' rates, by moments; ``hosts``: a row a host."""
    rate = F.col(failed) / F.col("n")
    total, fails, k = hosts.agg(F.sum("n"), F.sum(failed), F.count("*")).first()
    if not total or not 0 < fails < total:
        return (fails or 0) / (total or 1), 1e6
    mean = fails / total
    spread = hosts.agg(F.sum(F.col("n") * (rate - F.lit(mean)) ** 2) / F.lit(float(total))).first()[0]
    between = spread - mean * (1 - mean) * k / total  # less what chance alone would give
    return mean, min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6


def quality_rules(docs: DataFrame, host: str = "source", most: float = 0.5) -> DataFrame:
    """Judge documents by rules, and hosts by the share of their documents that fail.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept``,
    one row per input row. A host is rejected if its rate for any of RULES and HOST_RULES, shrunk towards all hosts'
    mean by a beta prior fitted by moments, exceeds ``most``; kept is false for a base failure and for each document
    of such a host. host_rate is the largest of the shrunk rates.

    Null or empty text: no words, so it fails. A null host is a host of its own. Repeated rows count each. No
    rows in, none out. Other columns are neither read nor returned.

    Plan: texts never leave their task; hosts' counts are pre-aggregated on the map side, so that a hot host costs
    a row a task, and are joined back to narrow rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = counts_of(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(found[c]) for c in COUNTS)], ["doc_id", "host", *COUNTS])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    rows = stage(docs.mapInArrow(count, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS)), "rules")
    hosts = stage(rows.groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(F.expr(x)).alias(k) for k, x in (RULES | HOST_RULES).items())), "hosts")
    rates = []
    for rule in RULES | HOST_RULES:
        mean, weight = beta_prior(hosts, rule)
        rates.append((F.col(rule) + mean * weight) / (F.col("n") + weight))
    verdicts = hosts.select(F.col("host").alias("of_host"), F.greatest(*rates).alias("host_rate"))
    failed = F.expr(" or ".join(f"({x})" for x in RULES.values()))
    return (
        rows.join(bounded(verdicts), F.col("host").eqNullSafe(F.col("of_host")), "left")
        .select("doc_id", *COUNTS, failed.alias("base_failed"), "host_rate", (~failed & (F.col("host_rate") <= most)).alias("kept"))
    )


__all__ = ["COUNTS", "RULES", "beta_prior", "bytes_of", "counts_of", "per_text", "quality_rules", "repeated_words"]
