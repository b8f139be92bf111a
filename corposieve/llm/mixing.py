"""Mixing sources to target weights by Poisson replication; DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corposieve.llm._common import bounded, stage

#: Poisson rates above this are drawn as a sum of this many at a time, as exp(-rate) would vanish.
PIECE = 400.0


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 hash, the same in any engine."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... to where it differs from 1 by less than the uniform number's resolution."""
    most = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(0), most),
        F.struct(F.exp(-rate).alias("p"), F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("all")),
        lambda s, k: F.struct((s["p"] * rate / (k + 1)).alias("p"), (s["c"] + s["p"]).alias("c"), F.concat(s["all"], F.array(s["c"] + s["p"])).alias("all")),
        lambda s: s["all"],
    )
    return step


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix", epochs: float = 1.0, source: str = "source") -> DataFrame:
    """Repeat each row a Poisson number of times so that sources come to their target weights; shuffle all.

    ``weights``: target share of rows by source (normalised; sources not named get none). By default a source of n
    rows weighs n ** 0.5. A row's mean count is ``epochs * rows * weight / rows of its source``; its count is the
    inverse of that Poisson distribution at a number hashed from ``seed`` and doc_id. Returns the columns of
    ``docs`` with ``copy`` (from 1; such a column of docs is replaced), shuffled globally by
    a hash of seed, doc_id and copy (of rows without a doc_id, of all columns).

    Rows that share a doc_id (or have none) share a count. A null source is a source of its own, not named by
    ``weights``. Text isn't looked at. No rows in, none out.

    Plan: sources are counted with map-side aggregation (a hot one costs a row a task); the table of rates has a
    row a source and is broadcast if it is measured to be small. The one shuffle of texts is the global one: rows go to
    the partition of their hash and are sorted there by it, so that no sample of them is drawn first.
    """
    keep = [c for c in docs.columns if c != "copy"]
    key = F.col(source).cast("string")
    n = docs.groupBy(key.alias("_mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.sqrt("n"))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_mix_source string, w double")
        n = n.join(F.broadcast(given), "_mix_source", "left").fillna(0.0, ["w"])  # as many rows as the caller's dictionary
    n = stage(n, "sources")
    rows, total = n.agg(F.sum("n"), F.sum("w")).first()
    rate = F.lit(float(epochs * (rows or 0))) * F.col("w") / F.lit(float(total or 1)) / F.col("n")
    pieces = F.greatest(F.lit(1), F.ceil(rate / PIECE)).cast("int")
    rates = stage(n.select("_mix_source", pieces.alias("pieces"), poisson_cdf(rate / pieces).alias("cdf")).select("_mix_source", F.struct("pieces", "cdf").alias("_mix")), "rates")
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("_mix.pieces")), F.lit(0), lambda acc, k: acc + F.size(F.filter("_mix.cdf", lambda c: c <= uniform(seed, F.col("doc_id"), k)))
    )
    single = F.size(F.filter("_mix.cdf", lambda c: c <= F.col("_mix_u")))
    joined = docs.select(*keep).join(bounded(rates), key.eqNullSafe(F.col("_mix_source"))).withColumn("_mix_u", uniform(seed, F.col("doc_id"), F.lit(1)))
    times = F.when(F.col("_mix.pieces") == 1, single).otherwise(count)
    copies = joined.withColumn("_mix_times", times).where("_mix_times > 0").select(*keep, F.explode(F.sequence(F.lit(1), F.col("_mix_times"))).alias("copy"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.xxhash64(*keep).cast("string")))  # rows without an id aren't all of one place
    order = F.md5(F.concat_ws(":", F.lit(seed + "-order"), own, F.col("copy").cast("string")).cast("binary"))
    return copies.repartition(order).sortWithinPartitions(order)
