"""Incremental evaluation: findings are kept by a digest of what they depend on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from corposieve.model import FINDINGS, ordered
from corposieve.operators import findings as ops
from corposieve.operators.directives import directives
from corposieve.plans import engine
from corposieve.plans.config import Config
from corposieve.rules.base import Registry
from corposieve.rules.workspace import records

VERSION = 1


def base_key(registry, config, inputs: dict[str, str] | None = None) -> str:
    """Digest of the version, rules, packs, configuration and declared inputs: a change of any re-evaluates all."""
    rules = {r.id: [r.kind, r.severity, r.params, r.pack] for r in registry.rules.values()}
    doc = [VERSION, rules, registry.packs, config.discovered, {k: vars(v) for k, v in config.rules.items()}, config.allow_suppressions, inputs or {}]
    return hashlib.sha256(json.dumps(doc, sort_keys=True, default=str).encode()).hexdigest()


def with_checksum(files: DataFrame, key: str) -> DataFrame:
    return files.withColumn("checksum", F.sha2(F.concat_ws("\0", F.lit(key), "rel", "contents", F.col("test_only").cast("string"), F.coalesce("package", F.lit(""))), 256))


def incremental(files: DataFrame, cache: str, key: str, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Findings of ``files``; only those not in the cache table are evaluated, and added to it.

    The cache holds a row for each evaluated file (``checksum``, ``found``: its findings), so a file without
    findings is known too. Appending twice after a lost job only repeats equal rows, which are read once.
    """
    spark: SparkSession = files.sparkSession
    marked = with_checksum(files, key)
    schema = "checksum string, rel string, found array<struct<line:int,column:int,rule:string,message:string,fixable:boolean>>"
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.schema(schema).parquet(cache) if exists else spark.createDataFrame([], schema)
    fresh = marked.join(known.select("checksum"), "checksum", "left_anti")
    found = evaluate(fresh.drop("checksum")).groupBy("rel").agg(F.collect_list(F.struct("line", "column", "rule", "message", "fixable")).alias("found"))
    rows = fresh.select("checksum", "rel").join(found, "rel", "left").select("checksum", "rel", F.coalesce("found", F.array().cast("array<struct<line:int,column:int,rule:string,message:string,fixable:boolean>>")).alias("found"))
    rows.write.mode("append").parquet(cache)
    every = spark.read.schema(schema).parquet(cache).dropDuplicates(["checksum"])
    return every.join(marked.select("checksum"), "checksum", "left_semi").select("rel", F.explode("found").alias("f")).select("rel", "f.*")


def digest_of(df: DataFrame, key: str) -> str:
    """A digest of ``key`` and of all rows of ``df`` in any order: their number and two sums of 64-bit hashes."""
    n, d1, d2 = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(7), *df.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{key}:{n}:{d1}:{d2}".encode()).hexdigest()


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written if it isn't there whole. A write that broke off leaves no mark and is made anew."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.schema(FINDINGS).parquet(path)


#: What rules across files read of the records; those not named read all.
READS = {"rust_similar_fns": ["functions"], "rust_param_clump": ["functions", "structs"], "rust_duplicate_strings": ["strings"], "toml_cargo_layers": ["package", "deps"], "toml_cargo_path_deps": ["deps"]}


def check(files: DataFrame, cache: str, registry: Registry, config: Config, only: list[str] | None = None, inputs: dict[str, str] | None = None) -> DataFrame:
    """All findings of a tree in order, by three tiers of cache tables under ``cache``.

    complete: no file has changed, and nothing else that findings depend on: they are read. file: rules of single
    files look at changed files alone. rule: a rule across files is evaluated only if the records that it reads
    have changed, wherever files were edited otherwise. Suppression isn't cached: it is a join with the directives.
    """
    spark = files.sparkSession
    key = base_key(registry, config, inputs) + ":" + ",".join(sorted(only or ["*"]))
    given = files.select("rel", "contents", "test_only", "package")

    def make() -> DataFrame:
        found = incremental(files, f"{cache}/file", key, lambda f: engine.analyze(f, registry, config, only))
        rules = engine.workspace_rules(registry, config, only)
        if not rules:
            return found
        recs = records(files).persist(StorageLevel.DISK_ONLY)
        across = None
        for r in rules:
            seen = engine.scoped(recs, config, r)
            read = seen.select("rel", *READS.get(r.id, [c for c in seen.columns if c != "rel"]))
            one = stored(spark, f"{cache}/rule/{r.id}/{digest_of(read, key)}", lambda r=r, seen=seen: r.check(seen, dict(r.params) | config.rules[r.id].params))
            across = one if across is None else across.unionByName(one)
        recs.unpersist()
        return found.unionByName(ops.suppress(across, directives(files), workspace=True) if config.allow_suppressions else across)

    return ordered(stored(spark, f"{cache}/complete/{digest_of(given, key)}", make))


def stream(files: DataFrame, evaluate: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Evaluate a stream of files batch by batch; a batch's findings replace those of a failed try."""

    def each(batch: DataFrame, epoch: int) -> None:
        evaluate(batch).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
