"""Sources: a source tree or any table as the corpus of files, and its lines."""

from __future__ import annotations

import gc
import os
import re
import subprocess
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corposieve.functions.globs import glob_regex
from corposieve.functions.text import split_lines
from corposieve.model import FILES

IGNORE_FILES = (".gitignore", ".corposieveignore")
#: Characters of sources that a Python worker parses before it hands on what it found.
PIECE = 1 << 20


def from_table(df: DataFrame, key: str, text: str, ext: str = "txt") -> DataFrame:
    """Rows of a table as files: ``rel`` is the key as a string."""
    return df.select(
        F.col(key).cast("string").alias("rel"), F.lit(ext).alias("ext"), F.col(text).alias("contents"),
        F.lit(None).cast("string").alias("package"), F.lit(None).cast("boolean").alias("publishable"), F.lit(False).alias("test_only"),
    )


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """``rel, line, text``, numbered from 1."""
    exploded = files.select("rel", *keep, F.posexplode(split_lines(F.col("contents"))).alias("_at", "text"))
    return exploded.select("rel", (F.col("_at") + 1).alias("line"), "text", *keep)


class IgnoreRules:
    """Patterns of ignore files, the last match of the deepest file deciding."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, re.Pattern[str], bool, bool]] = []

    def read(self, folder: Path, rel: str) -> IgnoreRules:
        out = IgnoreRules()
        out.rules = list(self.rules)
        for name in IGNORE_FILES:
            if (folder / name).is_file():
                for row in (folder / name).read_text(errors="replace").splitlines():
                    row = row.rstrip()
                    if not row or row.startswith("#"):
                        continue
                    keep, row = row.startswith("!"), row.removeprefix("!")
                    dirs, row = row.endswith("/"), row.rstrip("/")
                    anchored = "/" in row
                    regex = glob_regex(row.lstrip("/") if anchored else "**/" + row)
                    if regex:
                        out.rules.append((rel, re.compile(regex), dirs, keep))
        return out

    def ignored(self, rel: str, is_dir: bool) -> bool:
        for base, regex, dirs, keep in reversed(self.rules):
            inner = rel[len(base) + 1 :] if base else rel
            if (not base or rel.startswith(base + "/")) and (is_dir or not dirs) and regex.match(inner):
                return not keep
        return False


def walk(root: str, extensions: Iterable[str] = (), foreign: str | None = "Cargo.toml") -> list[str]:
    """Sorted relative paths below ``root``: hidden and ignored entries are pruned, as is a ``target`` folder and a
    nested folder whose ``foreign`` file declares a workspace of its own. No extension: every file."""
    wanted = {e.lstrip(".") for e in extensions}

    def below(folder: Path, rel: str, rules: IgnoreRules) -> Iterator[str]:
        rules = rules.read(folder, rel)
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            path = f"{rel}/{entry.name}" if rel else entry.name
            is_dir = entry.is_dir(follow_symlinks=False)
            if entry.name.startswith(".") or rules.ignored(path, is_dir):
                continue
            if is_dir:
                nested = folder / entry.name / (foreign or "")
                if not (rel == "" and entry.name == "target") and not (foreign and nested.is_file() and re.search(r"(?m)^\s*\[workspace\]", nested.read_text(errors="replace"))):
                    yield from below(Path(entry.path), path, rules)
            elif entry.is_file() and (not wanted or entry.name.rpartition(".")[2] in wanted):
                yield path

    return sorted(below(Path(root), "", IgnoreRules()))


def git_dirty(root: str, extensions: Iterable[str] = ()) -> list[str]:
    """Files that the working tree's status names (renames by their new name), sorted."""
    wanted = {e.lstrip(".") for e in extensions}
    out = subprocess.run(["git", "-C", root, "status", "--porcelain", "-z", "--untracked-files=all"], capture_output=True, check=True).stdout.decode()
    found, parts = set(), out.split("\0")
    while parts:
        entry = parts.pop(0)
        if len(entry) > 3:
            if entry[0] in "RC":
                parts.pop(0)
            found.add(entry[3:])
    return sorted(p for p in found if (not wanted or p.rpartition(".")[2] in wanted) and (Path(root) / p).is_file())


def source_tree(spark: SparkSession, root: str, extensions: Iterable[str] = ("rs", "toml"), paths: list[str] | None = None) -> DataFrame:
    """Files of a tree that the driver lists and executors read, batch by batch; so the tree must lie where all reach it
    (for files elsewhere, ``from_table`` over ``spark.read``). A text that isn't UTF-8 fails the job."""
    base = os.path.abspath(root)
    listed = walk(root, extensions) if paths is None else paths
    if not listed:
        return spark.createDataFrame([], FILES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel in batch.column(0).to_pylist():  # a file at a time is in memory
                yield pa.RecordBatch.from_arrays([pa.array([rel]), pa.array([(Path(base) / rel).read_bytes().decode("utf-8")])], ["rel", "contents"])

    rows = spark.createDataFrame([(p,) for p in listed], "rel string").repartition(max(1, min(len(listed) // 64, 512)))
    rows = rows.mapInArrow(read, "rel string, contents string")
    return rows.select("rel", F.regexp_extract("rel", r"\.([^./]+)$", 1).alias("ext"), "contents", F.lit(None).cast("string").alias("package"), F.lit(None).cast("boolean").alias("publishable"), F.lit(False).alias("test_only"))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df``; if it has fewer partitions than there are cores (a small table in one file), dealt out by ``by``.

    Counted in the plan, without a job. A large table has more splits than that and isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, *by) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches for Python hold 16 MB at most, unless the session says otherwise: long texts then need no more memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(16 << 20))


def pieces(batches: Iterator[pd.DataFrame], text: str = "contents") -> Iterator[pd.DataFrame]:
    """Batches of rows cut where about ``PIECE`` characters of ``text`` are full.

    What is made of a piece is thrown away before the next: trees of sources point back at themselves, so the collector must be called.
    """
    for batch in batches:
        full = batch[text].map(lambda t: len(t) if t else 0).cumsum() // PIECE
        for _, piece in batch.groupby(full, sort=False):
            yield piece
            gc.collect()


def with_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Give each file the package whose root is its longest path prefix; ``packages``: name, root, publishable.

    Prefixes of a path are few: they are exploded and joined on equality, so no theta join compares all with all.
    """
    parts = F.split("rel", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    own = packages.select(F.col("root").alias("_root"), F.col("name").alias("_name"), F.col("publishable").alias("_pub"))
    best = (
        files.select("rel", F.explode(prefixes).alias("_root")).join(own, "_root")
        .groupBy("rel").agg(F.max_by(F.struct("_name", "_pub"), F.length("_root")).alias("_p"))
    )
    out = files.join(best, "rel", "left")
    return out.withColumns({"package": F.col("_p._name"), "publishable": F.col("_p._pub")}).drop("_p")


def longest_prefix(df: DataFrame, path: str, owners: DataFrame, root: str, separator: str = "/") -> DataFrame:
    """``df`` with the longest ``root`` of ``owners`` that is a component-wise prefix of ``path`` (null if none)."""
    parts = F.split(path, re.escape(separator))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    keyed = df.withColumn("_id", F.struct(*df.columns))
    best = keyed.select(F.explode(prefixes).alias(root), F.col(path).alias("_path")).distinct().join(owners.select(root).distinct(), root).groupBy("_path").agg(F.max_by(root, F.length(root)).alias(root))
    return df.join(best, F.col(path) == F.col("_path"), "left").drop("_path")
