"""Which Rust files are compiled for tests alone: the module graph and its closure."""

from __future__ import annotations

import posixpath
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposieve.operators import graph
from corposieve.rules.base import attrs, in_test, string_value
from corposieve.syntax.parser import RustFile

_ROOT = re.compile(r"(^|/)(src/(lib|main)|src/bin/[^/]+|src/bin/[^/]+/main|build|examples/[^/]+)\.rs$")
_TEST = re.compile(r"(^|/)(tests|benches)/")


def edges_of(f: RustFile) -> Iterator[tuple[str, list[str], bool]]:
    """(source, candidate targets, whether only tests take the edge) of ``mod x;``, ``#[path]`` and ``include!``."""
    folder, stem = posixpath.dirname(f.rel), posixpath.basename(f.rel).removesuffix(".rs")
    base = folder if stem in ("mod", "lib", "main", "build") or _ROOT.search(f.rel) else posixpath.join(folder, stem)
    for m in f.of("Module"):
        if m.items is None:
            inner = posixpath.join(base, *reversed([u.name for u in m.up("Module")]))
            path = next((a for a in attrs(m) if a.name == "path"), None)
            if path is not None:
                token = next(t.text for t in path.tokens if t.kind == "str")
                targets = [posixpath.normpath(posixpath.join(folder, string_value(token)))]
            else:
                targets = [posixpath.join(inner, m.name + ".rs"), posixpath.join(inner, m.name, "mod.rs")]
            yield f.rel, targets, in_test(m)
    for m in f.of("MacroCall"):
        if m.name == "include" and len(m.body) == 1 and m.body[0].kind == "str":
            yield f.rel, [posixpath.normpath(posixpath.join(folder, string_value(m.body[0].text)))], in_test(m)


def module_edges(files: DataFrame) -> DataFrame:
    """``source, target, requires_test`` between files that exist."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, t, r) for rel, text in zip(batch["rel"], batch["contents"], strict=True) for s, ts, r in edges_of(RustFile(text, rel)) for t in ts]
            yield pd.DataFrame(rows, columns=["source", "target", "requires_test"])

    rust = files.where("ext = 'rs'")
    found = rust.select("rel", "contents").mapInPandas(scan, "source string, target string, requires_test boolean")
    return found.join(rust.select(F.col("rel").alias("target")), "target", "left_semi").select("source", "target", "requires_test")


def test_targets(files: DataFrame) -> DataFrame:
    """``node``: files that a manifest names as a test or benchmark target (``[[test]]``, ``[[bench]]`` with a path)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rel, text in zip(batch["rel"], batch["contents"], strict=True):
                try:
                    doc = tomllib.loads(text)
                except tomllib.TOMLDecodeError:
                    continue
                for kind in ("test", "bench"):
                    for t in doc.get(kind) or []:
                        if isinstance(t, dict) and isinstance(t.get("path"), str):
                            rows.append(posixpath.normpath(posixpath.join(posixpath.dirname(rel), t["path"])))
            yield pd.DataFrame({"node": pd.Series(rows, dtype=object)})

    manifests = files.where(F.col("rel").rlike(r"(^|/)Cargo\.toml$")).select("rel", "contents")
    return manifests.mapInPandas(scan, "node string").distinct()


def classify(files: DataFrame) -> DataFrame:
    """``files`` with ``test_only``: below tests or benches, a manifest's test target, or in the module graph but not reached by production."""
    edges = graph.checkpointed(module_edges(files))  # read by each round
    targets = graph.checkpointed(test_targets(files))
    rust = F.col("rel").rlike(_ROOT.pattern) & ~F.col("rel").rlike(_TEST.pattern)
    roots = files.where(rust).select(F.col("rel").alias("node")).join(targets, "node", "left_anti")
    only = graph.test_only(roots, edges).union(targets).distinct().select(F.col("node").alias("_node"), F.lit(True).alias("_only"))
    named = targets.select(F.col("node").alias("_target"), F.lit(True).alias("_named"))
    out = files.join(only, F.col("rel") == F.col("_node"), "left").join(named, F.col("rel") == F.col("_target"), "left")
    reached = F.coalesce("_only", F.lit(False)) & (~F.col("rel").rlike(_ROOT.pattern) | F.coalesce("_named", F.lit(False)))
    return out.withColumn("test_only", reached | F.col("rel").rlike(_TEST.pattern)).select(*files.columns)
