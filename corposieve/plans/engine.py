"""The main query: files to findings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from corposieve.model import FINDINGS, ordered
from corposieve.operators import findings as ops
from corposieve.operators.directives import directives, directives_of
from corposieve.plans.config import Config
from corposieve.rules.base import Registry, Rule, RustFile
from corposieve.rules.examples import examples
from corposieve.rules.manifests import TomlFile
from corposieve.sources import corpus

#: AST rules whose findings are of a line, not a column.
LINE_ONLY = {"rust_wildcard_imports", "rust_unbalanced_crate_root", "rust_macro_hidden_items"}


#: Line rules that judge a file as a whole.
WHOLE_FILE = {"rust_ffi_crate_naming", "rust_module_docs", "rust_no_prelude", "rust_suppression_directives", "rust_too_many_lines_in_file"}
_REGISTRATION = re.compile(r"(full_)?(line|ast|toml)_rule|\w+_(ast_|toml_)?test")


def hidden_lines(f: RustFile) -> set[int]:
    """Lines of ``EXAMPLES`` constants and of macros that register rules: they quote what rules look for."""
    out: set[int] = set()
    for n in f.of("Const", "MacroCall"):
        if (n.kind == "Const" and n.name == "EXAMPLES") or (n.kind == "MacroCall" and n.parent.kind in ("SourceFile", "Module") and _REGISTRATION.fullmatch(n.name or "")):
            out.update(range(n.line, n.end_line + 1))
    return out


def file_findings(f: RustFile | TomlFile, rules: list[Rule], params: Callable[[Rule], dict]) -> Iterator[tuple]:
    """Raw findings of one file. Rules over trees skip a source that doesn't parse; line rules don't."""
    hidden = hidden_lines(f) if isinstance(f, RustFile) and ("EXAMPLES" in f.text or "_rule!" in f.text or "_test!" in f.text) else set()
    for r in rules:
        if isinstance(f, RustFile):
            if r.kind not in ("rust-ast", "rust-line") or (r.kind == "rust-ast" and f.errors):
                continue
        elif r.kind != "toml":
            continue
        for at, message in r.check(f, params(r)):
            if isinstance(at, int):
                line, column = at, None
            else:
                line = at.line
                column = f.column_at(at.start) if r.kind == "rust-ast" and r.id not in LINE_ONLY else None
            if line in hidden and r.kind == "rust-line" and r.id not in WHOLE_FILE:
                continue
            yield f.rel, line, column, r.id, message, r.fixable


def analyze(files: DataFrame, registry: Registry, config: Config, only: list[str] | None = None, raw: bool = False) -> DataFrame:
    """Findings of rules over single files (model.FINDINGS): a narrow map; each file is parsed once for all rules.

    Suppressed findings of the file's own directives are left out, unless ``raw``; directive errors are findings
    that nothing suppresses. With suppressions disallowed, each directive is a finding and suppresses nothing.
    """
    rules = [r for r in registry.rules.values() if (only is None or r.id in only) and config.rules[r.id].enabled and r.kind in ("rust-ast", "rust-line", "toml")]
    kinds = {"rs": [r for r in rules if r.kind != "toml"], "toml": [r for r in rules if r.kind == "toml"]}
    choosy = {r.id for r in rules if config.rules[r.id].only or config.rules[r.id].ignore}
    known, columns = set(registry.rules), ["rel", "line", "column", "rule", "message", "fixable"]

    corpus.bound_batches(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in corpus.pieces(batches):
            out = []
            for rel, ext, text, package, test_only in zip(*(batch[c] for c in ("rel", "ext", "contents", "package", "test_only")), strict=True):
                mine = [r for r in kinds.get(ext, ()) if r.id not in choosy or config.applies(r.id, rel)]
                if ext == "toml":
                    out += file_findings(TomlFile(text, rel), mine, lambda r, rel=rel, package=package: config.params(r, rel, package))
                elif ext == "rs":
                    f = RustFile(text, rel, package, bool(test_only))
                    found = list(file_findings(f, mine, lambda r, rel=rel, package=package: config.params(r, rel, package)))
                    if not raw:
                        found = _suppressed(f, found, known, config.allow_suppressions)
                    out += found
            pdf = pd.DataFrame(out, columns=columns)
            yield pdf.astype({"column": "Int32", "fixable": bool}) if len(pdf) else pdf

    return files.select("rel", "ext", "contents", "package", "test_only").mapInPandas(run, FINDINGS)


def _suppressed(f: RustFile, found: list[tuple], known: set[str], allowed: bool) -> list[tuple]:
    rows = [d for d in directives_of(f.rel, f.lines, known)]
    if not rows:
        return found
    if not allowed:
        return found + [(f.rel, d["line"], None, "rust_suppression_directives", "suppressions aren't allowed", False) for d in rows if d["scope"] != "unknown"]
    keep = []
    for x in found:
        hit = False
        if x[3] != "rust_suppression_directives":
            for d in rows:
                if d["error"] or not (d["wildcard"] or x[3] in d["rules"]):
                    continue
                if d["scope"] == "file":
                    hit = hit or x[3] not in d["values"]
                else:
                    hit = hit or d["line"] < x[1] <= d["end_line"]
        if not hit:
            keep.append(x)
    return keep + [(f.rel, d["line"], None, "rust_suppression_directives", d["error"], False) for d in rows if d["scope"] == "unknown"]


_held: list[DataFrame] = []


def release() -> None:
    """Drop the records that rules across files have read, once their findings are written."""
    while _held:
        _held.pop().unpersist()


def workspace_rules(registry: Registry, config: Config, only: list[str] | None = None) -> list[Rule]:
    return [r for r in registry.rules.values() if (only is None or r.id in only) and config.rules[r.id].enabled and r.kind in ("rust-workspace", "workspace")]


def scoped(recs: DataFrame, config: Config, rule: Rule) -> DataFrame:
    """The records that a rule across files sees."""
    from corposieve.functions.globs import in_scope

    c = config.rules[rule.id]
    return recs.where(in_scope(F.col("rel"), c.only, c.ignore))


def workspace(files: DataFrame, registry: Registry, config: Config, only: list[str] | None = None) -> DataFrame | None:
    """Findings of rules across files, after suppression; None if no such rule is selected."""
    from corposieve.rules.workspace import records

    rules = workspace_rules(registry, config, only)
    if not rules:
        return None
    recs = records(files).persist(StorageLevel.DISK_ONLY)  # read by each rule; ``release`` drops it
    _held.append(recs)
    out = None
    for r in rules:
        found = r.check(scoped(recs, config, r), dict(r.params) | config.rules[r.id].params)
        out = found if out is None else out.unionByName(found)
    return ops.suppress(out, directives(files), workspace=True) if config.allow_suppressions else out


def check(files: DataFrame, registry: Registry, config: Config, only: list[str] | None = None, baseline: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """All findings, in order. ``targets`` (rel): files whose own findings are wanted; those across files stay."""
    single = analyze(files if targets is None else files.join(targets, "rel", "left_semi"), registry, config, only)
    across = workspace(files, registry, config, only)
    found = single if across is None else single.unionByName(across)
    if baseline is not None:
        found = ops.apply_baseline(found, baseline)
    return ordered(found)


def stale(files: DataFrame, registry: Registry, config: Config) -> DataFrame:
    """Directive targets that nothing needs any more."""
    every = analyze(files, registry, config, raw=True)
    across = workspace(files, registry, Config(config.rules, allow_suppressions=False))
    return ops.stale_directives(directives(files), every if across is None else every.unionByName(across))


def discover(files: DataFrame, config: Config) -> Config:
    """``config`` with what the manifests among ``files`` tell: a package's external crates, and the workspace's own crates.

    A package's external crates are its normal dependencies that no member is named like (a renamed one by its
    package), as import roots. Only manifests are parsed; the driver gets one small row for each.
    """
    from corposieve.rules.workspace import records

    rows = records(files.where("ext = 'toml'")).where("package is not null").select("package", F.filter("deps", lambda d: d["section"] == "normal").alias("deps")).collect()
    members = {r.package for r in rows}
    external = {r.package: {"assume_external": sorted({d.root for d in r.deps if (d.package or d.name) not in members})} for r in rows}
    own = {"members": sorted(m.replace("-", "_") for m in members)}
    return replace(config, discovered={"rust_pub_api_foreign_types": external, "rust_foreign_reexports": {None: own}})


def catalog(registry: Registry) -> list[dict]:
    """The rules' metadata; guidance and examples are those of ``examples.txt`` (of other packs' rules: the description)."""
    known = examples()
    return [{"rule": r.id, "kind": r.kind, "severity": r.severity, "description": r.description, "guidance": known[r.id].guidance if r.id in known else r.description, "default": r.default, "fixable": r.fixable, "params": r.params} for r in registry.rules.values()]
