"""Command line: check, fix, clean and describe a source tree."""

from __future__ import annotations

import argparse
import fcntl
import json
import os
import subprocess
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from corposieve.operators import edits, findings
from corposieve.plans import config as conf
from corposieve.plans import engine
from corposieve.rules.base import Registry
from corposieve.rules.catalog import builtin
from corposieve.rules.examples import examples
from corposieve.sources import corpus, modules

CONFIG = "corposieve.toml"


def write_atomically(path: Path, text: str) -> None:
    """Replace a file by way of a synced temporary one beside it."""
    fd, temp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        if path.exists():
            os.chmod(temp, path.stat().st_mode)
        os.replace(temp, path)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise
    folder = os.open(path.parent, os.O_RDONLY)
    os.fsync(folder)
    os.close(folder)


class Lock:
    """An advisory lock on a tree; a second run fails at once."""

    def __init__(self, root: Path) -> None:
        self.file = (root / ".corposieve.lock").open("w")

    def __enter__(self) -> Lock:
        try:
            fcntl.flock(self.file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise SystemExit("another run holds the lock of this tree") from e
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def packages(root: Path) -> list[tuple[str, str, bool]]:
    """(name, root, publishable) of all packages, from ``cargo metadata`` or, without cargo, from manifests."""
    try:
        out = subprocess.run(["cargo", "metadata", "--no-deps", "--format-version", "1"], cwd=root, capture_output=True, check=True).stdout
        found = [(p["name"], os.path.relpath(os.path.dirname(p["manifest_path"]), root), p.get("publish") != []) for p in json.loads(out)["packages"]]
        return [(n, "" if r == "." else r, p) for n, r, p in found]
    except (OSError, subprocess.CalledProcessError):
        import tomllib

        out_ = []
        for rel in corpus.walk(str(root), ["toml"]):
            if rel.rpartition("/")[2] == "Cargo.toml":
                doc = tomllib.loads((root / rel).read_text())
                if "package" in doc:
                    out_.append((doc["package"]["name"], rel.rpartition("/")[0], doc["package"].get("publish") is not False))
        return out_


def select_packages(known: list[tuple[str, str, bool]], wanted: list[str]) -> list[str]:
    """Roots of packages named by name or by relative root."""
    roots = []
    for w in wanted:
        if os.path.isabs(w):
            raise SystemExit(f"{w}: a package is given by its name or its relative folder")
        hit = [r for n, r, _ in known if n == w or r == w.rstrip("/")]
        if len(hit) != 1:
            raise SystemExit(f"{w}: {'no' if not hit else 'more than one'} such package")
        roots += hit
    return roots


#: Findings that the human report shows at most; all are counted, and ``--json`` has all.
SHOWN = 100_000


def _report(found: DataFrame, registry: Registry, as_json: bool, quiet: bool, known: list[tuple[str, str, bool]]) -> int:
    """Findings by package and file, then counts by rule; or JSON. Rows come to the driver a partition at a time."""
    rules = found.sparkSession.createDataFrame([(r["rule"], r["severity"], r["description"], r["guidance"]) for r in engine.catalog(registry)], "rule string, severity string, description string, guidance string")
    found = found.persist(StorageLevel.DISK_ONLY)
    rows = findings.report_rows(found, rules)
    n = found.count()
    if as_json:
        print('{\n  "schema_version": 2,\n  "findings": [', end="")
        for k, r in enumerate(rows.toLocalIterator()):
            print(",\n" if k else "\n", json.dumps(r.asDict()), sep="    ", end="")
        print("\n  ]\n}")
    elif not quiet:
        roots = sorted(((root, name) for name, root, _ in known), key=lambda x: -len(x[0]))
        last = None
        for r in rows.limit(SHOWN).toLocalIterator():
            package = next((name for root, name in roots if not root or r.path.startswith(f"{root}/")), "")
            if package != last and known:
                print(f"{package or '(no package)'}:")
                last = package
            print(f"{r.path}:{r.line}: {r.severity}: {r.message} [{r.rule}]")
        if n > SHOWN:
            print(f"... and {n - SHOWN} more")
        for r in findings.summary(found).collect():  # a row a rule
            print(f"{r['count']:6d}  {r.rule}{f'  ({r.fixable} fixable)' if r.fixable else ''}  in {r.files} files")
    found.unpersist()
    engine.release()
    return 1 if n else 0


def shortened(text: str) -> str:
    """An example without the repetition that some need."""
    lines = text.rstrip("\n").split("\n")
    return "\n".join(x for i, x in enumerate(lines) if i < 2 or x != lines[i - 1] or x != lines[i - 2])


def detail(registry: Registry, rule: str) -> dict | None:
    """A rule's metadata with its examples."""
    e = examples().get(rule)
    return next((r | ({"examples": {"fails": shortened(e.fails), "passes": shortened(e.passes), "path": e.path}} if e and e.fails else {}) for r in engine.catalog(registry) if r["rule"] == rule), None)


def markdown(registry: Registry) -> str:
    """The catalog as Markdown, with guidance and examples."""
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    out = ["# Rules", "", "| rule | kind | severity | default | fix | description |", "| --- | --- | --- | --- | --- | --- |"]
    for r in engine.catalog(registry):
        out.append("| " + " | ".join(map(cell, (f"`{r['rule']}`", r["kind"], r["severity"], "on" if r["default"] else "off", "yes" if r["fixable"] else "", r["description"]))) + " |")
    params = [(r["rule"], k, v) for r in engine.catalog(registry) for k, v in r["params"].items()]
    details: list[str] = []
    for r in engine.catalog(registry):
        e = examples().get(r["rule"])
        if e:
            more = [x for title, text in (("Found fault with", e.fails), ("Passes", e.passes)) if text for x in ("", f"{title}:", "", "```" + ("toml" if e.path.endswith("toml") else "rust"), shortened(text), "```")]
            details += ["", f"## `{r['rule']}`", "", f"{r['description']} {r['guidance']}", *more]
    return "\n".join([*out, "", "| rule | parameter | default |", "| --- | --- | --- |", *(f"| `{a}` | `{b}` | `{cell(" ".join(c) if isinstance(c, list) else json.dumps(c))}` |" for a, b, c in params), *details, ""])


def main(argv: list[str] | None = None, registry: Registry | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="corposieve")
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("--rule", action="append")
    p.add_argument("--package", "-F", action="append", default=[])
    p.add_argument("--config", help="instead of corposieve.toml in the tree")
    p.add_argument("--strict", action="store_true", help="a configuration that is missing or leaves rules out is an error")
    p.add_argument("--quiet", "-q", action="store_true", help="print errors and JSON alone")
    p.add_argument("--baseline-forbid", default="", help="rules, by commas, that a baseline may not hold")
    p.add_argument("--ci", action="store_true", help="run the rules, cargo fmt and cargo clippy as one gate")
    p.add_argument("--dirty", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--baseline")
    p.add_argument("--write-baseline")
    p.add_argument("--fix", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--clean", action="store_true")
    p.add_argument("--suppressions", action="store_true")
    p.add_argument("--list", action="store_true")
    p.add_argument("--detail")
    p.add_argument("--llm", action="store_true", help="the catalog as Markdown")
    p.add_argument("--parse-config", action="store_true")
    p.add_argument("--init", action="store_true")
    a = p.parse_args(argv)
    registry = registry or builtin()
    root = Path(a.root).resolve()
    if a.dry_run and not (a.fix or a.clean):
        p.error("--dry-run goes with --fix or --clean")
    if a.baseline and a.write_baseline:
        p.error("--baseline and --write-baseline exclude each other")
    unknown = set(a.rule or []) - set(registry.rules)
    if unknown:
        p.error(f"unknown rules: {', '.join(sorted(unknown))}")
    if a.list:
        for r in engine.catalog(registry):
            print(f"{r['rule']}  {r['kind']}  {r['severity']}  {'on' if r['default'] else 'off'}{'  fixable' if r['fixable'] else ''}")
        return 0
    if a.detail:
        print(json.dumps(detail(registry, a.detail), indent=2))
        return 0 if a.detail in registry.rules else 2
    if a.llm:
        print(markdown(registry))
        return 0
    if a.init:
        with (root / CONFIG).open("x") as out:
            out.write(conf.render_default(registry))
        return 0
    path = Path(a.config) if a.config else root / CONFIG
    if a.strict and not path.exists():
        p.error(f"{path} is missing")
    try:
        config = conf.load(path.read_text(), registry, a.strict) if a.config or path.exists() else conf.default(registry)
    except (conf.ConfigError, OSError) as e:
        p.error(f"{path}: {e}")
    for w in [] if a.quiet else config.warnings:
        print(f"warning: {w}", file=sys.stderr)
    forbidden = {*config.forbid_baseline, *filter(None, a.baseline_forbid.split(","))}
    if a.parse_config:
        print(json.dumps({k: vars(v) for k, v in config.rules.items()}, indent=2))
        return 0
    spark = spark or SparkSession.builder.appName("corposieve").getOrCreate()
    known = packages(root)
    files = corpus.source_tree(spark, str(root))
    if known:
        files = corpus.with_package(files, spark.createDataFrame(known, "name string, root string, publishable boolean"))
    files = modules.classify(files)
    for r in [select_packages(known, a.package)] if a.package else []:
        from functools import reduce

        files = files.where(reduce(lambda x, y: x | y, (files.rel.startswith(f"{x}/") if x else files.rel.isNotNull() for x in r)))
    if a.suppressions:
        from pyspark.sql import functions as F

        from corposieve.operators.directives import directives

        d = directives(files).where("error is null").select("rel", F.explode(F.when(F.col("wildcard"), F.array(F.lit("*"))).otherwise(F.col("rules"))).alias("rule"))
        for r in d.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("rel").alias("files")).orderBy(F.desc("n"), "rule").collect():
            print(f"{r.n:6d}  {r.rule}  in {r.files} files")
        return 0
    if a.fix:
        rules = [r for r in registry.rules.values() if r.fixable and config.rules[r.id].enabled and (not a.rule or r.id in a.rule)]
        fixed = edits.fix(files, rules, lambda r: config.params(r, "")).orderBy("rel")
        if a.dry_run:
            n = 0
            for r in fixed.toLocalIterator():
                n += 1
                print(edits.preview(r.rel, r.before, r.after), end="")
            return 1 if n else 0
        with Lock(root):
            for r in fixed.persist(StorageLevel.DISK_ONLY).toLocalIterator():
                if (root / r.rel).read_bytes().decode() != r.before:
                    raise SystemExit(f"{r.rel} was changed meanwhile; nothing more is written")
                write_atomically(root / r.rel, r.after)
        files = corpus.source_tree(spark, str(root))
    if a.clean:
        stale = engine.stale(files, registry, config).orderBy("rel", "line").collect()
        for r in stale:
            print(f"{r.rel}:{r.line}: {r.scope} directive of {r.rule} is stale")
        if not a.dry_run:
            with Lock(root):
                clean(root, stale)
        return 1 if stale and a.dry_run else 0
    targets = spark.createDataFrame([(x,) for x in corpus.git_dirty(str(root), ["rs", "toml"])], "rel string") if a.dirty else None
    base = None
    if a.baseline:
        doc = json.loads(Path(a.baseline).read_text())
        if doc.get("schema_version") != 1:
            raise SystemExit("a baseline of another version")
        rows = [(f["rule"], f["path"], f["message"], int(f["count"])) for f in doc["findings"]]
        if bad := {r[0] for r in rows} & forbidden:
            raise SystemExit(f"rules that may not be in a baseline: {', '.join(sorted(bad))}")
        base = spark.createDataFrame(rows, "rule string, path string, message string, count bigint")
    config = engine.discover(files, config)
    found = engine.check(files, registry, config, a.rule, base, targets)
    if a.write_baseline:
        rows = [r.asDict() for r in findings.write_baseline(found).orderBy("rule", "path", "message").collect()]
        write_atomically(Path(a.write_baseline).resolve(), json.dumps({"schema_version": 1, "findings": rows}, indent=2) + "\n")
        return 0
    code = _report(found, registry, a.json, a.quiet, known)
    return max(code, gate(root, a.quiet)) if a.ci else code


def gate(root: Path, quiet: bool) -> int:
    """The formatter and the linter of cargo: 0 if both are content, 2 if cargo is missing."""
    code = 0
    for what in (["fmt", "--all", "--check"], ["clippy", "--workspace", "--all-targets", "--quiet", "--", "-D", "warnings"]):
        try:
            done = subprocess.run(["cargo", *what], cwd=root, stdout=subprocess.DEVNULL if quiet else None, check=False)
        except OSError:
            print("cargo isn't there", file=sys.stderr)
            return 2
        code = max(code, int(done.returncode != 0))
    return code


def clean(root: Path, stale: list) -> None:
    """Take stale targets out of directives; a directive without targets goes."""
    by: dict[str, dict[int, set[str]]] = {}
    for r in stale:
        by.setdefault(r.rel, {}).setdefault(r.line, set()).add(r.rule)
    for rel, rows in by.items():
        text = (root / rel).read_bytes().decode()
        lines = text.split("\n")
        for line, rules in sorted(rows.items(), reverse=True):
            old = lines[line - 1]
            head, _, tail = old.partition("(")
            inside, _, rest = tail.partition(")")
            scope, colon, names = inside.rpartition(":")
            left = [x.strip() for x in names.split(",") if x.strip() and x.strip().partition("=")[0].strip() not in rules]
            if left:
                lines[line - 1] = f"{head}({scope}{colon}{' ' if colon else ''}{', '.join(left)}){rest}"
            else:
                del lines[line - 1]
        write_atomically(root / rel, "\n".join(lines))


if __name__ == "__main__":
    sys.exit(main())
