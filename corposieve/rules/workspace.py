"""Rules across files, as joins and aggregations over extracted records."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corposieve.functions.globs import matches_any
from corposieve.operators import graph
from corposieve.rules.base import RustFile, in_test, owner, rule
from corposieve.rules.manifests import TomlFile, dependencies, leaves_root
from corposieve.sources import corpus

RECORDS = (
    "rel string, functions array<struct<name:string,line:int,tokens:int,digest:string,shingles:array<bigint>,params:array<struct<name:string,type:string>>,calls:array<array<string>>>>, "
    "strings array<struct<value:string,line:int>>, structs array<struct<name:string,line:int,arity:int,fields:array<struct<name:string,type:string>>>>, roots array<string>, package string, "
    "deps array<struct<section:string,name:string,root:string,line:int,source:string,path:string,package:string,version:string>>"
)
SHINGLE = 5


def _hash(parts: list[str]) -> int:
    data = b"".join(str(len(x)).encode() + b":" + x.encode() for x in parts)
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "big", signed=True)


def rust_records(f: RustFile) -> dict:
    """What cross-file rules read of a source; generated files keep their crate roots alone."""
    roots = sorted({n.path.names[0] for n in f.of("PathExpr", "PathType") if n.path.names} | {n.names[0] for n in f.of("Path") if n.names} | {t.path[0] for t in f.of("UseTree") if t.path and t.parent.kind == "Use"} | {m.names[0] for m in f.of("MacroCall")} | {x.name.split("::")[0] for x in f.of("Attr") if x.name})
    out = {"functions": [], "strings": [], "structs": [], "roots": roots}
    if any("@generated" in x for x in f.lines[:8]):
        return out
    for n in f.of("Fn"):
        if n.body is None or in_test(n):
            continue
        body = [t.text for t in n.body.tokens if t.kind != "doc"]
        calls = [[a.compact for a in c.args] for c in n.body.all("CallExpr", "MethodCallExpr") if c.args]
        out["functions"].append({
            "name": n.name, "line": n.line, "tokens": len(body), "digest": hashlib.sha256("\0".join(body).encode()).hexdigest(), "shingles": sorted({_hash(body[i : i + SHINGLE]) for i in range(len(body) - SHINGLE + 1)}),
            "params": [] if owner(n) is not None and owner(n).kind == "Impl" and owner(n).trait is not None else [{"name": q.name, "type": q.type.compact} for q in n.params if q.type is not None], "calls": calls,
        })
    for n in f.of("Literal"):
        if n.lit == "str" and not in_test(n) and n.nearest("Attr") is None:
            out["strings"].append({"value": n.value, "line": n.line})
    for m in f.of("MacroCall"):
        if not in_test(m) and not m.name.startswith("assert"):
            out["strings"] += [{"value": t.text, "line": f.line_at(t.start)} for t in m.body if t.kind == "str"]
    for s in f.of("Struct"):
        out["structs"].append({"name": s.name, "line": s.line, "arity": len(s.generics), "fields": [{"name": x.name, "type": x.type.compact} for x in s.fields]})
    return out


def records(files: DataFrame) -> DataFrame:
    """Nested records of Rust sources and Cargo manifests, one row a file that parses; each file is parsed once, and a piece of a batch is in memory."""
    corpus.bound_batches(files.sparkSession)
    columns = ["rel", "functions", "strings", "structs", "roots", "package", "deps"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in corpus.pieces(batches):
            rows = []
            for rel, ext, text in zip(batch["rel"], batch["ext"], batch["contents"], strict=True):
                if ext == "rs":
                    f = RustFile(text, rel)
                    if not f.errors:
                        r = rust_records(f)
                        rows.append([rel, r["functions"], r["strings"], r["structs"], r["roots"], None, []])
                elif rel.rpartition("/")[2] == "Cargo.toml":
                    t = TomlFile(text, rel)
                    if not t.error:
                        keys = ("section", "name", "root", "line", "source", "path", "package", "version")
                        deps = [{k: d[k] for k in keys} for d in dependencies(t)]
                        rows.append([rel, [], [], [], [], (t.doc.get("package") or {}).get("name"), deps])
            yield pd.DataFrame(rows, columns=columns)

    return files.select("rel", "ext", "contents").mapInPandas(scan, RECORDS)


def _finding(df: DataFrame, rule_id: str, rel, line, message) -> DataFrame:
    return df.select(rel.alias("rel"), line.cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.lit(rule_id).alias("rule"), message.alias("message"), F.lit(False).alias("fixable"))


@rule("rust_similar_fns", "rust-workspace", "low", "Alike functions are one.", min_tokens=40, jaccard_percent=85, uncompared=[])
def similar_fns(recs: DataFrame, p: dict) -> DataFrame:
    fns = recs.select("rel", F.explode("functions").alias("f")).where(F.col("f.tokens") >= p["min_tokens"])
    items = fns.select(F.struct("rel", F.col("f.line").alias("line"), F.col("f.name").alias("name")).alias("key"), F.col("f.shingles").alias("shingles"), F.col("f.digest").alias("digest"))
    pairs = graph.similar_pairs(items, p["jaccard_percent"])
    for pair in p["uncompared"]:
        a, _, b = pair.partition("|")
        l, r = F.col("left_key.rel"), F.col("right_key.rel")
        pairs = pairs.where(~((matches_any(l, [a.strip()]) & matches_any(r, [b.strip()])) | (matches_any(l, [b.strip()]) & matches_any(r, [a.strip()]))))
    message = F.concat(F.lit("`"), F.col("right_key.name"), F.when(F.col("kind") == "exact", "` is a copy of `").otherwise("` is much like `"), F.col("left_key.name"), F.lit("` in "), F.col("left_key.rel"))
    return _finding(pairs, "rust_similar_fns", F.col("right_key.rel"), F.col("right_key.line"), message)


@rule("rust_param_clump", "rust-workspace", "low", "Parameters that come together are a type.", min_clump=3, min_fns=3)
def param_clump(recs: DataFrame, p: dict) -> DataFrame:
    fns = recs.select("rel", F.explode("functions").alias("f"))
    item = F.struct("rel", F.col("f.line").alias("line"), F.col("f.name").alias("name"))
    flat = fns.select(item.alias("item"), F.explode("f.params").alias("q")).select("item", F.concat("q.name", F.lit(": "), "q.type").alias("param")).distinct()
    clumps = graph.parameter_clumps(flat, "item", "param", p["min_clump"], p["min_fns"])
    message = F.concat(F.array_join("params", ", "), F.lit(" come together in "), F.col("n_items").cast("string"), F.lit(" functions"))
    return _finding(clumps, "rust_param_clump", F.col("anchor.rel"), F.col("anchor.line"), message)


@rule("rust_duplicate_strings", "rust-workspace", "low", "A long text is written once.", min_chars=40, min_occurrences=3)
def duplicate_strings(recs: DataFrame, p: dict) -> DataFrame:
    flat = recs.select("rel", F.posexplode("strings").alias("at", "s")).select("rel", "at", F.col("s.line").alias("line"), F.col("s.value").alias("value"))
    found = graph.duplicate_values(flat, "value", ["rel", "line", "at"], p["min_chars"], p["min_occurrences"])
    return _finding(found, "rust_duplicate_strings", F.col("rel"), F.col("line"), F.concat(F.lit("a text that is written "), F.col("occurrences").cast("string"), F.lit(" times")))


def parse_edge(text: str) -> tuple[str, str, list[str], list[str]]:
    """``from !> targets (sections)`` forbids, ``from => targets (sections)`` allows nothing else."""
    kind = "deny" if "!>" in text else "allow" if "=>" in text else None
    if kind is None:
        raise ValueError(f"{text}: an edge needs !> or =>")
    left, _, right = text.partition("!>" if kind == "deny" else "=>")
    m = re.match(r"(.*?)(?:\(([^)]*)\))?$", right.strip())
    targets = [x.strip() for x in m.group(1).split(",") if x.strip()]
    sections = [x.strip() for x in (m.group(2) or "").split(",") if x.strip()]
    if not left.strip() or (kind == "deny" and not targets) or set(sections) - {"normal", "build", "dev"}:
        raise ValueError(f"{text}: a malformed edge")
    return left.strip(), kind, targets, sections


def declared(recs: DataFrame) -> DataFrame:
    return recs.select("rel", F.explode("deps").alias("d")).select("rel", "d.*")


@rule("toml_cargo_layers", "workspace", "high", "Dependencies follow the layers.", default=False, rules=[])
def layers(recs: DataFrame, p: dict) -> DataFrame:
    deps = declared(recs)
    own = deps.where("section in ('normal', 'dev', 'build')")
    shared = deps.where("section = 'workspace'").groupBy(F.col("name").alias("_n")).agg(F.min_by(F.struct("package", "path", "rel"), "line").alias("w"))
    joined = own.join(shared, own.name == shared._n, "left")
    inherit = F.col("source") == "workspace"
    identity = F.coalesce(F.when(inherit, F.col("w.package")), F.col("package"), F.col("name"))
    places = recs.where("package is not null").select(F.col("package").alias("_p"), F.col("rel").alias("target")).dropDuplicates(["_p"])
    rows = joined.select("rel", "line", "section", "name", identity.alias("identity")).join(places, F.col("identity") == F.col("_p"), "left")
    found = graph.edge_matches(rows, [parse_edge(x) for x in p["rules"]], "rel", ["name", "identity", "target"], "section")
    message = F.concat(F.lit("dependency `"), "name", F.when(F.col("verdict") == "deny", "` is forbidden by ").otherwise("` isn't allowed by "), "edge")
    return _finding(found, "toml_cargo_layers", F.col("rel"), F.col("line"), message)


@rule("toml_cargo_path_deps", "workspace", "high", "Path dependencies stay in the workspace.", default=False, allow_in=["Cargo.toml"], allow_outside_workspace=False, allow_patch=False)
def path_deps(recs: DataFrame, p: dict) -> DataFrame:
    d = declared(recs).where("path is not null")
    reason = F.coalesce(
        F.when((F.col("section") == "patch") & F.lit(not p["allow_patch"]), "patches by path aren't allowed"),
        F.when((F.col("section") != "patch") & ~matches_any(F.col("rel"), p["allow_in"]), "path dependencies aren't allowed here"),
        F.when(F.lit(not p["allow_outside_workspace"]) & leaves_root(F.col("rel"), F.col("path")), "the path leaves the workspace"),
    )
    return _finding(d.withColumn("_r", reason).where("_r is not null"), "toml_cargo_path_deps", F.col("rel"), F.col("line"), F.concat(F.lit("`"), "name", F.lit("`: "), "_r"))


@rule("toml_cargo_unused_deps", "workspace", "medium", "Declared dependencies are used.", always_used=[])
def unused_deps(recs: DataFrame, p: dict) -> DataFrame:
    """Dependencies whose root no file of the manifest names. A manifest owns the files below its folder; the root
    manifest those that no other owns. Folders of a path are exploded: no theta join."""
    folder = F.regexp_replace("rel", r"/?[^/]*$", "")
    manifests = recs.where(F.col("rel").rlike(r"(^|/)Cargo\.toml$")).select(folder.alias("dir"), F.col("rel").alias("manifest"))
    parts = F.split("rel", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rust = recs.where(F.size("roots") > 0).select("rel", "roots", F.concat(F.array(F.lit("")), prefixes).alias("dirs"))
    held = rust.select("rel", "roots", F.explode("dirs").alias("dir")).join(manifests, "dir")
    nested = Window.partitionBy("rel")
    held = held.withColumn("_deep", F.max(F.length("dir")).over(nested)).where("dir != '' or _deep = 0")
    used = held.select("manifest", F.explode("roots").alias("root")).distinct()
    d = declared(recs).where("section in ('normal', 'dev', 'build')").withColumn("manifest", F.col("rel"))
    keep = F.col("root").isin(*p["always_used"]) | F.col("name").isin(*p["always_used"]) if p["always_used"] else F.lit(False)
    found = d.where(~keep).join(used, ["manifest", "root"], "left_anti")
    return _finding(found, "toml_cargo_unused_deps", F.col("rel"), F.col("line"), F.concat(F.lit("dependency `"), "name", F.lit("` isn't used")))
