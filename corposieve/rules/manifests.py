"""Rules over TOML manifests, and the records that rules across manifests read."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from corposieve.rules.base import BUILTIN, rule
from corposieve.rules.lines import ambiguous, bidirectional

_EDITION_MSRV = {2018: (1, 31), 2021: (1, 56), 2024: (1, 85)}


class TomlFile:
    def __init__(self, text: str, rel: str = "Cargo.toml") -> None:
        self.text, self.rel = text, rel
        self.lines = [x.removesuffix("\r") for x in text.split("\n")]
        self.error: tuple[int, str] | None = None
        try:
            self.doc = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            m = re.search(r"line (\d+)", str(e))
            self.error, self.doc = (int(m.group(1)) if m else len(self.lines), str(e)), {}

    @property
    def root(self) -> bool:
        return "workspace" in self.doc

    def line(self, *keys: str) -> int:
        """The line of a key in its table; of the table if the key isn't written by itself; else 1."""
        table, best = "", 1
        for i, line in enumerate(self.lines, 1):
            t = line.strip()
            if m := re.match(r"\[\[?([^\]]+)\]\]?", t):
                table = re.sub(r"[\s\"']", "", m.group(1))
                if table == ".".join(keys):
                    return i
                if table == ".".join(keys[:-1]):
                    best = i
            elif "=" in t and not t.startswith("#"):
                key = re.sub(r"[\s\"']", "", t.split("=")[0])
                full = f"{table}.{key}" if table else key
                if full == ".".join(keys) or full.startswith(".".join(keys) + "."):
                    return i
        return best


def tables(doc: dict) -> Iterator[tuple[str, list[str], dict]]:
    """(section, path, table) of all dependency tables of a manifest, targets included."""
    names = {"dependencies": "normal", "dev-dependencies": "dev", "dev_dependencies": "dev", "build-dependencies": "build", "build_dependencies": "build"}
    for key, section in names.items():
        if isinstance(doc.get(key), dict):
            yield section, [key], doc[key]
        for target, inner in (doc.get("target") or {}).items():
            if isinstance(inner, dict) and isinstance(inner.get(key), dict):
                yield section, ["target", target, key], inner[key]


def dependencies(f: TomlFile) -> Iterator[dict]:
    """Records of declared dependencies: normal, dev, build, those of the workspace, and patches."""
    every = [*tables(f.doc), ("workspace", ["workspace", "dependencies"], (f.doc.get("workspace") or {}).get("dependencies") or {})]
    every += [("patch", ["patch", k], v) for k, v in (f.doc.get("patch") or {}).items() if isinstance(v, dict)]
    for section, path, table in every:
        for name, spec in table.items():
            spec = {"version": spec} if isinstance(spec, str) else spec if isinstance(spec, dict) else {}
            source = "workspace" if spec.get("workspace") is True else "path" if "path" in spec else "git" if "git" in spec else "registry"
            yield {
                "rel": f.rel, "section": section, "name": name, "root": name.replace("-", "_"), "line": f.line(*path, name), "source": source, "path": spec.get("path"),
                "package": spec.get("package"), "version": spec.get("version"), "features": [x for x in spec.get("features") or [] if isinstance(x, str)],
            }


def msrv(text: object) -> tuple[int, int] | None:
    m = re.match(r"(\d+)\.(\d+)", text) if isinstance(text, str) else None
    return (int(m.group(1)), int(m.group(2))) if m else None


def inherits(table: dict, key: str) -> bool:
    return isinstance(table.get(key), dict) and table[key].get("workspace") is True


@rule("toml_validity", "toml", "high", "Files are valid TOML.")
def validity(f, p):
    if f.error:
        yield f.error


@rule("toml_ambiguous_unicode", "toml", "high", "Characters aren't mistaken for others.")
def ambiguous_unicode(f, p):
    yield from ambiguous(f.lines)


@rule("toml_bidirectional_unicode", "toml", "high", "Text runs one way.")
def bidirectional_unicode(f, p):
    yield from bidirectional(f.lines)


def cargo(f) -> bool:
    return f.rel.rpartition("/")[2] == "Cargo.toml" and not f.error


@rule("toml_cargo_edition", "toml", "medium", "Manifests set a current edition.", min_edition=2024)
def edition(f, p):
    if not cargo(f):
        return
    work, pack = f.doc.get("workspace"), f.doc.get("package")

    def judge(table, prefix):
        value = table.get("edition")
        if value is None:
            yield f.line(*prefix), "no edition is set"
        elif not isinstance(value, str) or not value.isdigit():
            yield f.line(*prefix, "edition"), "the edition isn't a year"
        else:
            if int(value) < p["min_edition"]:
                yield f.line(*prefix, "edition"), f"edition {value} is old"
            need, have = _EDITION_MSRV.get(int(value)), msrv(table.get("rust-version"))
            if need and have and have < need:
                yield f.line(*prefix, "rust-version"), f"edition {value} needs a later rust-version"

    if isinstance(work, dict):
        shared = work.get("package") or {}
        if pack is None or "edition" in shared or inherits(pack, "edition"):
            yield from judge(shared, ["workspace", "package"])
        if pack is None and str(work.get("resolver", "")) != "3" and str(shared.get("edition", "")).isdigit() and int(shared["edition"]) >= 2024:
            yield f.line("workspace", "resolver"), "a virtual workspace needs resolver 3"
        if pack is not None and not inherits(pack, "edition"):
            yield from judge(pack, ["package"])
    elif isinstance(pack, dict) and not inherits(pack, "edition"):
        yield from judge(pack, ["package"])


@rule("toml_cargo_exact_versions", "toml", "medium", "Versions are exact.", default=False)
def exact_versions(f, p):
    if cargo(f):
        for d in dependencies(f):
            if d["section"] != "patch" and isinstance(d["version"], str) and not re.fullmatch(r"\s*=\s*\d+\.\d+\.\d+([-+].*)?\s*", d["version"]):
                yield d["line"], f"`{d['name']}` has version {d['version']}"


@rule("toml_cargo_feature_names", "toml", "low", "Features are named for what they add.", allowed=[])
def feature_names(f, p):
    if cargo(f):
        for name in f.doc.get("features") or {}:
            if re.search(r"^(use|with)[-_]|[-_]support$", name) and name not in p["allowed"]:
                yield f.line("features", name), f"feature `{name}`"


@rule("toml_cargo_feature_no_std", "toml", "medium", "Features add.")
def feature_no_std(f, p):
    if cargo(f):
        for name in f.doc.get("features") or {}:
            if name in ("no-std", "no_std", "nostd"):
                yield f.line("features", name), f"feature `{name}` takes away"


@rule("toml_cargo_msrv", "toml", "low", "The workspace sets one rust-version.")
def rust_version(f, p):
    if not cargo(f):
        return
    work, pack = f.doc.get("workspace"), f.doc.get("package")
    if isinstance(work, dict):
        if not isinstance((work.get("package") or {}).get("rust-version"), str):
            yield f.line("workspace", "package"), "no rust-version is set"
        if isinstance(pack, dict) and not inherits(pack, "rust-version"):
            yield f.line("package", "rust-version"), "rust-version isn't inherited"
    elif isinstance(pack, dict):
        if "/" not in f.rel:
            if not isinstance(pack.get("rust-version"), str):
                yield f.line("package", "rust-version"), "no rust-version is set"
        elif not inherits(pack, "rust-version"):
            yield f.line("package", "rust-version"), "rust-version isn't inherited"


@rule("toml_cargo_workspace_dep_features", "toml", "low", "Members choose features.", allowed_features=["derive", "std"], crate_features=[])
def workspace_dep_features(f, p):
    if not cargo(f):
        return
    granted: dict[str, set[str]] = {}
    for entry in p["crate_features"]:
        name, _, feats = re.sub(r"\s", "", entry).replace("=", ":").partition(":")
        granted.setdefault(name.split("/")[0], set()).update((feats or entry.partition("/")[2]).split(","))
    for d in dependencies(f):
        if d["section"] == "workspace":
            extra = [x for x in d["features"] if x not in p["allowed_features"] and x not in granted.get(d["name"], ())]
            if extra:
                yield d["line"], f"`{d['name']}` turns on {', '.join(extra)} for all"


_LINTS_RUST = sorted("unused_lifetimes unsafe_op_in_unsafe_fn trivial_numeric_casts missing_debug_implementations redundant_lifetimes redundant_imports ambiguous_negative_literals".split())
_LINTS_CLIPPY = (
    "suspicious style perf pedantic correctness complexity cargo undocumented_unsafe_blocks semicolon_outside_block renamed_function_params redundant_type_annotations map_err_ignore "
    "implicit_clone if_then_some_else_none fn_to_numeric_cast_any empty_structs_with_brackets empty_enum_variants_with_brackets empty_drop disallowed_script_idents deref_by_slicing "
    "clone_on_ref_ptr assertions_on_result_states as_pointer_underscore allow_attributes_without_reason"
).split()


@rule("toml_cargo_workspace_lints", "toml", "medium", "The workspace sets lints, members inherit them.", required_rust=_LINTS_RUST, required_clippy=_LINTS_CLIPPY)
def workspace_lints(f, p):
    if not cargo(f):
        return
    if f.root:
        lints = (f.doc["workspace"] or {}).get("lints") or {}
        for tool in ("rust", "clippy"):
            own = lints.get(tool) or {}
            for name in p[f"required_{tool}"]:
                level = own.get(name)
                level = level.get("level") if isinstance(level, dict) else level
                if level is None or level == "allow":
                    yield f.line("workspace", "lints", tool), f"lint {tool}::{name} isn't set"
    if "package" in f.doc and ("/" in f.rel or f.root) and (f.doc.get("lints") or {}).get("workspace") is not True:
        yield f.line("lints"), "lints aren't inherited"


def check_text(rule_id: str, text: str, rel: str = "Cargo.toml", params: dict | None = None) -> list[tuple[int, str]]:
    r = BUILTIN.rules[rule_id]
    return list(r.check(TomlFile(text, rel), dict(r.params) | (params or {})))


def escapes(manifest: str, path: str) -> bool:
    """Whether a relative path leaves the workspace, lexically."""
    depth = manifest.count("/")
    for part in path.replace("\\", "/").split("/"):
        depth += -1 if part == ".." else 0 if part in ("", ".") else 1
        if depth < 0:
            return True
    return path.startswith("/") or bool(re.match(r"[A-Za-z]:", path))


def leaves_root(manifest: Column, path: Column) -> Column:
    """``escapes`` as a fold over the parts of the path."""
    depth = F.length(manifest) - F.length(F.replace(manifest, F.lit("/"), F.lit("")))
    steps = F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1))
    lowest = F.aggregate(
        steps, F.struct(depth.cast("int").alias("at"), F.lit(0).alias("low")),
        lambda s, x: F.struct((s["at"] + x).alias("at"), F.least(s["low"], s["at"] + x).alias("low")), lambda s: s["low"],
    )
    return (lowest < 0) | path.startswith("/") | path.rlike("^[A-Za-z]:")
