"""Queries of the rule engine over sources made from the driver's tables: a row of ``documents`` gives a file.

The files are small and come in a few variants, so that SQL can state what each rule must find in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corposieve.operators import directives as dirs
from corposieve.operators import edits
from corposieve.plans import engine
from corposieve.plans.config import default
from corposieve.rules.catalog import builtin
from corposieve.rules.examples import examples
from corposieve.sources import corpus

#: Sources by variant, and rule -> findings in it.
RUST: list[tuple[str, dict[str, int]]] = [
    ("//! Adds.\n\n/// Adds.\npub fn add(a: bool, b: bool) -> Result<u8, String> {\n    let x = a.parse().unwrap();\n\n    Ok(x)\n}\n", {"rust_bool_params": 1, "rust_string_error": 1, "rust_unwrap_in_lib": 1, "rust_panic_in_result_fn": 1, "rust_doc_errors_section": 1, "rust_doc_panics_section": 1}),
    ("//! Holds.\n\n#[derive(Debug, Clone)]\npub struct Manager { pub token: String }\n\npub enum Kind { A, B }\n", {"rust_derive_order": 1, "rust_sensitive_debug": 1, "rust_weasel_words": 1, "rust_pub_api_docs": 2, "rust_non_exhaustive_on_public": 1, "rust_missing_debug": 1}),
    ("//! Waits.\n\nfn f(v: &Vec<u8>) {\n    // the the end\n    println!(\"{v:?}\");\n    // TODO later\n    unsafe { g() }\n}\n", {"rust_duplicate_words": 1, "rust_owned_ref_param": 1, "rust_println": 1, "rust_todo": 1, "rust_unsafe_comment": 1}),
    ("//! Silent.\n\n// #rw(file: rust_println) a tool prints\n\nfn f() {\n    println!(\"x\");\n    // #rw(rust_dbg) kept for now\n    dbg!(one);\n    dbg!(two);\n}\n", {"rust_dbg": 1}),
    ("fn broken( {\n\tlet x = 1;  \n", {"rust_style": 2, "rust_module_docs": 1}),
]
_RULES = sorted({k for _, x in RUST for k in x})
MANIFESTS: list[tuple[str, dict[str, int]]] = [
    ('[package]\nname = "a"\nedition = "2018"\nrust-version = "1.70"\n\n[features]\nuse-std = []\nno-std = []\n\n[lints]\nworkspace = true\n', {"toml_cargo_edition": 1, "toml_cargo_feature_names": 1, "toml_cargo_feature_no_std": 1}),
    ('[workspace]\nmembers = []\nresolver = "3"\n\n[workspace.package]\nedition = "2024"\nrust-version = "1.85"\n\n[workspace.dependencies]\nserde = { features = ["rc", "derive"], version = "1" }\n', {"toml_cargo_workspace_dep_features": 1}),
    ("[package\n", {"toml_validity": 1}),
]
_TOML = ["toml_cargo_edition", "toml_cargo_feature_names", "toml_cargo_feature_no_std", "toml_cargo_workspace_dep_features", "toml_validity"]


def _files(spark: SparkSession, d: str, variants: list[tuple[str, dict]], name: str, ext: str) -> DataFrame:
    docs = corpus.spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), "doc_id")
    kinds = F.array(*(F.lit(t) for t, _ in variants))
    return docs.select(
        F.format_string(name, "doc_id").alias("rel"), F.lit(ext).alias("ext"), F.get(kinds, (F.col("doc_id") % len(variants)).cast("int")).alias("contents"),
        F.lit(None).cast("string").alias("package"), F.lit(None).cast("boolean").alias("publishable"), F.lit(False).alias("test_only"),
    )


def rust_ast_rules(spark, d):
    found = engine.analyze(_files(spark, d, RUST, "src/f%d.rs", "rs"), builtin(), default(builtin()), _RULES)
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("rel").alias("files"))


#: Each rule's two examples: rule, path, package, source, whether the rule is to find fault with it.
_CASES = [(k, e.path, e.package, text, bad) for k, e in sorted(examples().items()) for text, bad in ((e.fails, True), (e.passes, False)) if text]


def rule_examples(spark, d):
    """Every rule of single files over files made of all rules' examples: how many files of its own the rule flags."""
    cases = F.array(*(F.struct(F.lit(rule).alias("own"), F.lit(path).alias("path"), F.lit(package).cast("string").alias("package"), F.lit(text).alias("contents")) for rule, path, package, text, _ in _CASES))
    docs = corpus.spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), "doc_id").select("doc_id", F.get(cases, (F.col("doc_id") % len(_CASES)).cast("int")).alias("c"))
    files = docs.select(F.format_string("%s/%d/%s", "c.own", "doc_id", "c.path").alias("rel"), F.substring_index("c.path", ".", -1).alias("ext"), "c.contents", "c.package", F.lit(False).alias("test_only"))
    found = engine.analyze(files, builtin(), default(builtin(), everything=True), [k for k, *_ in _CASES], raw=True)
    return found.where(F.substring_index("rel", "/", 1) == F.col("rule")).groupBy("rule").agg(F.countDistinct("rel").alias("files"))


def recursive_self_reference(spark, d):
    """A function for each document, which calls itself or, for some languages, another."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    callee = F.when(F.col("lang").isin("en", "fr"), F.lit("down")).otherwise("other")
    body = F.format_string("//! F.\n\nfn down(n: u8) -> u8 { if n == 0 { 0 } else { %s(n - 1) } }\n", callee)
    files = docs.select(F.format_string("src/f%d.rs", "doc_id").alias("rel"), F.lit("rs").alias("ext"), body.alias("contents"), F.lit(None).cast("string").alias("package"), F.lit(False).alias("test_only"))
    return engine.analyze(files, builtin(), default(builtin()), ["rust_recursive_fn"]).select("rel", "line")


#: Directives of every scope, and what they cover.
_SCOPED = """//! Scopes.

// #rw(fn: rust_println) shown
fn a() {
    println!("a");
    if x {
        println!("b");
    }
}

fn b() {
    println!("c");

    // #rw(block: rust_println, rust_todo) shown
    if x {
        // TODO later
        println!("d");
    }

    // TODO again
    println!("e");
}

// #rw(rust_println) shown
fn c() { println!("f"); }

// #rw(fn: *) all of it
fn d() {
    println!("g");
    // TODO more
}
"""


def suppression_scopes(spark, d):
    """Suppression by function, block, next line and wildcard; what is left of each file."""
    files = _files(spark, d, [(_SCOPED, {})], "src/f%d.rs", "rs")
    found = engine.analyze(files, builtin(), default(builtin()), ["rust_println", "rust_todo"])
    return found.select("rel", "line", "rule")


def cargo_manifest_rules(spark, d):
    found = engine.analyze(_files(spark, d, MANIFESTS, "c%d/Cargo.toml", "toml"), builtin(), default(builtin()), _TOML)
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("rel").alias("files"))


def directive_parse(spark, d):
    found = dirs.directives(_files(spark, d, RUST, "src/f%d.rs", "rs"))
    return found.select("rel", "line", "end_line", "scope", F.array_join("rules", ",").alias("rules"), "reason")


_FIXED = {0: "//! A.\n\n#[derive(Clone, Debug)]\nstruct A;\n\nmod a;\nmod b;\n", 1: "//! B.\n\n// fine\nfn f() {\n    g(2);\n}\n"}
_BROKEN = [("//! A.\n\n#[derive(Debug, Clone)]\nstruct A;\n\nmod b;\nmod a;\n", {}), ("//! B.  \n\n//fine\nfn f() {\n\tg(dbg!(2));\n}\n", {})]


def fix_fixpoint(spark, d):
    reg = builtin()
    rules = [reg.rules[k] for k in ("rust_dbg", "rust_derive_order", "rust_mod_order", "rust_style", "rust_comment_space")]
    return edits.fix(_files(spark, d, _BROKEN, "src/f%d.rs", "rs"), rules, lambda r: dict(r.params)).select("rel", "after")


def greedy_fix_apply(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    start = (F.col("event_id") * 37 % 1000).cast("int")
    rows = e.select(F.concat(F.lit("u"), "user_id").alias("rel"), start.alias("start_line"), (start + F.col("event_id") % 40).cast("int").alias("end_line"), F.col("event_id").alias("seq"))
    return edits.greedy(rows)


def workspace_duplicates(spark, d):
    """Every line of documents as a string literal on its line: those of 40 characters found three times or more."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = F.regexp_replace(F.regexp_replace("text", r'["\\]', ""), "\n", '");\ng("')
    body = F.concat(F.lit('fn f() { g("'), text, F.lit('"); }\n'))
    files = docs.select(F.format_string("f%012d.rs", "doc_id").alias("rel"), F.lit("rs").alias("ext"), body.alias("contents"), F.lit(None).cast("string").alias("package"), F.lit(False).alias("test_only"))
    found = engine.workspace(files, builtin(), default(builtin()), ["rust_duplicate_strings"])
    return found.select("rel", "line")


QUERIES = {f.__name__: f for f in (rust_ast_rules, rule_examples, recursive_self_reference, suppression_scopes, cargo_manifest_rules, directive_parse, fix_fixpoint, greedy_fix_apply, workspace_duplicates)}


def _expected(variants: list[tuple[str, dict[str, int]]]) -> str:
    rows = ", ".join(f"({i}, '{k}', {n})" for i, (_, x) in enumerate(variants) for k, n in x.items())
    return f"SELECT rule, sum(v.n)::BIGINT AS n, count(*) AS files FROM documents JOIN (VALUES {rows}) AS v(kind, rule, n) ON doc_id % {len(variants)} = kind GROUP BY rule"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


ORACLE_SQL = {
    "rust_ast_rules": _expected(RUST),
    "rule_examples": "SELECT rule, count(*) AS files FROM documents JOIN (VALUES " + ", ".join(f"({i}, '{k}')" for i, (k, *_, bad) in enumerate(_CASES) if bad) + f") AS v(kind, rule) ON doc_id % {len(_CASES)} = kind GROUP BY rule",
    "recursive_self_reference": "SELECT 'src/f' || doc_id || '.rs' AS rel, 3::INTEGER AS line FROM documents WHERE lang IN ('en', 'fr')",
    "suppression_scopes": "SELECT 'src/f' || doc_id || '.rs' AS rel, v.* FROM documents, (VALUES (12, 'rust_println'), (20, 'rust_todo'), (21, 'rust_println')) AS v(line, rule)",
    "cargo_manifest_rules": _expected(MANIFESTS),
    "directive_parse": """SELECT 'src/f' || doc_id || '.rs' AS rel, v.* FROM documents, (VALUES (3, NULL::INTEGER, 'file', 'rust_println', 'a tool prints'), (7, 8, 'next', 'rust_dbg', 'kept for now')) AS v(line, end_line, scope, rules, reason) WHERE doc_id % 5 = 3""",
    "fix_fixpoint": f"SELECT 'src/f' || doc_id || '.rs' AS rel, CASE doc_id % 2 WHEN 0 THEN {_q(_FIXED[0])} ELSE {_q(_FIXED[1])} END AS after FROM documents",
    "greedy_fix_apply": """WITH RECURSIVE e AS (SELECT 'u' || user_id AS rel, (event_id * 37 % 1000)::INTEGER AS s, (event_id * 37 % 1000 + event_id % 40)::INTEGER AS t, event_id AS seq FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY s DESC, t DESC, seq) AS k FROM e),
r(rel, k, low, keep) AS (SELECT rel, k, s, true FROM o WHERE k = 1 UNION ALL SELECT o.rel, o.k, CASE WHEN o.t < r.low THEN o.s ELSE r.low END, o.t < r.low FROM r JOIN o ON o.rel = r.rel AND o.k = r.k + 1)
SELECT o.rel, s AS start_line, t AS end_line, seq FROM o JOIN r USING (rel, k) WHERE keep""",
    "workspace_duplicates": r"""WITH t AS (SELECT format('f{:012d}.rs', doc_id) AS rel, string_split(regexp_replace(text, '["\\]', '', 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT rel, unnest(ls) AS x, generate_subscripts(ls, 1)::INTEGER AS line FROM t),
m AS (SELECT rel, line, count(*) OVER (PARTITION BY x) AS n, row_number() OVER (PARTITION BY x ORDER BY rel, line) AS k FROM l WHERE length(x) >= 38)
SELECT rel, line FROM m WHERE n >= 3 AND k > 1""",
}
