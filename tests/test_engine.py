"""The rule engine: text functions, scoping, suppression, baselines, fixes, trees and the command line."""

from __future__ import annotations

import json
import re
import weakref
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from corposieve import cli
from corposieve.functions import globs, text
from corposieve.operators import edits, findings, graph
from corposieve.operators.directives import directives, directives_of, parse_directive
from corposieve.plans import config as conf
from corposieve.plans import engine
from corposieve.rules.base import Registry, Rule
from corposieve.rules.catalog import builtin
from corposieve.rules.examples import examples
from corposieve.rules.manifests import TomlFile, check_text, escapes, leaves_root
from corposieve.sources import corpus
from corposieve.streaming import incremental
from corposieve.syntax.parser import RustFile

REG = builtin()


def found(rule, code, rel="src/lib.rs", package=None, **params):
    r = REG.rules[rule]
    return list(r.check(RustFile(code, rel, package), dict(r.params) | params))


def test_catalog():
    kinds = [r.kind for r in REG.rules.values()]
    assert len(kinds) == 171
    assert {k: kinds.count(k) for k in set(kinds)} == {"rust-ast": 127, "rust-line": 28, "toml": 10, "rust-workspace": 3, "workspace": 3}
    assert sum(r.default for r in REG.rules.values()) == 163 and sum(r.fixable for r in REG.rules.values()) == 21
    assert "| `rust_style` |" in cli.markdown(REG)


CASES = [
    ("rust_unwrap_in_lib", "fn f() { a.unwrap(); }", "#[cfg(test)]\nmod t { fn f() { a.unwrap(); } }"),
    ("rust_bool_params", "fn set(hot: bool, n: u8, dry: bool) {}", "fn set(hot: bool, n: u8) {}"),
    ("rust_ctor_param_count", "struct S; impl S { fn new(a: u8, b: u8, c: u8) -> Self { S } }", "struct S; impl S { fn new(a: u8, b: &str) -> Self { S } }"),
    ("rust_cyclomatic_complexity", "fn f() {" + "if a { b(); }" * 16 + "}", "fn f() {" + "if a { b(); }" * 5 + "}"),
    ("rust_max_nesting", "fn f() {" + "if a {" * 6 + "}" * 6 + "}", "fn g() { if x { 1; } else if y { 2; } }"),
    ("rust_recursive_fn", "fn f() { f() }", "fn f() { g() }"),
    ("rust_large_enum_variant", "enum E { A(u8), B([u8; 900]) }", "enum E { A(u8), B(u16) }"),
    ("rust_dup_expressions", "fn f() { a.b == a . b; }", "fn f() { a.b == a.c; }"),
    ("rust_floating_point_eq", "fn f(x: f64) -> bool { x == 1.5 }", "fn f(x: f64) -> bool { x == 0.0 }"),
    ("rust_panic_in_result_fn", "fn f() -> Result<u8, E> { x.expect(\"y\") }", "fn f() -> Option<u8> { None }"),
    ("rust_transmute_usage", "fn f() { std::mem::transmute(x); }", "fn f() {\n    // SAFETY: same layout\n    std::mem::transmute(x);\n}"),
    ("rust_unchecked_indexing", "fn f(v: &[u8], i: usize) { v[i]; }", "fn f(v: &[u8]) { for i in 0..v.len() { v[i]; } }"),
    ("rust_doc_errors_section", "/// Does.\npub fn f() -> Result<u8, E> { g() }", "/// Does.\n/// # Errors\n/// Never.\npub fn f() -> Result<u8, E> { g() }"),
    ("rust_first_doc_sentence", "/// " + "word " * 20 + ".\nfn f() {}", "/// Short.\nfn f() {}"),
    ("rust_module_docs", "fn f() {}", "//! Documented.\nfn f() {}"),
    ("rust_todo", 'let a = "http://x TODO";', "// TODO(me): later"),
    ("rust_expect_over_allow", "#[allow(unused)]\nconst A: u8 = 1;", "#[expect(unused)]\nconst A: u8 = 1;"),
    ("rust_println", 'fn f() { println!("a"); }', 'fn f() { log::info!("a"); }'),
    ("rust_owned_ref_param", "fn f(a: &Vec<u8>) {}", "fn f(a: &mut Vec<u8>) {}"),
    ("rust_manual_async_fn", "fn load(k: u8) -> impl Future<Output = Page> { async move { get(k).await } }", "async fn load() -> u8 { 7 }"),
    ("rust_nonsend_across_await", "async fn run() { let shared = Rc::new(9); step(2).await }", "async fn run() { step(2).await; let shared = Rc::new(9); }"),
    ("rust_box_vec", "struct S { a: Box<Vec<u8>> }", "struct S { a: Box<[u8]> }"),
    ("rust_missing_capacity", "fn f(x: &[u8]) { let mut v = Vec::new(); for i in x.iter() { v.push(i); } }", "fn f(x: &[u8]) { let mut v = Vec::new(); for i in x.iter() { if i { v.push(i); } } }"),
    ("rust_ok_or_eager", "fn f() { a.ok_or(make()); }", "fn f() { a.ok_or(1); }"),
    ("rust_sensitive_debug", "#[derive(Debug)]\nstruct S { user_password: String }", "#[derive(Debug)]\nstruct S { password: Secret<String> }"),
    ("rust_unsafe_comment", "fn f() { unsafe { g() } }", "fn f() {\n    // SAFETY: checked above\n    unsafe { g() }\n}"),
    ("rust_hardcoded_url", 'fn f() { get("https://example.com/x"); }', 'const U: &str = "https://example.com/x";'),
    ("rust_aligned", "// #rw:aligned\n(A, 1),\n(LONG, 2),\n", "// #rw:aligned\n(A,    1),\n(LONG, 2),\n"),
    ("rust_sorted", "// #rw:sorted\nuse b;\nuse a;\n", "// #rw:sorted\nuse a;\nuse b;\n"),
    ("rust_padding", "fn f() {\n    let a = 1;\n    g(a);\n}", "fn f() {\n    let a = 1;\n\n    g(a);\n}"),
    ("rust_style", "a \n", "a\r\nb\r\n"),
    ("rust_yoda_conditions", "fn f() { 1 == x; }", "fn f() { x == 1; }"),
    ("rust_ambiguous_unicode", "let а = 1;", "let é = 1;"),
    ("rust_bidirectional_unicode", "// \u202e x", "// x"),
]


@pytest.mark.parametrize(("rule", "bad", "good"), CASES, ids=[c[0] for c in CASES])
def test_rules(rule, bad, good):
    assert found(rule, bad) and not found(rule, good)


def test_rules_by_place():
    assert found("rust_build_rs_external_tool", 'fn main() { std::process::Command::new("cmake"); }', "build.rs")
    assert not found("rust_build_rs_external_tool", 'fn main() { std::process::Command::new("cmake"); }')
    assert found("rust_no_prelude", "mod prelude;", package="a") and not found("rust_no_prelude", "mod prelude;")
    assert found("rust_ffi_in_core", '#[no_mangle]\npub extern "C" fn f() {}', package="core-lib") and not found("rust_ffi_in_core", '#[no_mangle]\npub extern "C" fn f() {}', package="x-ffi")
    assert found("rust_too_many_lines_in_file", "a\n" * 10, threshold=5)
    assert not found("rust_too_many_lines_in_file", "// #rw(file: rust_too_many_lines_in_file = 9) grown\n" + "a\n" * 9, threshold=5)


def test_parser_columns_are_bytes_and_errors_keep_line_rules():
    f = RustFile('fn f() { let é = x.unwrap(); }')
    n = f.of("MethodCallExpr")[0]
    assert f.column_at(n.start) == 19 and f.line_at(n.start) == 1
    broken = RustFile("fn broken( {\n\tlet x;\n")
    rules = [REG.rules["rust_style"], REG.rules["rust_unwrap_in_lib"]]
    assert broken.errors and [x[3] for x in engine.file_findings(broken, rules, lambda r: dict(r.params))] == ["rust_style"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="fn()<>{}[]&|'\"/#!:;,.=abx1 \n", max_size=60))
def test_parser_never_crashes(source):
    f = RustFile(source)
    assert all(a.pre < b.pre for a, b in zip(f.nodes, f.nodes[1:], strict=False))


@pytest.mark.parametrize(("glob", "yes", "no"), [("src/*.rs", "src/a.rs", "src/b/a.rs"), ("**/a.rs", "x/y/a.rs", "x/ba.rs"), ("src/**", "src/x/y", "srcx/y"), ("{a,b}/?", "b/c", "c/c"), ("[!a]*", "bc", "ab"), ("a.b", "a.b", "axb")])
def test_globs(glob, yes, no):
    r = re.compile(globs.glob_regex(glob))
    assert r.match(yes) and not r.match(no)
    assert globs.glob_regex("[a") is None and globs.glob_regex("{a") is None


def test_lines_are_those_of_the_file(spark):
    texts = ["", "a", "a\n", "a\r\nb\r\n", "\n", "a\n\nb", "a\rb\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in corpus.lines(corpus.from_table(df, "k", "t")).collect():
        got.setdefault(int(r.rel), []).append((r.line, r.text))
    want = {0: [], 1: ["a"], 2: ["a"], 3: ["a", "b"], 4: [""], 5: ["a", "", "b"], 6: ["a\rb"], 7: []}
    assert {k: [t for _, t in sorted(got.get(k, []))] for k in want} == want


def test_text_functions(spark):
    row = spark.range(1).select(text.trim_end(F.lit("a\t\u00a0")).alias("a"), text.repeated_word(F.lit("x The the y y")).alias("b"), text.repeated_word(F.lit("x y")).alias("c"), text.camel_words(F.lit("HTTPServerName")).alias("d"), text.n_grams(F.split(F.lit("a b c"), " "), 2).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("a", "the", None, ["HTTP", "Server", "Name"], [["a", "b"], ["b", "c"]])


def test_directives():
    assert parse_directive("x // #rw(a) b") is None
    assert parse_directive("// #rw(a, b) why")["rules"] == ["a", "b"]
    for bad in ("// #rw()", "// #rw(a", "// #rw(a)", "// #rw(fn: a = 3) r", "// #rw(file: a = 0) r", "// #rw(a, *) r", "// #rw(file:) r"):
        assert parse_directive(bad)["error"], bad
    lines = ["// #rw(fn: r) x", "fn f() {", "    a", "}", "b", "// #rw(block: r) x", "c", "}", "// #rw(r) x", "d"]
    assert [(d["line"], d["end_line"]) for d in directives_of("f", lines)] == [(1, 4), (6, 7), (9, 10)]


def _files(spark, rows, test_only=False):
    return spark.createDataFrame([(rel, rel.rpartition(".")[2], t, None, None, test_only) for rel, t in rows], "rel string, ext string, contents string, package string, publishable boolean, test_only boolean")


def test_engine_suppresses_alike_in_both_ways(spark):
    source = "//! A.\n\nfn a() {\n    // #rw(rust_dbg) kept\n    dbg!(x);\n    dbg!(y + 2);\n}\n\n// #rw(fn: *) all\nfn b() {\n    dbg!(3);\n}\n\nfn c() {\n    dbg!(4);\n}\n"
    files = _files(spark, [("a.rs", source), ("b.rs", "// #rw(file: rust_dbg) tool\n\nfn a() { dbg!(1); }\n")])
    config = conf.default(REG)
    one = engine.analyze(files, REG, config, ["rust_dbg"]).select("rel", "line").collect()
    raw = engine.analyze(files, REG, config, ["rust_dbg"], raw=True)
    two = findings.suppress(raw, directives(files)).select("rel", "line").collect()
    assert sorted(one) == sorted(two) and [r.line for r in one] == [6, 15]
    stale = engine.stale(_files(spark, [("a.rs", "// #rw(rust_dbg) old\nfn a() {}\n")]), REG, config).collect()
    assert [(r.rel, r.line, r.rule) for r in stale] == [("a.rs", 1, "rust_dbg")]
    strict = conf.Config(config.rules, allow_suppressions=False)
    assert engine.analyze(files, REG, strict, ["rust_dbg"]).where("rule = 'rust_dbg'").count() == 5


def test_baseline_round_trip(spark):
    rows = [("a", n, None, "r", "m", False) for n in range(5)] + [("b", 1, 2, "r", "m", False)]
    df = spark.createDataFrame(rows, "rel string, line int, column int, rule string, message string, fixable boolean")
    base = findings.write_baseline(df)
    assert findings.apply_baseline(df, base).count() == 0
    some = base.where("path = 'a'").withColumn("count", F.lit(3).cast("long"))
    assert sorted(r.line for r in findings.apply_baseline(df, some).collect()) == [1, 3, 4]


def test_config():
    c = conf.load('[glob_sets]\ngen = ["gen/**"]\n[rules.rust_bool_params]\nthreshold = 3\nignore = ["@gen"]\noverrides = [{ paths = ["x/**"], threshold = 5 }, { paths = ["x/y/**"], threshold = 7 }]\n', REG)
    r = REG.rules["rust_bool_params"]
    assert [c.params(r, p)["threshold"] for p in ("a.rs", "x/a.rs", "x/y/a.rs")] == [3, 5, 7]
    assert c.applies(r.id, "a.rs") and not c.applies(r.id, "gen/a.rs")
    for bad in ("[rules.nope]\n", "[rules.rust_bool_params]\nthreshold = -1\n", '[rules.rust_bool_params]\nthreshold = "x"\n', '[rules.rust_dbg]\nonly = ["@no"]\n', "what = 1\n", '[rules.rust_weasel_words]\nwords = ["A", "A"]\n'):
        with pytest.raises(conf.ConfigError):
            conf.load(bad, REG)
    assert conf.load(conf.render_default(REG), REG).rules.keys() == REG.rules.keys()


def test_registry_takes_packs_whole():
    mine = Rule("x_rule", "rust-line", "low", "d", lambda f, p: iter(()))
    reg = builtin()
    reg.extend("mine", "1.0.0", "abc", [mine])
    assert "x_rule" in reg.rules and list(reg.rules) == sorted(reg.rules)
    before = dict(reg.rules)
    for name, version, fingerprint, rules in (("mine", "1.0.0", "a", []), ("builtin", "1.0.0", "a", []), ("o", "1", "a", []), ("o", "1.0.0", "", []), ("o", "1.0.0", "a", [Rule("y", "rust-line", "low", "d", mine.check), mine])):
        with pytest.raises(ValueError):
            reg.extend(name, version, fingerprint, rules)
    assert reg.rules == before
    with pytest.raises(ValueError):
        Registry([Rule("z", "rust-line", "low", "d", mine.check, params={"f": 1.5})])


FIXES = [
    ("rust_dbg", "fn f() { g(dbg!(1 + 2)); }\n", "fn f() { g(1 + 2); }\n"),
    ("rust_derive_order", "#[derive(Debug, Clone)]\nstruct A;\n", "#[derive(Clone, Debug)]\nstruct A;\n"),
    ("rust_style", "a\t \r\n".replace("\r\n", "\n"), "a\n"),
    ("rust_missing_debug", "pub struct A;\n", "#[derive(Debug)]\npub struct A;\n"),
    ("rust_ok_or_eager", "fn f() { a.ok_or(g(1)); }\n", "fn f() { a.ok_or_else(|| g(1)); }\n"),
    ("rust_redundant_field_names", "fn f() { A { x: x }; }\n", "fn f() { A { x }; }\n"),
    ("rust_duplicate_words", "// the the end\n", "// the end\n"),
    ("rust_from_instead_of_as", "fn f() { let a = 1u8 as u16; }\n", "fn f() { let a = u16::from(1u8); }\n"),
    ("rust_sorted", "// #rw:sorted\nuse b;\n// about a\nuse a;\n", "// #rw:sorted\nuse a;\n// about a\nuse b;\n"),
    ("rust_impl_member_order", "struct S;\nimpl S {\n    fn a(&self) {}\n\n    const X: u8 = 1;\n}\n", "struct S;\nimpl S {\n    const X: u8 = 1;\n\n    fn a(&self) {}\n}\n"),
    ("rust_aligned", "// #rw:aligned\n(A, 1),\n(LONG, 2),\n", "// #rw:aligned\n(A,    1),\n(LONG, 2),\n"),
    ("rust_aligned", "// #rw:aligned\nA => 1,\nLONG => 2,\n", "// #rw:aligned\nA    => 1,\nLONG => 2,\n"),
]


@pytest.mark.parametrize(("rule", "before", "after"), FIXES, ids=[f"{c[0]}-{i}" for i, c in enumerate(FIXES)])
def test_fixes_reach_a_fixpoint(rule, before, after):
    r = REG.rules[rule]
    text_, _ = edits.mend(before, "a.rs", [r], lambda r: dict(r.params))
    assert text_ == after
    assert edits.mend(text_, "a.rs", [r], lambda r: dict(r.params)) == (after, 0)


def test_edits():
    text_, n = edits.apply_edits("a\nb\nc\n", [edits.Edit(1, 2, "x"), edits.Edit(2, 3, "y"), edits.Edit(1, 1, "z")])
    assert (text_, n) == ("z\ny\n", 2)
    assert edits.apply_edits("a\r\nb\r\n", [edits.Edit(2, 2, "c")])[0] == "a\r\nc\r\n"
    with pytest.raises(ValueError):
        edits.apply_edits("a\n", [edits.Edit(2, 2, "x")])


def test_manifest_rules():
    assert check_text("toml_validity", "a = \n") and not check_text("toml_validity", "a = 1\n")
    assert check_text("toml_cargo_exact_versions", '[dependencies]\na = "1"\n') and not check_text("toml_cargo_exact_versions", '[dependencies]\na = "=1.2.3"\n')
    assert check_text("toml_cargo_msrv", '[package]\nname = "a"\nrust-version = "1.85"\n', "m/Cargo.toml")
    assert check_text("toml_cargo_workspace_lints", '[package]\nname = "a"\n', "m/Cargo.toml")
    assert escapes("a/Cargo.toml", "../../x") and not escapes("a/Cargo.toml", "../x")
    f = TomlFile('[package]\nname = "a"\n\n[dependencies]\nx = "1"\n\n[dependencies.y]\nversion = "2"\n')
    assert (f.line("dependencies", "x"), f.line("dependencies", "y"), f.line("package", "none")) == (5, 7, 1)


def test_rules_across_files(spark):
    body = "{ let a = one(1, 2, 3); let b = two(a, 4); if a > b { three(a); } else { four(b); } five(a, b); six(a); seven(b); " + " ".join(f"step{i}(a, {i});" for i in range(20)) + " eight(a, b) }"
    edited = body.replace("eight", "nine")
    text_ = '"a text that is long enough to be counted here"'
    files = _files(spark, [
        ("Cargo.toml", '[package]\nname = "root"\n[dependencies]\nserde = "1"\nunused-dep = "1"\n'), ("m/Cargo.toml", '[package]\nname = "m"\n[dependencies]\nserde = { path = "../../out" }\nroot = "1"\n'),
        ("src/a.rs", f"use serde::X;\nfn f(a: u8, b: u16, c: u32) {body}\nfn g(a: u8, b: u16, c: u32) {{ p({text_}); p({text_}); }}\n"), ("src/b.rs", f"fn h(a: u8, b: u16, c: u32) {body}\nfn i() {edited}\nfn j() {{ p({text_}); }}\n"),
        ("m/src/lib.rs", "use root::Y;\n"),
    ])
    c = conf.default(REG, everything=True)
    c.rules["toml_cargo_layers"].params = {"rules": ["m/Cargo.toml !> root", "Cargo.toml => serde"]}
    got = sorted((r.rule, r.rel, r.line) for r in engine.workspace(files, REG, c).collect())
    by = lambda rule: [x[1:] for x in got if x[0] == rule]
    assert by("toml_cargo_unused_deps") == [("Cargo.toml", 5), ("m/Cargo.toml", 4)]
    assert by("toml_cargo_layers") == [("Cargo.toml", 5), ("m/Cargo.toml", 5)]
    assert by("toml_cargo_path_deps") == [("m/Cargo.toml", 4)]
    assert by("rust_duplicate_strings") == [("src/a.rs", 3), ("src/b.rs", 3)]
    assert by("rust_param_clump") == [("src/b.rs", 1)]
    assert ("src/b.rs", 1) in by("rust_similar_fns") and by("rust_similar_fns").count(("src/b.rs", 2)) == 1


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2, False), (2, 3, False), (3, 1, False), (3, 4, True), (5, 6, False)], "source long, target long, requires_test boolean")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert sorted(r.node for r in graph.closure(seeds, e).collect()) == [1, 2, 3, 4]
    assert sorted(r.node for r in graph.test_only(seeds, e).collect()) == [4, 5, 6]


def test_incremental_reads_each_file_once(spark, tmp_path):
    c = conf.default(REG)
    seen = []

    def evaluate(files):
        seen.append(files.count())
        return engine.analyze(files, REG, c, ["rust_dbg"])

    one = _files(spark, [("a.rs", "fn a() { dbg!(1); }\n"), ("b.rs", "fn b() {}\n")])
    two = _files(spark, [("a.rs", "fn a() { dbg!(1); }\n"), ("b.rs", "fn b() { dbg!(1); dbg!(2); }\n")])
    key, cache = incremental.base_key(REG, c), str(tmp_path / "cache")
    assert incremental.incremental(one, cache, key, evaluate).count() == 1
    assert incremental.incremental(one, cache, key, evaluate).count() == 1
    assert incremental.incremental(two, cache, key, evaluate).count() == 3
    assert seen == [2, 0, 1]


def test_streamed_files_give_the_same_findings(spark, tmp_path):
    files = _files(spark, [("a.rs", "fn a() { dbg!(1); }\n"), ("b.rs", "fn b() {}\n")])
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    c = conf.default(REG)
    incremental.stream(stream, lambda b: engine.analyze(b, REG, c, ["rust_dbg"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


@pytest.fixture
def tree(tmp_path):
    for rel, text_ in {
        "Cargo.toml": '[package]\nname = "demo"\nversion = "0.1.0"\nedition = "2024"\n', "src/lib.rs": "//! Demo.\n\nfn show() {\n    dbg!(q);\n}\n", ".gitignore": "skip/\n*.gen.rs\n!keep.gen.rs\n",
        "skip/a.rs": "x", "src/x.gen.rs": "x", "src/keep.gen.rs": "//! Kept.\n", "target/b.rs": "x", ".hidden/c.rs": "x", "other/Cargo.toml": "[workspace]\n", "other/d.rs": "x",
    }.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(text_)
    return tmp_path


def test_walk(tree):
    assert corpus.walk(str(tree), ["rs", "toml"]) == ["Cargo.toml", "src/keep.gen.rs", "src/lib.rs"]


def test_command_line(spark, tree, capsys):
    rules = ["--rule", "rust_dbg", "--rule", "rust_style"]
    assert cli.main([str(tree), "--json", *rules], spark=spark) == 1
    doc = json.loads(capsys.readouterr().out)
    assert doc["schema_version"] == 2 and [(f["path"], f["line"], f["column"], f["rule"]) for f in doc["findings"]] == [("src/lib.rs", 4, 5, "rust_dbg")]
    base = str(tree / "base.json")
    assert cli.main([str(tree), "--write-baseline", base, *rules], spark=spark) == 0
    assert cli.main([str(tree), "--baseline", base, *rules], spark=spark) == 0
    assert cli.main([str(tree), "--fix", "--dry-run", *rules], spark=spark) == 1
    assert "-    dbg!(q);" in capsys.readouterr().out
    assert cli.main([str(tree), "--fix", *rules], spark=spark) == 0
    assert (tree / "src/lib.rs").read_text() == "//! Demo.\n\nfn show() {\n    q;\n}\n"
    (tree / "src/lib.rs").write_text("//! Demo.\n\n// #rw(rust_dbg, rust_println) old\nfn f() {\n    g();\n}\n")
    assert cli.main([str(tree), "--clean"], spark=spark) == 0
    assert "#rw" not in (tree / "src/lib.rs").read_text()
    assert cli.main([str(tree), "--init"], spark=spark) == 0 and (tree / "corposieve.toml").exists()
    assert cli.main([str(tree), "--list"]) == 0 and cli.main([str(tree), "--detail", "rust_dbg"]) == 0


def test_longest_prefix_owner(spark):
    files = _files(spark, [("a/b/c.rs", ""), ("a/x.rs", ""), ("z.rs", "")])
    packs = spark.createDataFrame([("root", "", True), ("a", "a", False), ("ab", "a/b", True)], "name string, root string, publishable boolean")
    assert {r.rel: r.package for r in corpus.with_package(files, packs).collect()} == {"a/b/c.rs": "ab", "a/x.rs": "a", "z.rs": "root"}


def test_fused_scan_agrees_with_the_rules(spark):
    from corposieve.operators import linescan

    source = "//! The the start\n//bad\n// ----\n// TODO later\nlet a = 1; \n\tlet b = \"/home/me\";\nlet c = \"http://x FIXME\";\nlet а = 2;\n// ‮ x\n// TODO(me): x XXX\n"
    files = _files(spark, [("a.rs", source)])
    wanted = linescan.rules()
    fused = linescan.scan(corpus.lines(files), wanted).select("rule", "line").collect()
    plain = engine.analyze(files, REG, conf.default(REG), list(wanted)).select("rule", "line").collect()
    assert sorted(map(tuple, fused)) == sorted(map(tuple, plain))


def test_files_of_tests_alone(spark):
    from corposieve.sources import modules

    files = _files(spark, [
        ("src/lib.rs", "mod a;\n#[cfg(test)]\nmod t;\nmod inner { mod deep; }\n"), ("src/a.rs", "mod b;\n"), ("src/a/b.rs", ""), ("src/t.rs", "mod u;\ninclude!(\"gen.rs\");\n"), ("src/t/u.rs", ""),
        ("src/gen.rs", ""), ("src/inner/deep.rs", ""), ("tests/x.rs", ""), ("src/orphan.rs", ""),
    ])
    got = {r.rel for r in modules.classify(files).collect() if r.test_only}
    assert got == {"src/t.rs", "src/t/u.rs", "src/gen.rs", "tests/x.rs"}


def test_example_pack():
    import importlib.util
    from pathlib import Path

    spec = importlib.util.spec_from_file_location("custom_pack", Path(__file__).parents[1] / "examples/custom_pack.py")
    pack = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(pack)
    r = pack.registry().rules["demo_no_sleep"]
    assert list(r.check(RustFile("fn f() { std::thread::sleep(d); }"), dict(r.params)))


def test_param_clump_reads_all_orders(spark, tmp_path):
    from corposieve import queries

    rows = [(k, "N", "O", n) for k in (5, 6, 4000, 5000) for n in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_returnflag string, l_linestatus string, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in queries.param_clump(spark, str(tmp_path)).collect()] == [(4, "N|O|1,N|O|2", 5000)]


def test_workspace_duplicates_looks_at_every_line(spark, tmp_path):
    from corposieve import source_queries

    same = "a line that is long enough to be a literal of its own"
    rows = [(i, f"first {i}\n\n{same}\nlast {i}") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = source_queries.workspace_duplicates(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(f"f{i:012d}.rs", 3) for i in (1, 2)]


def test_rules_over_functions_take_time_in_proportion():
    import time

    source = "//! F.\n\n" + "".join(f"fn f{i}_x(a: u8, b: u16) {{}}\n" + "\n" * (i % 2) for i in range(6000)) + "fn last_x(b: u16, a: u8) {}\n"
    f, config = RustFile(source, "src/f.rs"), conf.default(REG, everything=True)
    rules, began = [REG.rules[k] for k in ("rust_padding", "rust_param_order_consistency")], time.thread_time()
    found = [(x[3], x[1]) for x in engine.file_findings(f, rules, lambda r: dict(r.params))]
    assert time.thread_time() - began < 2  # seconds; comparing all functions with all took over ten times that
    assert found == [("rust_padding", 3 * i + 4) for i in range(3000)] + [("rust_param_order_consistency", 9003)]


def test_param_order_names_the_first_function():
    source = "fn a_x(p: u8) {}\n\nfn b_x(p: u8, q: u8) {}\n\nfn c_x(p: u8, q: u8) {}\n\nfn d_x() {}\n\nfn e_x(q: u8, p: u8) {}\n\nfn f_x(p: u8, q: u8) {}\n"
    found = list(REG.rules["rust_param_order_consistency"].check(RustFile(source), {}))
    assert [(n.name, m) for n, m in found] == [("e_x", "`e_x` and `b_x` order their parameters differently"), ("f_x", "`f_x` and `e_x` order their parameters differently")]


def test_words_signs_and_spaces_are_tokens():
    from corposieve.syntax.lexer import tokenize

    got = [(t.kind, t.text) for t in tokenize("b'x' r#fn\u3000..=<<=\x1cé_1 crate b\"s\" 1..2 x.0/=y")[0]]
    kinds = "char ident punct punct ident ident str num punct num ident punct num punct ident".split()
    assert got == list(zip(kinds, ["b'x'", "r#fn", "..=", "<<=", "é_1", "crate", 'b"s"', "1", "..", "2", "x", ".", "0", "/=", "y"], strict=True))


def test_sources_are_parsed_in_pieces(spark, monkeypatch):
    import pandas as pd

    import corposieve.rules.workspace as ws

    # what the workers run is got hold of and run here, over one large batch
    texts = ["//! F.\n\nfn f() {\n" + '    g("a text");\n' * 4000 + "}\n"] * 60
    batch = pd.DataFrame({"rel": [f"src/f{i}.rs" for i in range(60)], "ext": "rs", "contents": texts, "package": None, "test_only": False})
    got = []
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda self, f, schema: got.append(f) or self)
    files = _files(spark, [("src/f.rs", texts[0])])
    ws.records(files)
    engine.analyze(files, REG, conf.default(REG), ["rust_println"], raw=True)
    monkeypatch.undo()
    assert len(got) == 2 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    alive, parse = [], ws.RustFile
    refs = []

    def parsed(*a):
        f = parse(*a)
        refs.append(weakref.ref(f))
        return f

    monkeypatch.setattr(ws, "RustFile", parsed)
    rows = []
    for out in got[0](iter([batch])):
        rows += out["rel"].tolist()
        alive.append(sum(r() is not None for r in refs))
    assert rows == batch["rel"].tolist()
    assert len(alive) > 3 and max(alive) < 40
    assert len(list(got[1](iter([batch])))) > 3


def test_pieces_keep_all_rows(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(corpus, "PIECE", 10)
    batches = [pd.DataFrame({"contents": x, "n": range(len(x))}) for x in (["a" * 7] * 5 + [None, "", "b" * 95, "c"], [], [None, None])]
    got = [p["n"].tolist() for p in corpus.pieces(iter(batches))]
    assert got == [[0], [1], [2, 3], [4, 5, 6], [7, 8], [0, 1]] and sum(map(len, got)) == 11


def test_suppressions_and_graph_take_whole_tables(spark, tmp_path):
    from corposieve import queries

    events = [(1, 0, "error", 1.0), (2, 0, "click", 1.0), (12, 0, "error", 1.0), (1001, 1, "error", 1.0), (1002, 2, "click", 1.0)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    left = queries.suppression_range_anti(spark, str(tmp_path)).collect()
    assert sorted((r.rel, r.line) for r in left) == [("u0", 1), ("u0", 2), ("u1", 1001), ("u2", 1002)]
    stale = queries.stale_suppressions(spark, str(tmp_path)).collect()
    assert sorted((r.rel, r.line, r.rule) for r in stale) == [("u0", 12, "*"), ("u1", 1001, "error")]
    spark.createDataFrame([(k, k % 25) for k in range(100)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    step, seen = {k: (k * 7 + k % 25) % 100 for k in range(100)}, {1, 2}
    while more := {step[k] for k in seen} - seen:
        seen |= more
    assert {r.node for r in queries.test_closure(spark, str(tmp_path)).collect()} == seen


@pytest.mark.parametrize("rule", [k for k, e in examples().items() if e.fails])
def test_rule_judges_its_examples(rule):
    e, r = examples()[rule], builtin().rules[rule]
    for text, bad in ((e.fails, True), (e.passes, False)):
        f = TomlFile(text, e.path) if e.path.endswith("toml") else RustFile(text, e.path, e.package, False)
        assert bool(list(engine.file_findings(f, [r], lambda r: dict(r.params)))) == bad


def test_every_rule_has_guidance():
    assert set(examples()) == set(builtin().rules)
    assert all(r["guidance"] != r["description"] for r in engine.catalog(builtin()))


def test_crates_are_discovered_from_manifests(spark):
    manifest = '[package]\nname = "{}"\n\n[dependencies]\n{}\n\n[dev-dependencies]\nproptest = "1"\n'
    code = "pub fn f(x: serde_json::Value, y: my_core::Part, z: proptest::Case, w: renamed::Thing) {}\npub use my_core::Part;\npub use chrono::Date;\n"
    files = _files(spark, [
        ("app/Cargo.toml", manifest.format("app", 'serde_json = "1"\nmy-core = { path = "../core" }\nrenamed = { package = "thing", version = "1" }')), ("core/Cargo.toml", manifest.format("my-core", "")),
        ("app/src/part.rs", code), ("core/src/part.rs", code),
    ])
    files = corpus.with_package(files, spark.createDataFrame([("app", "app", True), ("my-core", "core", True)], "name string, root string, publishable boolean"))
    config = engine.discover(files, conf.default(REG))
    got = engine.analyze(files, REG, config, ["rust_pub_api_foreign_types", "rust_foreign_reexports"]).collect()
    assert sorted((r.rel, r.line, r.rule, r.message.split("`")[1]) for r in got) == [
        ("app/src/part.rs", 1, "rust_pub_api_foreign_types", "renamed"), ("app/src/part.rs", 1, "rust_pub_api_foreign_types", "serde_json"),
        ("app/src/part.rs", 3, "rust_foreign_reexports", "chrono"), ("core/src/part.rs", 3, "rust_foreign_reexports", "chrono"),
    ]


def test_strict_configuration_and_flags(spark, tree, capsys):
    with pytest.raises(conf.ConfigError):
        conf.load("[rules.rust_dbg]\nenabled = true\n", REG, strict=True)
    conf.load(conf.render_default(REG), REG, strict=True)
    other = tree / "other.toml"
    other.write_text("[rules.rust_dbg]\nenabled = false\n")
    rules = ["--rule", "rust_dbg"]
    assert cli.main([str(tree), "--config", str(other), *rules], spark=spark) == 0
    with pytest.raises(SystemExit):
        cli.main([str(tree), "--config", str(other), "--strict", *rules], spark=spark)
    capsys.readouterr()
    assert cli.main([str(tree), "--quiet", *rules], spark=spark) == 1 and capsys.readouterr().out == ""
    assert cli.main([str(tree), *rules], spark=spark) == 1
    out = capsys.readouterr().out.split("\n")
    assert out[0].endswith(":") and out[1].startswith("src/lib.rs:4: ") and "rust_dbg" in out[2]
    base = tree / "base.json"
    base.write_text(json.dumps({"schema_version": 1, "findings": [{"rule": "rust_dbg", "path": "src/lib.rs", "message": "m", "count": 1}]}))
    with pytest.raises(SystemExit):
        cli.main([str(tree), "--baseline", str(base), "--baseline-forbid", "rust_dbg", *rules], spark=spark)
    assert cli.main(["--detail", "rust_todo"]) == 0
    assert json.loads(capsys.readouterr().out)["examples"]["fails"].startswith("// TODO")


def test_path_escapes_by_fold(spark):
    rows = [(m, p) for m in ("Cargo.toml", "a/Cargo.toml", "a/b/Cargo.toml") for p in ("x", "../x", "../../x", "..\\..\\..\\x", "./../y/../..", "/abs", "C:/x", "", ".", "a/../../b")]
    got = spark.createDataFrame(rows, "m string, p string").select("m", "p", leaves_root(F.col("m"), F.col("p")).alias("out")).collect()
    assert all(r.out == escapes(r.m, r.p) for r in got) and {r.out for r in got} == {True, False}


def test_islands_over_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    for size in (4, 7):
        monkeypatch.setattr(findings, "BLOCK", size)
        rows = [(g, v) for g in ("a", "b", None) for v in range(-10, 60) if rng.random() < 0.8] + [("a", 3), ("a", 3)]
        want, places = set(), {}
        for g in ("a", "b", None):
            values = {v for h, v in rows if h == g}
            for v in values:
                first = v
                while first - 1 in values:
                    first -= 1
                places[g, v] = (first, v - first + 1)
        want = sorted(((g, v, *places[g, v]) for g, v in rows), key=str)
        got = sorted((tuple(r) for r in findings.islands(spark.createDataFrame(rows, "g string, v long"), ["g"], "v").collect()), key=str)
        assert got == want


def test_closure_by_plain_search(spark):
    import random

    rng = random.Random(4)
    for n, m in ((60, 58), (60, 150), (200, 190)):
        edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        seen, todo = set(), [0, n + 5]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for a, b in edges if a == x]
        got = graph.closure(spark.createDataFrame([(0,), (n + 5,)], "node long"), spark.createDataFrame(edges, "source long, target long"))
        assert {r.node for r in got.collect()} == seen


def test_similar_pairs_by_brute_force(spark):
    import random

    rng, rows = random.Random(5), []
    for i in range(60):
        base = rows[rng.randrange(len(rows))][1] if rows and rng.random() < 0.7 else [rng.randrange(40 if i % 2 else 10**6) for _ in range(rng.randrange(5, 40))]
        s = [x if rng.random() > 0.06 else rng.randrange(10**6) for x in base]
        rows.append((i, s, str(sorted(set(s)))))
    for percent in (60, 85, 100):
        sets = {i: set(s) for i, s, _ in rows if len(set(s)) >= 5}
        first = {}
        for i, _, d in rows:
            if i in sets:
                first.setdefault(d, i)
        reps = sorted(first.values())
        want = {(u, v, len(sets[u] & sets[v]), "near") for u in reps for v in reps if u < v and 100 * len(sets[u] & sets[v]) >= percent * len(sets[u] | sets[v]) and len(sets[u] & sets[v]) >= 5}
        want |= {(first[d], i, len(sets[i]), "exact") for i, _, d in rows if i in sets and first[d] != i}
        got = graph.similar_pairs(spark.createDataFrame(rows, "key long, shingles array<long>, digest string"), percent)
        assert {tuple(r) for r in got.collect()} == want


def test_similar_pairs_moves_heads_of_sets_that_none_resembles(spark, monkeypatch):
    import random

    rng, rows, values, written = random.Random(9), [], [], graph.checkpointed
    for _ in range(300):
        s = rng.sample(range(10**9), 100)
        rows.append((len(rows), s, str(s)))
    rows += [(300, rows[7][1][:93] + [-1, -2], "near"), (301, rows[8][1], rows[8][2])]

    def noted(df):
        out = written(df)
        values.append(sum(r[0] for r in out.select(sum((F.size(c) if t.startswith("array") else F.lit(1) for c, t in out.dtypes), F.lit(0))).collect()))
        return out

    monkeypatch.setattr(graph, "checkpointed", noted)
    got = graph.similar_pairs(spark.createDataFrame(rows, "key long, shingles array<long>, digest string"), 85)
    assert {tuple(r) for r in got.collect()} == {(7, 300, 93, "near"), (8, 301, 100, "exact")}
    assert sum(values) < 0.5 * 100 * len(rows)


def test_similar_pairs_at_the_bound(spark):
    """Pairs that share exactly what they must, or one less, at low and high percentages; the same key may come with two digests."""
    import random

    rng = random.Random(3)
    for percent in (1, 35, 85, 97):
        rows, want = [], set()
        for k in range(0, 80, 2):
            n, m = rng.randrange(5, 120), rng.randrange(5, 120)
            least = max(5, -(-min(n, m) // 10), -(-percent * (n + m) // (100 + percent)))  # 100 c >= percent (n + m - c)
            c = least - rng.randrange(2)
            if c < 0 or c > min(n, m):
                continue
            pool = rng.sample(range(10**12), n + m - c)
            rows += [(k, pool[:n], f"a{k}"), (k + 1, pool[n - c :], f"b{k}")]
            if c >= least:
                want.add((k, k + 1, c, "near"))
        rows += [(1000, list(range(20)), "x"), (1001, list(range(20)), "x"), (1001, list(range(-20, 0)), "y"), (1002, list(range(-20, 0)), "y")]
        want |= {(1000, 1001, 20, "exact"), (1001, 1002, 20, "exact")}
        got = graph.similar_pairs(spark.createDataFrame(rows, "key long, shingles array<long>, digest string"), percent)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_cache_tiers(spark, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    long = "a text of more than forty characters, three times over"
    rows = [(f"src/f{i}.rs", f'//! F.\n\nfn f{i}() {{\n    g("{long}");\n    dbg!({i});\n}}\n') for i in range(4)]
    only = ["rust_dbg", "rust_duplicate_strings"]
    config = conf.default(REG)
    parsed, ran = [], []
    single, rule = engine.analyze, REG.rules["rust_duplicate_strings"]
    monkeypatch.setattr(engine, "analyze", lambda f, *a: parsed.append(f.count()) or single(f, *a))
    reg = Registry()
    reg.rules = REG.rules | {rule.id: replace(rule, check=lambda recs, p: ran.append(1) or rule.check(recs, p))}

    def run(rows):
        got = incremental.check(_files(spark, rows), cache, reg, config, only).collect()
        assert [tuple(r)[:5] for r in got] == [tuple(r)[:5] for r in engine.check(_files(spark, rows), REG, config, only).collect()]
        return len(got)

    monkeypatch.setattr(engine, "check", lambda files, *a: engine.ordered(single(files, *a).unionByName(engine.workspace(files, *a))))
    assert run(rows) == 7 and parsed == [4] and len(ran) == 1
    assert run(rows) == 7 and parsed == [4] and len(ran) == 1  # complete
    rows[0] = (rows[0][0], rows[0][1].replace("dbg!(0)", "h(0)"))
    assert run(rows) == 6 and parsed == [4, 1] and len(ran) == 1  # a file, and no rule across files
    rows[1] = (rows[1][0], rows[1][1].replace("three", "four"))
    assert run(rows) == 5 and parsed == [4, 1, 1] and len(ran) == 2


def test_line_rules_skip_examples_and_registrations():
    code = '//! R.\n\nconst EXAMPLES: &str = "\n// TODO in an example\n";\n\nline_rule! {\n    // TODO in a registration\n}\n\nfn f() {\n    // TODO here\n}\n'
    f = RustFile(code, "src/rule.rs")
    assert not f.errors
    got = [x[1] for x in engine.file_findings(f, [REG.rules["rust_todo"]], lambda r: dict(r.params))]
    assert got == [12]


@pytest.mark.parametrize(("code", "n"), [
    ("// BOUNDS: k is below cells.len().\n    use_it(cells[k]);", 0), ("// BOUNDS: k is below cells.len().\n\n    use_it(cells[k]);", 1), ("// BOUNDS: seen above.\n    use_it(cells[k]);", 1),
    ("// BOUNDS: k fits rows and cells alike.\n    use_it(rows[k]);\n    pause();\n    use_it(cells[k]);", 0), ("if k > 1 {\n        // BOUNDS: k fits cells.\n        pause();\n    }\n    use_it(cells[k]);", 1),
    ("for j in 0..cells.len() { use_it(cells[(j + 2) % cells.len()]); }", 0), ("let at = (0..cells.len()).position(|j| cells[j] > 3);", 0), ("let at = (0..cells.len()).any(|j| rows[j] > 3);", 1),
    ("let at = (0..cells.len()).find(|j| cells[*j] > 3);", 0), ("// BOUNDS: cells is long enough.\n    use_it(&cells[..k]);", 1), ("// BOUNDS: k is below cells.len().\n    use_it(&cells[..k]);", 0),
])
def test_indexing_in_bounds(code, n):
    assert len(found("rust_unchecked_indexing", f"fn f(cells: &[u8], rows: &[u8], k: usize) {{\n    {code}\n}}\n")) == n


def test_wasm_crates_name_their_exports_otherwise():
    code = '#[no_mangle]\npub extern "C" fn go() {}\n'
    assert found("rust_ffi_crate_naming", code, package="app") and not found("rust_ffi_crate_naming", "use wasm_bindgen::JsValue;\n" + code, package="app")


@pytest.mark.parametrize(("text_", "n"), [
    ('[package]\nname = "m"\nrust-version.workspace = true\n', 0), ('[package]\nname = "m"\n', 1), ('[package]\nname = "m"\nrust-version = "1.85"\n', 1), ('[workspace]\nmembers = []\n\n[workspace.package]\nedition = "2024"\n', 1),
])
def test_msrv_of_members(text_, n):
    assert len(check_text("toml_cargo_msrv", text_, "crates/m/Cargo.toml" if "[package]" in text_ else "Cargo.toml")) == n


@pytest.mark.parametrize(("tool", "rel", "n"), [("gcc", "build.rs", 0), ("make", "build.rs", 1), ("make", "crates/zip-sys/build.rs", 0), ("protoc", "crates/zip-sys/build.rs", 1), ("git", "build.rs", 1), ("make", "src/lib.rs", 0)])
def test_tools_of_build_scripts(tool, rel, n):
    assert len(found("rust_build_rs_external_tool", f'fn main() {{ let _ = std::process::Command::new("{tool}").status(); }}\n', rel)) == n


def test_targets_that_manifests_name_are_tests(spark):
    from corposieve.sources import modules

    files = _files(spark, [
        ("a/Cargo.toml", '[package]\nname = "a"\n\n[[test]]\nname = "t"\npath = "checks/t.rs"\n\n[[bench]]\nname = "b"\npath = "src/bin/b.rs"\n'), ("a/src/lib.rs", "mod m;\n"), ("a/src/m.rs", ""),
        ("a/checks/t.rs", "mod deep;\n"), ("a/checks/t/deep.rs", ""), ("a/src/bin/b.rs", ""), ("b/Cargo.toml", "[broken"),
    ])
    got = {r.rel for r in modules.classify(files).collect() if r.test_only}
    assert got == {"a/checks/t.rs", "a/checks/t/deep.rs", "a/src/bin/b.rs"}
