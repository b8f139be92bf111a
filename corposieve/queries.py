"""One query for each generic operator, over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corposieve.functions import globs, text
from corposieve.operators import findings, graph, linescan
from corposieve.sources import corpus

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return corpus.lines(corpus.from_table(corpus.spread(_t(spark, d, "documents"), "doc_id"), "doc_id", "text"))


def line_explode_count(spark, d):
    return _lines(spark, d).groupBy("rel").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def duplicate_adjacent_words(spark, d):
    found = _lines(spark, d).withColumn("word", text.repeated_word(F.col("text"))).where("word is not null")
    return found.select("rel", "line", "word")


_LOOKALIKES = "".join(sorted(c for c in text.confusables()))


def ambiguous_unicode_first(spark, d):
    """The first of all known look-alikes in each line of texts in which two letters were swapped for such."""
    swapped = F.translate("text", "xq", "\u0445\uff51")
    found = _lines(spark, d).withColumn("char", text.first_of(swapped, _LOOKALIKES)).where("char != ''")
    return found.groupBy("char").agg(F.count("*").alias("n_lines"), F.countDistinct("rel").alias("n_files"))


def bidi_controls(spark, d):
    pages = corpus.lines(corpus.from_table(_t(spark, d, "pages"), "page_id", "html"))
    found = _lines(spark, d).unionByName(pages).select(text.first_of(F.col("text"), text.BIDI).alias("char"), text.first_of(F.col("text"), _LOOKALIKES).alias("alike"))
    return found.agg(F.count_if(F.col("char") != "").alias("bidi_lines"), F.count_if(F.col("alike") != "").alias("lookalike_lines"), F.count("*").alias("n_lines"))


def long_lines_per_doc(spark, d):
    return _lines(spark, d).where(F.length("text") > 500).groupBy("rel").agg(F.count("*").alias("n_long"), F.max(F.length("text")).alias("longest"))


def nonblank_line_threshold(spark, d):
    counted = _lines(spark, d).groupBy("rel").agg(F.count_if(text.trim(F.col("text")) != "").alias("nonblank"))
    return counted.where("nonblank > 20")


def duplicate_strings(spark, d):
    found = graph.duplicate_values(_lines(spark, d).withColumn("k", F.col("rel").cast("long")), "text", ["k", "line"], 40, 3)
    return found.select("rel", "line", "occurrences")


def near_dup_shingle_jaccard(spark, d):
    docs = corpus.spread(_t(spark, d, "documents"), "doc_id")
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    grams = F.transform(text.n_grams(words, 5), lambda g: F.xxhash64(g))
    return graph.similar_pairs(docs.select("doc_id", "text"), 85, "doc_id", grams, F.md5(F.col("text").cast("binary")))


def exact_clone_groups(spark, d):
    return graph.clone_groups(_t(spark, d, "documents"), "doc_id", F.md5(F.col("text").cast("binary")))


def param_clump(spark, d):
    baskets = _t(spark, d, "lineitem").select("l_orderkey", F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("param"))
    found = graph.parameter_clumps(baskets, "l_orderkey", "param", 1, 3)
    return found.select("n_items", F.array_join("params", ",").alias("params"), "anchor")


def param_clump_of_three(spark, d):
    """What a customer's nation alone decides comes together; what its segment or region decides doesn't."""
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    given = F.array(F.concat(F.lit("key "), "n_nationkey"), F.concat(F.lit("name "), "n_name"), F.concat(F.lit("low "), F.lower("n_name")), F.concat(F.lit("region "), "n_regionkey"), F.concat(F.lit("segment "), "c_mktsegment"))
    found = graph.parameter_clumps(c.select("c_custkey", F.explode(given).alias("param")), "c_custkey", "param", 3, 3)
    return found.select("n_items", F.array_join("params", ",").alias("params"), "anchor")


def unreferenced_dimension(spark, d):
    part, used = _t(spark, d, "part"), _t(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return graph.unreferenced(part, used, "p_partkey").select("p_partkey", "p_brand")


_EDGES = [("ma*", "deny", ["*a"], []), ("[a-f]*", "allow", ["{asia,europe}", "a*"], []), ("*", "deny", ["e?rope"], [])]


def glob_edge_theta(spark, d):
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("nation"), F.lower("r_name").alias("region"))
    return graph.edge_matches(rows, _EDGES, "nation", ["region"])


def longest_prefix_owner(spark, d):
    urls = _t(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "").alias("path"))
    owners = urls.select(F.substring_index("path", "/", 1).alias("root")).union(urls.select(F.substring_index("path", "/", 2).alias("root"))).groupBy("root").count().where("count >= 3").select("root")
    return corpus.longest_prefix(urls, "path", owners, "root").select("page_id", "root")


def _event_findings(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("rel"), F.col("event_id").cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.col("event_type").alias("rule"), F.concat(F.lit("value "), F.floor(F.col("value") / 10).cast("string")).alias("message"), (F.col("value") > 50).alias("fixable"))


def baseline_multiset_diff(spark, d):
    found = _event_findings(spark, d)
    base = findings.write_baseline(found.where("fixable"))
    return findings.apply_baseline(found, base).select("rel", "line", "rule", "message")


def _event_directives(spark, d):
    e = _event_findings(spark, d).where("rule = 'error'")
    wild = F.col("line") % 2 == 0
    return e.select("rel", "line", (F.col("line") + 400).alias("end_line"), F.when(F.col("line") % 5 == 0, "file").otherwise("block").alias("scope"), F.when(wild, F.array().cast("array<string>")).otherwise(F.array("rule")).alias("rules"), F.create_map().cast("map<string,int>").alias("values"), wild.alias("wildcard"), F.lit("r").alias("reason"), F.lit(None).cast("string").alias("error"))


def suppression_range_anti(spark, d):
    return findings.suppress(_event_findings(spark, d), _event_directives(spark, d)).select("rel", "line", "rule")


def stale_suppressions(spark, d):
    return findings.stale_directives(_event_directives(spark, d), _event_findings(spark, d))


_OVERRIDES = [(["1-*"], 10), (["[12]-*"], 20), (["*-H*"], 30)]


def override_last_match(spark, d):
    o = _t(spark, d, "orders").withColumn("path", F.col("o_orderpriority"))
    o = o.withColumn("threshold", findings.last_match(o, "path", _OVERRIDES, 5))
    return o.groupBy("path", "threshold").agg(F.count("*").alias("n"))


def second_occurrence(spark, d):
    o = _t(spark, d, "orders")
    return o.withColumn("k", F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey"))).where("k > 1").select("o_orderkey", "k")


def first_offender(spark, d):
    c = _t(spark, d, "conversations").withColumn("n", F.length("text"))
    return findings.first_offender(c.select("conv_id", "turn", "n"), ["conv_id"], "turn", "n")


def consecutive_run_islands(spark, d):
    e = _t(spark, d, "events").where("value > 30").select("event_type", "event_id")
    runs = findings.islands(e, ["event_type"], "event_id")
    return runs.groupBy("event_type", "island").agg(F.min("event_id").alias("first"), F.max("place").cast("long").alias("length")).where("length >= 2").select("event_type", "first", "length")


def preceding_context_window(spark, d):
    c = _t(spark, d, "conversations")
    marked = graph.preceding(c, ["conv_id"], "turn", F.length("text") > 80, F.col("role") == "system")
    return marked.where("preceded").select("conv_id", "turn")


def majority_with_tiebreak(spark, d):
    return findings.majority(_t(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber")


def enum_variant_outlier(spark, d):
    p = _t(spark, d, "part").withColumn("low", F.min("p_size").over(Window.partitionBy("p_brand")))
    return p.where("p_size > low + 40").select("p_partkey", "p_brand", "p_size")


def _edges(spark, d):
    s = _t(spark, d, "supplier")
    n = s.agg((F.max("s_suppkey") + 1).alias("n"))
    s = s.crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("source"), ((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % F.col("n")).alias("target"), (F.col("s_suppkey") % 3 == 0).alias("requires_test"))
    return s.where("source != target").distinct()


def test_closure(spark, d):
    seeds = spark.range(1, 3).select(F.col("id").alias("node"))
    return graph.closure(seeds, _edges(spark, d))


def test_only_files(spark, d):
    return graph.test_only(spark.range(1, 3).select(F.col("id").alias("node")), _edges(spark, d))


def hardcoded_url(spark, d):
    p = _t(spark, d, "pages")
    urls = F.expr(r"regexp_extract_all(concat(url, ' ', html), 'https?://[A-Za-z0-9][^\\s<>)\']*', 0)")
    return p.select("page_id", F.size(urls).alias("n_urls")).where("n_urls > 0")


def summary_by_rule(spark, d):
    return findings.summary(_event_findings(spark, d))


_RULES = [("click", "low", "clicks", "none"), ("purchase", "high", "purchases", "look")]


def report_json(spark, d):
    rules = spark.createDataFrame(_RULES, "rule string, severity string, description string, guidance string")
    rows = findings.report_rows(_event_findings(spark, d), F.broadcast(rules))
    return rows.select("id", "path", "line", "rule", "severity", "message", "description", "guidance", "fixable")


def glob_scope(spark, d):
    p = _t(spark, d, "pages").withColumn("path", F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""))
    return p.where(globs.in_scope(F.col("path"), ["*.example.com/**", "**/en/*"], ["blog.*/**"])).select("page_id")


def line_windows(spark, d):
    found = _lines(spark, d).withColumn("k", F.length("text") > 200)
    w = Window.partitionBy("rel").orderBy("line")
    return found.withColumn("before", F.lag("k").over(w)).where("k and before").groupBy("rel").agg(F.count("*").alias("n"))


def fused_line_rules(spark, d):
    pages = corpus.lines(corpus.from_table(_t(spark, d, "pages"), "page_id", "html"))
    talk = corpus.lines(corpus.from_table(_t(spark, d, "conversations").withColumn("k", F.concat_ws(".", "conv_id", "turn")), "k", "text"))
    found = linescan.scan(_lines(spark, d).unionByName(pages).unionByName(talk), linescan.rules(comments=False))
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("rel").alias("files"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        line_explode_count, duplicate_adjacent_words, ambiguous_unicode_first, bidi_controls, long_lines_per_doc, nonblank_line_threshold, duplicate_strings, near_dup_shingle_jaccard,
        exact_clone_groups, param_clump, param_clump_of_three, unreferenced_dimension, glob_edge_theta, longest_prefix_owner, baseline_multiset_diff, suppression_range_anti, stale_suppressions, override_last_match,
        second_occurrence, first_offender, consecutive_run_islands, preceding_context_window, majority_with_tiebreak, enum_variant_outlier, test_closure, test_only_files,
        hardcoded_url, summary_by_rule, report_json, glob_scope, line_windows, fused_line_rules,
    )
}

_L = """
l0 AS (SELECT doc_id::VARCHAR AS rel, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
l1 AS (SELECT rel, unnest(ls) AS text, generate_subscripts(ls, 1) AS line, len(ls) AS n FROM l0),
l AS (SELECT rel, line::INTEGER AS line, text FROM l1 WHERE NOT (line = n AND text = ''))"""
_FOUND = """
f AS (SELECT 'u' || user_id AS rel, event_id::INTEGER AS line, event_type AS rule, 'value ' || floor(value / 10)::BIGINT AS message, value > 50 AS fixable FROM events),
g AS (SELECT rel, line, line + 400 AS end_line, CASE WHEN line % 5 = 0 THEN 'file' ELSE 'block' END AS scope, CASE WHEN line % 2 = 0 THEN '*' ELSE rule END AS rule FROM f WHERE rule = 'error')"""
_COVER = "(g.rule = '*' OR g.rule = f.rule) AND g.rel = f.rel AND (g.scope = 'file' OR (f.line > g.line AND f.line <= g.end_line))"
_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in text.BIDI) + "]"
_ALIKE = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in _LOOKALIKES) + "]"
_WORDS5 = r"list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_GRAPH = """n AS (SELECT max(s_suppkey) + 1 AS n FROM supplier),
e AS (SELECT DISTINCT s_suppkey AS source, (s_suppkey * 7 + s_nationkey) % n AS target, s_suppkey % 3 = 0 AS t FROM supplier, n WHERE s_suppkey <> (s_suppkey * 7 + s_nationkey) % n)"""

ORACLE_SQL: dict[str, str] = {
    "line_explode_count": f"WITH {_L} SELECT rel, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM l GROUP BY rel",
    "duplicate_adjacent_words": f"""WITH {_L}, w AS (SELECT rel, line, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM l),
p AS (SELECT rel, line, unnest(w[:-2]) AS a, unnest(w[2:]) AS b, unnest(range(len(w) - 1)) AS i FROM w WHERE len(w) > 1)
SELECT rel, line, lower(min_by(a, i)) AS word FROM p WHERE lower(a) = lower(b) GROUP BY rel, line""",
    "ambiguous_unicode_first": f"WITH {_L}, c AS (SELECT rel, regexp_extract(translate(text, 'xq', chr(1093) || chr(65361)), '{_ALIKE}') AS char FROM l) SELECT char, count(*) AS n_lines, count(DISTINCT rel) AS n_files FROM c WHERE char <> '' GROUP BY char",
    "bidi_controls": f"""WITH {_L}, p0 AS (SELECT string_split(html, chr(10)) AS ls FROM pages WHERE html <> ''), p1 AS (SELECT unnest(ls) AS text, generate_subscripts(ls, 1) AS line, len(ls) AS n FROM p0),
a AS (SELECT text FROM l UNION ALL SELECT text FROM p1 WHERE NOT (line = n AND text = ''))
SELECT count(*) FILTER (regexp_matches(text, '{_CLASS}')) AS bidi_lines, count(*) FILTER (regexp_matches(text, '{_ALIKE}')) AS lookalike_lines, count(*) AS n_lines FROM a""",
    "long_lines_per_doc": f"WITH {_L} SELECT rel, count(*) AS n_long, max(length(text))::INTEGER AS longest FROM l WHERE length(text) > 500 GROUP BY rel",
    "nonblank_line_threshold": f"WITH {_L} SELECT rel, count(*) AS nonblank FROM l WHERE trim(text) <> '' GROUP BY rel HAVING count(*) > 20",
    "duplicate_strings": f"""WITH {_L}, m AS (SELECT rel, line, count(*) OVER (PARTITION BY text) AS occurrences, row_number() OVER (PARTITION BY text ORDER BY rel::BIGINT, line)::INTEGER AS nth FROM l WHERE length(text) >= 40)
SELECT rel, line, occurrences FROM m WHERE occurrences >= 3 AND nth > 1""",
    "near_dup_shingle_jaccard": f"""WITH w AS (SELECT doc_id, text, {_WORDS5} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS rep, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s WHERE len(s) >= 5 AND doc_id = rep),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS nu, any_value(b.n) AS nv FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT u AS left_key, v AS right_key, c::INTEGER AS shared, 'near' AS kind FROM p WHERE c >= greatest(5, ceil(least(nu, nv) / 10.0)) AND 100 * c >= 85 * (nu + nv - c)
UNION ALL SELECT rep, doc_id, len(s)::INTEGER, 'exact' FROM s WHERE doc_id <> rep AND len(s) >= 5""",
    "exact_clone_groups": "SELECT md5(text) AS digest, min(doc_id) AS first_key, count(*) AS members FROM documents GROUP BY text HAVING count(*) > 1",
    "param_clump": """WITH b AS (SELECT DISTINCT l_orderkey, concat_ws('|', l_returnflag, l_linestatus, l_linenumber::VARCHAR) AS param FROM lineitem),
s AS (SELECT param, list(l_orderkey ORDER BY l_orderkey) AS items FROM b GROUP BY param HAVING count(*) >= 3)
SELECT len(items) AS n_items, string_agg(param, ',' ORDER BY param) AS params, items[-1] AS anchor FROM s GROUP BY items""",
    "param_clump_of_three": """WITH c AS (SELECT c_custkey, unnest(['key ' || n_nationkey, 'name ' || n_name, 'low ' || lower(n_name), 'region ' || n_regionkey, 'segment ' || c_mktsegment]) AS param
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT param, list(DISTINCT c_custkey ORDER BY c_custkey) AS items FROM c GROUP BY param HAVING count(DISTINCT c_custkey) >= 3)
SELECT len(items) AS n_items, string_agg(param, ',' ORDER BY param) AS params, items[-1] AS anchor FROM s GROUP BY items HAVING count(*) >= 3""",
    "unreferenced_dimension": "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "glob_edge_theta": """WITH x AS (SELECT lower(n_name) AS nation, lower(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT nation, region, 'deny' AS verdict, 'ma*' AS edge FROM x WHERE regexp_matches(nation, '^ma[^/]*$') AND regexp_matches(region, '^[^/]*a$')
UNION ALL SELECT nation, region, 'deny', '*' FROM x WHERE regexp_matches(region, '^e[^/]rope$')
UNION ALL SELECT nation, region, 'not_allowed', '[a-f]*' FROM x WHERE regexp_matches(nation, '^[a-f]') AND NOT regexp_matches(region, '^(asia|europe|a[^/]*)$')""",
    "longest_prefix_owner": """WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages),
r AS (SELECT string_split(path, '/')[1] AS root FROM u UNION ALL SELECT array_to_string(string_split(path, '/')[1:2], '/') FROM u),
o AS (SELECT root FROM r GROUP BY root HAVING count(*) >= 3)
SELECT page_id, max_by(root, length(root)) AS root FROM u LEFT JOIN o ON path = root OR starts_with(path, root || '/') GROUP BY page_id""",
    "baseline_multiset_diff": f"""WITH {_FOUND}, b AS (SELECT rel, rule, message, count(*) AS n FROM f WHERE fixable GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY rule, rel, message ORDER BY line) AS k FROM f)
SELECT k.rel, k.line, k.rule, k.message FROM k LEFT JOIN b USING (rel, rule, message) WHERE k > coalesce(n, 0)""",
    "suppression_range_anti": f"WITH {_FOUND} SELECT rel, line, rule FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE {_COVER})",
    "stale_suppressions": f"WITH {_FOUND} SELECT rel, line, scope, rule FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE {_COVER})",
    "override_last_match": "SELECT o_orderpriority AS path, CASE WHEN regexp_matches(o_orderpriority, '^[^/]*-H[^/]*$') THEN 30 WHEN regexp_matches(o_orderpriority, '^[12]-[^/]*$') THEN 20 WHEN regexp_matches(o_orderpriority, '^1-[^/]*$') THEN 10 ELSE 5 END::INTEGER AS threshold, count(*) AS n FROM orders GROUP BY ALL",
    "second_occurrence": "SELECT * FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey)::INTEGER AS k FROM orders) WHERE k > 1",
    "first_offender": "SELECT conv_id, turn, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM (SELECT conv_id, turn, length(text)::INTEGER AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE n < b) WHERE k = 1",
    "consecutive_run_islands": "SELECT event_type, min(event_id) AS first, count(*) AS length FROM (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events WHERE value > 30) GROUP BY event_type, i HAVING count(*) >= 2",
    "preceding_context_window": """WITH c AS (SELECT conv_id, turn, length(text) > 80 AS f, role = 'system' AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, turn FROM c WHERE EXISTS (SELECT 1 FROM c b WHERE b.conv_id = c.conv_id AND b.k BETWEEN c.k - 3 AND c.k - 1 AND b.f AND NOT EXISTS (SELECT 1 FROM c x WHERE x.conv_id = c.conv_id AND x.k BETWEEN b.k AND c.k - 1 AND x.s))""",
    "majority_with_tiebreak": "SELECT l_suppkey, arg_max(l_linenumber, n * 100 - l_linenumber) AS l_linenumber, max(n) AS votes FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey",
    "enum_variant_outlier": "SELECT p_partkey, p_brand, p_size FROM (SELECT *, min(p_size) OVER (PARTITION BY p_brand) AS low FROM part) WHERE p_size > low + 40",
    "test_closure": f"WITH RECURSIVE {_GRAPH}, r(node) AS (SELECT unnest([1, 2])::BIGINT UNION SELECT target FROM r JOIN e ON source = node) SELECT node FROM r",
    "test_only_files": f"WITH RECURSIVE {_GRAPH}, r(node) AS (SELECT unnest([1, 2])::BIGINT UNION SELECT target FROM r JOIN e ON source = node WHERE NOT t) SELECT DISTINCT node FROM (SELECT source AS node FROM e UNION SELECT target FROM e) WHERE node NOT IN (SELECT node FROM r)",
    "hardcoded_url": "SELECT * FROM (SELECT page_id, len(regexp_extract_all(concat(url, ' ', html), 'https?://[A-Za-z0-9][^\\s<>)'']*'))::INTEGER AS n_urls FROM pages) WHERE n_urls > 0",
    "summary_by_rule": f"WITH {_FOUND} SELECT rule, count(*) AS count, count(*) FILTER (fixable) AS fixable, count(DISTINCT rel) AS files FROM f GROUP BY rule",
    "report_json": f"""WITH {_FOUND}, n AS (SELECT *, row_number() OVER (PARTITION BY rule, rel, message ORDER BY line) AS k FROM f),
r AS (SELECT * FROM (VALUES ('click', 'low', 'clicks', 'none'), ('purchase', 'high', 'purchases', 'look')) AS r(rule, severity, description, guidance))
SELECT sha256(strlen(rule) || ':' || rule || strlen(rel) || ':' || rel || strlen(message) || ':' || message || strlen(k::VARCHAR) || ':' || k) AS id, rel AS path, line, rule, coalesce(severity, 'low') AS severity, message,
coalesce(description, '') AS description, coalesce(guidance, '') AS guidance, fixable FROM n LEFT JOIN r USING (rule)""",
    "glob_scope": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages)
SELECT page_id FROM p WHERE (regexp_matches(path, '^[^/]*\.example\.com/.*$') OR regexp_matches(path, '^([^/]+/)*en/[^/]*$')) AND NOT regexp_matches(path, '^blog\.[^/]*/.*$')""",
    "fused_line_rules": f"""WITH p0 AS (SELECT doc_id::VARCHAR AS rel, string_split(text, chr(10)) AS ls FROM documents WHERE text <> '' UNION ALL SELECT page_id::VARCHAR, string_split(html, chr(10)) FROM pages WHERE html <> ''
UNION ALL SELECT conv_id || '.' || turn, string_split(text, chr(10)) FROM conversations WHERE text <> ''),
p1 AS (SELECT rel, unnest(ls) AS text, generate_subscripts(ls, 1) AS line, len(ls) AS n FROM p0),
l AS (SELECT row_number() OVER () AS k, rel, CASE WHEN line < n THEN regexp_replace(text, '\\r$', '') ELSE text END AS text FROM p1 WHERE NOT (line = n AND text = '')),
w AS (SELECT k, rel, list_filter(string_split_regex(text, '[\\s\\p{{Z}}\\x{{85}}]+'), lambda x: x <> '') AS w FROM l),
d AS (SELECT DISTINCT k, rel FROM (SELECT k, rel, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM w WHERE len(w) > 1) WHERE lower(a) = lower(b)),
f AS (SELECT rel, 'rust_style' AS rule FROM l WHERE regexp_matches(text, '[\\s\\p{{Z}}\\x{{85}}]$') UNION ALL SELECT rel, 'rust_style' FROM l WHERE contains(text, chr(9)) UNION ALL SELECT rel, 'rust_style' FROM l WHERE contains(text, chr(13))
UNION ALL SELECT rel, 'rust_duplicate_words' FROM d UNION ALL SELECT rel, 'rust_todo' FROM l, (VALUES ('TODO'), ('FIXME'), ('HACK'), ('XXX')) AS v(w) WHERE regexp_matches(text, w || '($|[^(])')
UNION ALL SELECT rel, 'rust_ambiguous_unicode' FROM l WHERE regexp_matches(text, '{_ALIKE}') UNION ALL SELECT rel, 'rust_bidirectional_unicode' FROM l WHERE regexp_matches(text, '{_CLASS}')
UNION ALL SELECT rel, 'rust_abs_home_path' FROM l WHERE contains(text, '"') AND regexp_matches(text, '/Users/|/home/|C:\\\\{{1,2}}Users\\\\{{1,2}}') AND NOT regexp_matches(text, '^\\s*//')
UNION ALL SELECT rel, 'rust_banner_comments' FROM l WHERE regexp_matches(text, '^\\s*//([^/!]|$)') AND regexp_matches(text, '^\\s*//[\\s\\-=*#~_]*[-=*#~_]{{4}}[\\s\\-=*#~_]*$') UNION ALL SELECT rel, 'rust_comment_space' FROM l WHERE regexp_matches(text, '^\\s*//[^ /!#\\[]'))
SELECT rule, count(*) AS n, count(DISTINCT rel) AS files FROM f GROUP BY rule""",
    "line_windows": f"WITH {_L} SELECT rel, count(*) AS n FROM (SELECT rel, length(text) > 200 AS k, lag(length(text) > 200) OVER (PARTITION BY rel ORDER BY line) AS b FROM l) WHERE k AND b GROUP BY rel",
}
