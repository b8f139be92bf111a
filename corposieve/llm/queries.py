"""Queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corposieve.llm import decontaminate, license_scan, line_dedup, lm_score, mixing, near_dup, quality_model, quality_rules, sharding, warc
from corposieve.llm._common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup(table(spark, sf_dir, "documents"), size=2, percent=80)


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_model.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("host").alias("source"), F.col("path").alias("lang"), "evidence", "host_rate", "path_rate", "p_quality", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_near_dup, op3_quality_model, op4_quality_rules, op5_lm_score, op6_license_scan, op7_mixing, op8_decontaminate, op9_sharding, op10_warc)
}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t),
k AS (SELECT *, {_FOLD.format(f"trim(line, {_BLANK})")} AS key FROM l),
s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, s.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, max(n)::BIGINT AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op2_near_dup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLD.format("text"))} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
  ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS nu, any_value(b.n) AS nv
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
k AS MATERIALIZED (SELECT u, v FROM p WHERE 100 * c >= 80 * (nu + nv - c)),
r(node, seen) AS (SELECT u, v FROM k UNION SELECT r.node, k.v FROM r JOIN k ON r.seen = k.u),
c AS (SELECT node, min(seen) AS low FROM r GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM s LEFT JOIN c ON doc_id = node""",
    "op4_quality_rules": f"""
WITH w AS MATERIALIZED (SELECT doc_id, source, text, {_WORDS.format("text")} AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, sum(c - 1)::BIGINT AS n FROM (
  SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(ls) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM g),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM h),
q AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS o FROM d WHERE c > 1) GROUP BY 1),
b AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN q USING (doc_id)),
f AS (SELECT *, n_words < 20 AS few, 100 * n_repeat_words > 30 * n_words AS rep FROM b),
o AS (SELECT source, count(*) AS n, [count(*) FILTER (few), count(*) FILTER (rep), count(*) FILTER (10 * n_symbols > n_words), count(*) FILTER (n_dup_lines >= 3),
  count(*) FILTER (word_chars < 3 * n_words OR word_chars > 12 * n_words)] AS fs FROM f GROUP BY source),
x AS (SELECT source, n::DOUBLE AS n, unnest(fs)::DOUBLE AS f, unnest(range(1, 6)) AS rule FROM o),
m AS (SELECT rule, sum(f) / sum(n) AS mean, sum(n) AS total, count(*) AS k FROM x GROUP BY rule),
v AS (SELECT rule, any_value(mean) AS mean, sum(n * (f / n - mean) ** 2) / any_value(total) - any_value(mean * (1 - mean) * k / total) AS between_ FROM x JOIN m USING (rule) GROUP BY rule),
c AS (SELECT rule, mean, CASE WHEN mean > 0 AND mean < 1 AND between_ > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / between_ - 1)) ELSE 1e6 END AS weight FROM v),
z AS (SELECT source, max((f + mean * weight) / (n + weight)) AS host_rate FROM x JOIN c USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR rep AS base_failed, NOT (few OR rep) AND host_rate <= 0.5 AS kept
FROM f JOIN z ON f.source IS NOT DISTINCT FROM z.source""",
    "op7_mixing": """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS rows, sum(sqrt(n)) AS total FROM n),
r AS (SELECT source, rows * sqrt(n) / total / n AS rate FROM n, t),
p AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM p WHERE k < ceil(rate + 10 * sqrt(rate) + 30)),
u AS (SELECT *, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '-') || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
d AS (SELECT u.* EXCLUDE (u), (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.c <= u.u) AS times FROM u)
SELECT * EXCLUDE (times), unnest(range(1, times + 1))::INTEGER AS copy FROM d""",
    "op8_decontaminate": r"""
WITH w AS MATERIALIZED (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS MATERIALIZED (SELECT item_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
m AS (SELECT * FROM (VALUES (1, [0, 1, 3, 6, 7]), (2, [0, 2, 3, 4, 8]), (3, [0, 1, 2, 4, 5])) AS m(mask, o)),
i AS (SELECT id, mask, o, unnest(range(0, greatest(0, len(w) - o[5]))) AS i, w FROM w, m),
j AS (SELECT id, mask, o, unnest(range(0, greatest(0, len(w) - o[5]))) AS i, w FROM b, m),
sw AS (SELECT id, i, mask, w[i + o[1] + 1] || ' ' || w[i + o[2] + 1] || ' ' || w[i + o[3] + 1] || ' ' || w[i + o[4] + 1] || ' ' || w[i + o[5] + 1] AS s FROM i),
sb AS (SELECT id, i, mask, w[i + o[1] + 1] || ' ' || w[i + o[2] + 1] || ' ' || w[i + o[3] + 1] || ' ' || w[i + o[4] + 1] || ' ' || w[i + o[5] + 1] AS s FROM j),
h AS (SELECT DISTINCT sw.id AS doc_id, sb.id AS item_id, sw.i - sb.i AS d FROM sw JOIN sb USING (mask, s)),
f AS (SELECT h.*, unnest(range(greatest(0, -d), least(len(b.w), len(w.w) - d))) AS j, w.w AS dw, b.w AS bw FROM h JOIN w ON w.id = doc_id JOIN b ON b.id = item_id),
e AS (SELECT doc_id, item_id, d, j, least(10, ceil(len(bw) * 10 / 12)) AS least_, (bw[j + 1] = dw[j + d + 1])::INTEGER AS eq FROM f),
s AS (SELECT doc_id, item_id, least_, sum(eq) OVER (PARTITION BY doc_id, item_id, d ORDER BY j ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS equal_ FROM e),
-- items of fewer than 12 words that a text holds whole
n AS (SELECT id AS item_id, len(w) AS k, array_to_string(w, ' ') AS s FROM b WHERE len(w) BETWEEN 1 AND 11),
t AS (SELECT id AS doc_id, n.item_id, n.k AS equal_ FROM w, n WHERE contains(' ' || array_to_string(w.w, ' ') || ' ', ' ' || n.s || ' ')),
x AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, max(equal_) AS equal_words FROM (SELECT doc_id, item_id, equal_ FROM s WHERE equal_ >= least_ UNION ALL SELECT * FROM t) GROUP BY doc_id)
SELECT d.doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(equal_words, 0)::BIGINT AS equal_words
FROM documents d LEFT JOIN x USING (doc_id)""",
    "op9_sharding": r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT r.range AS i,
  list_reduce(list_prepend(r.range, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r)),
-- CRC-32 is linear: what a byte's bits, the register's first value and each of its bits become after d more zero bytes
far(d, a) AS (SELECT 0, list_concat(list_transform(range(8), lambda b: t[(1 << b)::INTEGER + 1]), [4294967295], list_transform(range(32), lambda b: (1::BIGINT << b)::BIGINT)) FROM tab
  UNION ALL SELECT d + 1, list_transform(a, lambda s: xor(s >> 8, t[(s & 255)::INTEGER + 1])) FROM far, tab WHERE d < 256),
hop AS (SELECT a[10:41] AS c FROM far WHERE d = 256),
-- the register's bits after q more blocks of 256 bytes
pow(q, m) AS (SELECT 0, a[10:41] FROM far WHERE d = 0
  UNION ALL SELECT q + 1, list_transform(m, lambda s: list_reduce(list_transform(range(32), lambda j: CASE WHEN (s >> j) & 1 = 1 THEN c[j + 1] ELSE 0 END), lambda x, y: xor(x, y)))
  FROM pow, hop WHERE q < (SELECT coalesce(max(strlen(text)), 0) // 256 FROM documents)),
x AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
-- blocks of 256 bytes from the end
p0 AS (SELECT r, hex(encode(text)) AS h, strlen(text) AS n FROM x),
p1 AS (SELECT r, q, substr(h, greatest(0, 2 * (n - 256 * (q + 1))) + 1, 2 * least(256, n - 256 * q)) AS h, least(256, n - 256 * q) AS m
  FROM (SELECT *, unnest(range(0, (n + 255) // 256)) AS q FROM p0)),
z AS (SELECT r, q, m - 1 - i AS d, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS v FROM (SELECT *, unnest(range(0, m)) AS i FROM p1)),
c0 AS (SELECT r, q, bit_xor(xor(xor(xor(CASE WHEN v & 1 > 0 THEN a[1] ELSE 0 END, CASE WHEN v & 2 > 0 THEN a[2] ELSE 0 END), xor(CASE WHEN v & 4 > 0 THEN a[3] ELSE 0 END, CASE WHEN v & 8 > 0 THEN a[4] ELSE 0 END)),
  xor(xor(CASE WHEN v & 16 > 0 THEN a[5] ELSE 0 END, CASE WHEN v & 32 > 0 THEN a[6] ELSE 0 END), xor(CASE WHEN v & 64 > 0 THEN a[7] ELSE 0 END, CASE WHEN v & 128 > 0 THEN a[8] ELSE 0 END)))) AS s
  FROM z JOIN far USING (d) GROUP BY r, q
  UNION ALL SELECT r, strlen(text) // 256, a[9] FROM x JOIN far ON d = strlen(text) % 256),
c AS (SELECT r, bit_xor(CASE WHEN (s >> j) & 1 = 1 THEN m[j + 1] ELSE 0 END) AS c FROM (SELECT r, s, m, unnest(range(0, 32)) AS j FROM c0 JOIN pow USING (q)) GROUP BY r),
k AS (SELECT doc_id, source, strlen(text)::BIGINT + 8 AS size, xor(c, 4294967295)::BIGINT AS text_crc32, md5('shard:' || coalesce(doc_id::VARCHAR, '-')) AS key FROM x JOIN c USING (r)),
m AS (SELECT source AS of_source, n, list_filter(range(a, a + 100), lambda x: gcd(x, n) = 1)[1] AS step
  FROM (SELECT source, count(*) AS n, greatest(1, round(count(*) * 0.6180339887498949)::BIGINT) AS a FROM k GROUP BY source)),
i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size, text_crc32) - 1 AS i FROM k),
o AS (SELECT i.*, (2 * (i.i::HUGEINT * step % n)::BIGINT + 1)::DOUBLE / (2 * n)::DOUBLE AS f FROM i JOIN m ON i.source IS NOT DISTINCT FROM of_source),
p AS (SELECT *, row_number() OVER (ORDER BY f, key, source NULLS FIRST, doc_id NULLS FIRST, size, text_crc32) - 1 AS pos, count(*) OVER () AS total FROM o)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 24 // total)::INTEGER AS shard, (pos - ((pos * 24 // total) * total + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source FROM p""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS origin FROM p),
b AS (SELECT *, ('0x' || substr(s, 5 * q + 1, 5))::BIGINT AS v, q FROM d, range(8) AS r(q)),
e AS (SELECT *, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31)::INTEGER + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31)::INTEGER + 1, 1)
  || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31)::INTEGER + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31)::INTEGER + 1, 1) AS x FROM b)
SELECT page_id, any_value(n) AS payload_bytes, string_agg(x, '' ORDER BY q) AS payload_digest,
  CASE WHEN page_id = any_value(origin) THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> any_value(origin) THEN any_value(origin) END AS refers_to
FROM e GROUP BY page_id""",
}
