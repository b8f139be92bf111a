"""Operators over findings: suppression, stale directives, baseline, summaries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covers(f_line: Column, start: Column, end: Column, scope: Column) -> Column:
    return (scope == "file") | ((f_line > start) & (f_line <= end))


def _targets(directives: DataFrame) -> DataFrame:
    """One row a directive and rule (or ``*``), valued targets left out of file scope."""
    d = directives.where("error is null").withColumn("_id", F.struct("rel", "line", "scope"))
    exploded = d.select(F.col("rel").alias("_rel"), F.col("line").alias("_start"), F.col("end_line").alias("_end"), F.col("scope").alias("_scope"), "values", F.explode(F.when(F.col("wildcard"), F.array(F.lit("*"))).otherwise(F.col("rules"))).alias("_rule"))
    valued = F.array_contains(F.map_keys(F.coalesce("values", F.create_map().cast("map<string,int>"))), F.col("_rule"))
    return exploded.withColumn("_valued", valued)


def suppress(findings: DataFrame, directives: DataFrame, workspace: bool = False) -> DataFrame:
    """Findings that no directive of their file covers.

    An anti join on file and rule (a wildcard directive joins every rule: two equi-joins rather than a disjunction,
    which would make a nested loop). ``workspace``: valued file targets suppress too.
    """
    t = _targets(directives)
    if not workspace:
        t = t.where(~((F.col("_scope") == "file") & F.col("_valued")))
    hit = covers(F.col("line"), F.col("_start"), F.col("_end"), F.col("_scope"))
    by_rule = (F.col("rel") == F.col("_rel")) & (F.col("rule") == F.col("_rule")) & hit
    by_all = (F.col("rel") == F.col("_rel")) & hit
    return findings.join(t.where("_rule != '*'"), by_rule, "left_anti").join(t.where("_rule = '*'"), by_all, "left_anti")


def stale_directives(directives: DataFrame, raw: DataFrame) -> DataFrame:
    """``rel, line, scope, rule`` of directive targets that cover no raw finding."""
    t = _targets(directives)
    f = raw.select(F.col("rel").alias("f_rel"), F.col("line").alias("f_line"), F.col("rule").alias("f_rule"))
    hit = covers(F.col("f_line"), F.col("_start"), F.col("_end"), F.col("_scope"))
    named = t.where("_rule != '*'").join(f, (F.col("_rel") == F.col("f_rel")) & (F.col("_rule") == F.col("f_rule")) & hit, "left_anti")
    wild = t.where("_rule = '*'").join(f, (F.col("_rel") == F.col("f_rel")) & hit, "left_anti")
    return named.union(wild).select(F.col("_rel").alias("rel"), F.col("_start").alias("line"), F.col("_scope").alias("scope"), F.col("_rule").alias("rule"))


def write_baseline(findings: DataFrame) -> DataFrame:
    """``rule, path, message, count``."""
    return findings.groupBy("rule", F.col("rel").alias("path"), "message").agg(F.count("*").alias("count"))


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings beyond a baseline's counts: of each (rule, path, message) the first ``count`` are absorbed."""
    allowed = baseline.groupBy(F.col("rule").alias("_r"), F.col("path").alias("_p"), F.col("message").alias("_m")).agg(F.sum("count").alias("_allowed"))
    ranked = findings.withColumn("_k", F.row_number().over(Window.partitionBy("rule", "rel", "message").orderBy("line", F.col("column").asc_nulls_first())))
    joined = ranked.join(allowed, (F.col("rule") == F.col("_r")) & (F.col("rel") == F.col("_p")) & (F.col("message") == F.col("_m")), "left")
    return joined.where(F.col("_k") > F.coalesce("_allowed", F.lit(0))).select(*findings.columns)


def summary(findings: DataFrame) -> DataFrame:
    """Rules by number of findings, with those a fix exists for and the files they are in."""
    return findings.groupBy("rule").agg(F.count("*").alias("count"), F.count_if("fixable").alias("fixable"), F.countDistinct("rel").alias("files")).orderBy(F.desc("count"), "rule")


def finding_id(rule: Column, path: Column, message: Column, nth: Column) -> Column:
    """An id that moves with the finding: a digest of length-prefixed rule, path, message and occurrence."""
    parts = [F.concat(F.octet_length(c).cast("string"), F.lit(":"), c) for c in (rule, path, message, nth.cast("string"))]
    return F.sha2(F.concat(*parts), 256)


def report_rows(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of the JSON report, joined with ``rules`` (rule, severity, description, guidance)."""
    nth = F.row_number().over(Window.partitionBy("rule", "rel", "message").orderBy("line", "column"))
    joined = findings.withColumn("_n", nth).join(rules, "rule", "left")
    return joined.select(
        finding_id(F.col("rule"), F.col("rel"), F.col("message"), F.col("_n")).alias("id"), F.col("rel").alias("path"), "line", "column", "rule",
        F.coalesce("severity", F.lit("low")).alias("severity"), "message", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("guidance", F.lit("")).alias("guidance"), "fixable",
    ).orderBy("path", "line", "rule", "message")


def report_json(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """One JSON object a finding; a file of them with a ``schema_version`` head is the report."""
    rows = report_rows(findings, rules)
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def majority(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group; ties go to the least."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*group).agg(F.max_by(F.struct(value, "_n"), F.struct("_n", (-F.col(value)).alias("_v"))).alias("_b")).select(*group, F.col(f"_b.{value}").alias(value), F.col("_b._n").alias("votes"))


#: ``order`` values to a block, for ``islands``.
BLOCK = 1 << 16


def islands(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """``df`` with ``island``, the first ``order`` value of the run of values following one another that a row is in; and its ``place`` in it, from 1.

    Rows of equal values share a place. A window sees one block of values of a group, so that a group of a third of all rows is
    dealt out; runs that go on over the end of a block are joined by a window over blocks, a row each.
    """
    block = F.floor(F.col(order) / BLOCK)
    w = Window.partitionBy(*group, "_block").orderBy(order)
    before = F.lag(order).over(w)
    rows = df.withColumn("_block", block).withColumn("_new", F.when(before.isNull() | (F.col(order) - before > 1), F.col(order)))
    rows = rows.withColumn("_first", F.max("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.groupBy(*group, "_block").agg(F.min(order).alias("_low"), F.max(order).alias("_high"), F.max("_first").alias("_last"))
    over = Window.partitionBy(*(F.col(c) for c in group)).orderBy("_block")
    goes_on = (F.col("_low") == F.col("_block") * BLOCK) & (F.lag("_high").over(over) == F.col("_block") * BLOCK - 1)
    blocks = blocks.withColumn("_on", F.coalesce(goes_on, F.lit(False)))
    own = F.when(~F.col("_on") | (F.col("_last") != F.col("_low")), F.col("_last"))  # where the run at the block's end began, if within it
    blocks = blocks.withColumn("_from", F.last(own, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    carried = blocks.where("_on").select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_block").alias("_b"), F.col("_low").alias("_l"), "_from")
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]
    match = (F.col("_block") == F.col("_b")) & (F.col("_first") == F.col("_l"))
    for x in same:
        match = match & x
    out = rows.join(carried, match, "left").withColumn("island", F.coalesce("_from", "_first"))
    return out.withColumn("place", F.col(order) - F.col("island") + 1).select(*df.columns, "island", "place")


def first_offender(df: DataFrame, group: list[str], order: str, key: str) -> DataFrame:
    """The first row of each group whose key is less than the one before it."""
    w = Window.partitionBy(*group).orderBy(order)
    bad = df.withColumn("_before", F.lag(key).over(w)).where(F.col(key) < F.col("_before"))
    return bad.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_before")


def last_match(df: DataFrame, path: str, overrides: list[tuple[list[str], object]], base: object) -> Column:
    """A parameter at a path: the last override whose globs match, else ``base``."""
    from corposieve.functions.globs import matches_any

    out = F.lit(base)
    for globs, value in overrides:
        out = F.when(matches_any(F.col(path), globs), F.lit(value)).otherwise(out)
    return out
