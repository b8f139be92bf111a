"""Explicit schemas of the engine's tables, and the order of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame

FILES = "rel string, ext string, contents string, package string, publishable boolean, test_only boolean"
LINES = "rel string, line int, text string"
FINDINGS = "rel string, line int, column int, rule string, message string, fixable boolean"
DIRECTIVES = "rel string, line int, end_line int, scope string, rules array<string>, values map<string,int>, wildcard boolean, reason string, error string"
EDITS = "rel string, start_line int, end_line int, replacement string, rule string, seq long"
BASELINE = "schema_version int, findings array<struct<rule:string,path:string,message:string,count:bigint>>"
SEVERITIES = ("low", "medium", "high")
KINDS = ("rust-line", "rust-ast", "rust-workspace", "toml", "workspace")
ORDER = ("rel", "line", "rule", "message")


def ordered(findings: DataFrame) -> DataFrame:
    """The total order of a report."""
    return findings.orderBy(*ORDER)
