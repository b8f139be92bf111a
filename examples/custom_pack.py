"""A rule pack of one's own: run ``python examples/custom_pack.py ROOT``."""

from __future__ import annotations

import sys

from corposieve import cli
from corposieve.rules.base import Rule, in_test
from corposieve.rules.catalog import builtin


def no_sleep(file, params):
    for call in file.of("CallExpr"):
        if call.callee.compact.endswith("sleep") and len(call.args) <= params["most_args"] and not in_test(call):
            yield call, "code sleeps"


PACK = [Rule("demo_no_sleep", "rust-ast", "medium", "Code doesn't sleep.", no_sleep, params={"most_args": 1}, pack="demo")]


def registry():
    out = builtin()
    out.extend("demo", "1.0.0", "demo-1", PACK)
    return out


if __name__ == "__main__":
    sys.exit(cli.main(registry=registry()))
