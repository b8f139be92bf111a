"""All builtin rules."""

from __future__ import annotations

from corposieve.rules import api, complexity, correctness, docs, hygiene, interop, lines, manifests, performance, safety, style, workspace
from corposieve.rules.base import BUILTIN, Registry

MODULES = (api, complexity, correctness, docs, hygiene, interop, lines, manifests, performance, safety, style, workspace)


def builtin() -> Registry:
    out = Registry()
    out.rules = dict(sorted(BUILTIN.rules.items()))
    return out
