"""Configuration: which rules run where, with which parameters."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from corposieve.functions.globs import glob_regex
from corposieve.rules.base import Registry, Rule


class ConfigError(ValueError):
    pass


@dataclass
class RuleConfig:
    enabled: bool
    only: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    params: dict[str, object] = field(default_factory=dict)
    overrides: list[tuple[list[str], dict[str, object]]] = field(default_factory=list)


@dataclass
class Config:
    rules: dict[str, RuleConfig]
    allow_suppressions: bool = True
    forbid_baseline: list[str] = field(default_factory=list)
    cache_inputs: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    #: rule -> package (None: all) -> parameter -> values that the workspace itself adds to a list
    discovered: dict[str, dict[str | None, dict[str, list[str]]]] = field(default_factory=dict)

    def applies(self, rule: str, rel: str) -> bool:
        c = self.rules[rule]
        return c.enabled and (not c.only or _any(rel, c.only)) and not _any(rel, c.ignore)

    def params(self, rule: Rule, rel: str, package: str | None = None) -> dict[str, object]:
        """Defaults, then the rule's own values, then each override whose globs match: the last one wins; discovered values are added."""
        c = self.rules[rule.id]
        out = dict(rule.params) | c.params
        for globs, values in c.overrides:
            if _any(rel, globs):
                out |= values
        for scope in dict.fromkeys((None, package)) if rule.id in self.discovered else ():
            for k, more in self.discovered.get(rule.id, {}).get(scope, {}).items():
                out[k] = list(dict.fromkeys([*out[k], *more]))
        return out


_cache: dict[str, re.Pattern[str] | None] = {}


def _any(rel: str, globs: list[str]) -> bool:
    for g in globs:
        if g not in _cache:
            r = glob_regex(g)
            _cache[g] = re.compile(r) if r else None
        if _cache[g] is not None and _cache[g].match(rel):
            return True
    return False


def _check(rule: Rule, name: str, value: object, where: str) -> object:
    if name not in rule.params:
        raise ConfigError(f"{where}: {rule.id} has no parameter {name}")
    want = rule.params[name]
    ok = isinstance(value, bool) if isinstance(want, bool) else isinstance(value, int) and not isinstance(value, bool) and value >= 0 if isinstance(want, int) else isinstance(value, list) and all(isinstance(x, str) for x in value)
    if not ok:
        raise ConfigError(f"{where}: {name} of {rule.id} has the wrong type")
    if isinstance(value, list) and len(set(value)) != len(value):
        raise ConfigError(f"{where}: {name} of {rule.id} repeats a value")
    return value


def load(text: str, registry: Registry, strict: bool = False) -> Config:
    """Parse, resolve glob sets (``@name``) and validate; unknown rules are errors, rules not named keep their default.

    ``strict``: a rule that isn't named is an error.
    """
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    sets = doc.get("glob_sets", {})

    def globs(value: object, where: str, seen: tuple[str, ...] = ()) -> list[str]:
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            raise ConfigError(f"{where} must be a list of globs")
        out = []
        for g in value:
            if g.startswith("@"):
                name = g[1:]
                if name not in sets:
                    raise ConfigError(f"{where} names an unknown glob set {name}")
                if name in seen:
                    raise ConfigError(f"glob set {name} holds itself")
                out += globs(sets[name], f"glob set {name}", (*seen, name))
            elif glob_regex(g) is None:
                raise ConfigError(f"{where} has a malformed glob {g}")
            else:
                out.append(g)
        return out

    unknown = set(doc) - {"allow_suppressions", "cache_inputs", "glob_sets", "rules", "forbid_baseline"}
    if unknown:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    rules = {r.id: RuleConfig(r.default) for r in registry.rules.values()}
    warnings = []
    for name, c in doc.get("rules", {}).items():
        if name not in registry.rules:
            raise ConfigError(f"unknown rule {name}")
        r, own = registry.rules[name], rules[name]
        for key, value in c.items():
            if key == "enabled":
                if not isinstance(value, bool):
                    raise ConfigError(f"enabled of {name} must be a bool")
                own.enabled = value
            elif key in ("only", "ignore"):
                setattr(own, key, globs(value, f"{key} of {name}"))
            elif key == "overrides":
                for o in value:
                    o = dict(o)
                    paths = globs(o.pop("paths", None), f"overrides of {name}")
                    own.overrides.append((paths, {k: _check(r, k, v, "override") for k, v in o.items()}))
            else:
                own.params[key] = _check(r, key, value, "rules")
        if not own.enabled and len(c) > 1:
            warnings.append(f"{name} is off, so its other settings have no effect")
    if strict:
        missing = sorted(set(registry.rules) - set(doc.get("rules", {})))
        if missing:
            raise ConfigError(f"rules without an entry: {', '.join(missing)}")
    return Config(rules, bool(doc.get("allow_suppressions", True)), list(doc.get("forbid_baseline", [])), list(doc.get("cache_inputs", [])), warnings)


def default(registry: Registry, everything: bool = False) -> Config:
    return Config({r.id: RuleConfig(everything or r.default) for r in registry.rules.values()})


def render_default(registry: Registry) -> str:
    """A configuration file that states every default."""
    out = ["allow_suppressions = true", "cache_inputs = []", ""]
    for r in registry.rules.values():
        out += [f"[rules.{r.id}]", f"enabled = {str(r.default).lower()}"]
        for k, v in r.params.items():
            out.append(f"{k} = " + (str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "[" + ", ".join(f'"{x}"' for x in v) + "]"))
        out.append("")
    return "\n".join(out)
