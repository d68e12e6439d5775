"""Rule and configuration files: strict schemas, overrides and lint, all on the driver."""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any

import yaml

from ..functions.fields import known
from ..functions.patterns import PatternError, java_pattern
from ..schema import SEVERITIES

PACK = Path(__file__).with_name("pack.yaml")
UNSET = object()
OPERATORS = ("exists", "length", "range", "equals", "notEquals", "matches", "notMatches", "oneOf", "contains", "sameHost", "stableAcrossRender")
_CHECK_KEYS = {"field", "all", "any", "not", *OPERATORS}
SITE_CHECKS = {"brokenLinks": ("internal", "external"), "blockedLinks": ("external",), "redirectingLinks": ("internal",), "canonicalTarget": ("ok",), "hreflang": ("valid", "x-default"), "orphans": ("sitemap",), "missingFromSitemap": (True,)}


class RuleError(ValueError):
    """All problems of the rule files together."""

    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Range:
    min: float | None = None
    max: float | None = None

    def text(self) -> str:
        if self.min is None:
            return f"at most {self.max:g}"
        return f"at least {self.min:g}" if self.max is None else f"{self.min:g} to {self.max:g}"


@dataclass(frozen=True)
class Check:
    field: str | None = None
    operators: dict[str, Any] = dataclasses.field(default_factory=dict)
    all: tuple[Check, ...] | None = None
    any: tuple[Check, ...] | None = None
    negated: Check | None = None


@dataclass(frozen=True)
class Applies:
    path: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    status: Range = Range(200, 299)
    html: bool = True
    indexable: bool | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    scope: str
    check: Check | tuple[str, Any]
    severity: str = "warning"
    description: str = ""
    applies: Applies = Applies()
    message: str | None = None
    enabled: bool = True
    source: str = "effective"
    when: Check | None = None


@dataclass
class RuleSet:
    rules: list[Rule]
    plugins: list[Any] = dataclasses.field(default_factory=list)
    warnings: list[str] = dataclasses.field(default_factory=list)


def _strict(value: Any, keys: set[str], where: str, problems: list[str]) -> dict:
    if not isinstance(value, dict):
        problems.append(f"{where}: expected a mapping")
        return {}
    problems += [f"{where}: unknown key {k!r}" for k in value if k not in keys]
    return value


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def parse_range(value: Any, where: str, problems: list[str]) -> Range:
    found = _strict(value, {"min", "max"}, where, problems)
    problems += [f"{where}.{k}: expected a number" for k in ("min", "max") if k in found and not _number(found[k])]
    if not {"min", "max"} & found.keys():
        problems.append(f"{where}: give min or max")
    return Range(*(found.get(k) if _number(found.get(k)) else None for k in ("min", "max")))


def parse_check(value: Any, where: str, problems: list[str]) -> Check:
    found = _strict(value, _CHECK_KEYS, where, problems)
    operators: dict[str, Any] = {}
    for key in OPERATORS:
        if key not in found:
            continue
        given = found[key]
        if key in ("length", "range"):
            given = parse_range(given, f"{where}.{key}", problems)
        elif key in ("exists", "sameHost", "stableAcrossRender") and not isinstance(given, bool):
            problems.append(f"{where}.{key}: expected true or false")
        elif key in ("matches", "notMatches", "contains") and not isinstance(given, str):
            problems.append(f"{where}.{key}: expected text")
        elif key == "oneOf" and not isinstance(given, list):
            problems.append(f"{where}.oneOf: expected a list")
        operators[key] = given
    parts: dict[str, Any] = {}
    for key in ("all", "any"):
        if key in found:
            if not isinstance(found[key], list):
                problems.append(f"{where}.{key}: expected a list")
                continue
            parts[key] = tuple(parse_check(c, f"{where}.{key}[{i}]", problems) for i, c in enumerate(found[key]))
    negated = parse_check(found["not"], f"{where}.not", problems) if "not" in found else None
    name = found.get("field")
    if name is not None and not isinstance(name, str):
        problems.append(f"{where}.field: expected text")
        name = None
    return Check(name, operators, parts.get("all"), parts.get("any"), negated)


def parse_applies(value: Any, where: str, problems: list[str]) -> Applies:
    found = _strict(value, {"path", "exclude", "status", "html", "indexable"}, where, problems)
    for key in ("path", "exclude"):
        if key in found and not (isinstance(found[key], list) and all(isinstance(g, str) for g in found[key])):
            problems.append(f"{where}.{key}: expected a list of texts")
            found = {**found, key: []}
    for key in ("html", "indexable"):
        if key in found and not isinstance(found[key], bool):
            problems.append(f"{where}.{key}: expected true or false")
    status = parse_range(found["status"], f"{where}.status", problems) if "status" in found else Range(200, 299)
    return Applies(tuple(found.get("path", ())), tuple(found.get("exclude", ())), status, found.get("html", True), found.get("indexable"))


def _site_check(value: Any, where: str, problems: list[str]) -> tuple[str, Any]:
    found = _strict(value, {"unique", *SITE_CHECKS}, where, problems)
    if len(found) != 1:
        problems.append(f"{where}: give exactly one site check")
        return "unique", "title"
    (key, given), = found.items()
    if key == "unique" and not isinstance(given, str) or key in SITE_CHECKS and given not in SITE_CHECKS[key]:
        problems.append(f"{where}.{key}: {given!r} is not possible")
    return key, given


def parse_rule(value: Any, where: str, problems: list[str]) -> Rule | None:
    shared = {"id", "description", "severity", "applies", "message", "enabled", "scope", "check"}
    site = isinstance(value, dict) and value.get("scope") == "site"
    found = _strict(value, shared if site else shared | {"source", "when"}, where, problems)
    if not found:
        return None
    name = found.get("id")
    if not isinstance(name, str) or not re.fullmatch("[a-z0-9][a-z0-9-]*", name):
        problems.append(f"{where}.id: letters a-z, digits and hyphens only")
        return None
    where = f"rule {name}"
    for key, options in (("severity", SEVERITIES), ("scope", ("page", "site")), ("source", ("effective", "raw", "rendered"))):
        if key in found and found[key] not in options:
            problems.append(f"{where}.{key}: expected one of {', '.join(options)}")
    if "enabled" in found and not isinstance(found["enabled"], bool):
        problems.append(f"{where}.enabled: expected true or false")
    if "check" not in found:
        problems.append(f"{where}.check: missing")
        return None
    check = _site_check(found["check"], f"{where}.check", problems) if site else parse_check(found["check"], f"{where}.check", problems)
    return Rule(
        name, "site" if site else "page", check, found.get("severity", "warning"), found.get("description", ""), parse_applies(found["applies"], f"{where}.applies", problems) if "applies" in found else Applies(),
        found.get("message"), found.get("enabled", True), found.get("source", "effective"), parse_check(found["when"], f"{where}.when", problems) if "when" in found else None,
    )


def lint(check: Check, where: str, inherited: str | None, problems: list[str], warnings: list[str]) -> None:
    """Operators without a field and bad patterns are errors; unknown fields are warned about."""
    name = check.field or inherited
    if check.operators and name is None:
        problems.append(f"{where}: {', '.join(check.operators)} without a field")
    if check.field and not known(check.field):
        warnings.append(f"{where}: no page has a field {check.field!r}")
    for key in ("matches", "notMatches"):
        if isinstance(check.operators.get(key), str):
            try:
                java_pattern(check.operators[key])
            except PatternError as problem:
                problems.append(f"{where}.{key}: {problem}")
    for key, parts in (("all", check.all), ("any", check.any), ("not", (check.negated,) if check.negated else None)):
        for part in parts or ():
            lint(part, f"{where}.{key}", name, problems, warnings)


def load_rules(files: list[str | dict] | None = None, overrides: dict[str, dict] | None = None, plugins: list[str] | None = None, base: Path | str = ".") -> RuleSet:
    """Rules of all files: a later id replaces an earlier one in its place, then overrides; all problems at once."""
    problems: list[str] = []
    warnings: list[str] = []
    found: dict[str, Rule] = {}
    for given in files if files is not None else ["builtin:default"]:
        if isinstance(given, dict):
            label, content = "rules", given
        else:
            path = PACK if given == "builtin:default" else Path(base, given)
            label = str(given)
            if given.startswith("builtin:") and given != "builtin:default":
                problems.append(f"{label}: no such pack")
                continue
            try:
                content = yaml.safe_load(path.read_text())
            except (OSError, yaml.YAMLError) as problem:
                problems.append(f"{label}: {problem}")
                continue
        listed = _strict(content or {}, {"rules"}, label, problems).get("rules", [])
        if not isinstance(listed, list):
            problems.append(f"{label}: rules has to be a list")
            continue
        for i, value in enumerate(listed):
            rule = parse_rule(value, f"{label}[{i}]", problems)
            if rule:
                found[rule.id] = rule
    for name, change in (overrides or {}).items():
        given = _strict(change, {"severity", "enabled"}, f"override {name}", problems)
        if name not in found:
            problems.append(f"override {name}: no such rule")
        elif given.get("severity", "info") not in SEVERITIES:
            problems.append(f"override {name}: bad severity")
        else:
            found[name] = replace(found[name], **given)
    for rule in found.values():
        if isinstance(rule.check, Check):
            lint(rule.check, f"rule {rule.id}", None, problems, warnings)
        if rule.when:
            lint(rule.when, f"rule {rule.id}.when", None, problems, warnings)
    loaded = []
    for path in plugins or []:
        from .plugins import load_plugins

        try:
            loaded += load_plugins(Path(base, path))
        except Exception as problem:  # whatever the file raises belongs in the list of problems
            problems.append(f"plugin {path}: {problem}")
    if problems:
        raise RuleError(problems)
    return RuleSet([r for r in found.values() if r.enabled], loaded, warnings)
