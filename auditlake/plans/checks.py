"""The check language compiled to Column expressions.

A check becomes an array of failure texts, empty where it passes.  No predicate
is ever null: what cannot be compared fails or passes by the operator's rule.
"""

from __future__ import annotations

import functools
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fields import Field, View
from ..functions.patterns import java_pattern
from ..functions.urls import glob_pattern, hostname_of, is_html, site_key
from .model import Applies, Check, Range, Rule

_NONE = Field("none", None)  # type: ignore[arg-type]
_JSON = {"ignoreNullFields": "false"}


def _json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def is_true(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def present(field: Field) -> Column:
    """Not null, not empty text, not an empty list; 0, false and empty maps are present."""
    if field.kind == "none":
        return F.lit(False)
    if field.kind == "string":
        return is_true(field.column != "")
    if field.kind in ("strings", "structs"):
        return is_true(F.size(field.column) > 0)
    return field.column.isNotNull()


def length_of(field: Field) -> Column:
    if field.kind == "string":
        return F.coalesce(units(field.column), F.lit(0))
    if field.kind in ("strings", "structs"):
        return F.coalesce(F.when(field.column.isNotNull(), F.size(field.column)), F.lit(0))
    return F.lit(0)


def json_text(field: Field) -> Column:
    """JSON text of a value; ``null`` where there is none."""
    if field.kind == "none":
        return F.lit("null")
    if field.kind in ("number", "boolean"):
        return F.coalesce(field.column.cast("string"), F.lit("null"))
    if field.kind == "string":
        quoted = F.regexp_replace(F.to_json(F.struct(field.column.alias("v")), _JSON), r'^\{"v":|\}$', "")
        return F.coalesce(quoted, F.lit("null"))
    return F.coalesce(F.to_json(field.column, _JSON), F.lit("null"))


def show(field: Field) -> Column:
    """Short form for messages: texts in quotes, others as JSON, cut after 87 units."""
    whole = F.coalesce(F.concat(F.lit('"'), field.column, F.lit('"')), F.lit("null")) if field.kind == "string" else json_text(field)
    wide = F.encode(whole, "UTF-16BE")
    # A pair of units is one character: the first of a pair at the cut goes too.
    halved = F.hex(F.substring(wide, 173, 1)).between("D8", "DB")
    cut = F.decode(F.substring(wide, F.lit(1), F.when(halved, 172).otherwise(174)), "UTF-16BE")
    return F.when(units(whole) > 90, F.concat(cut, F.lit("…"))).otherwise(whole)


def same(field: Field, value: Any) -> Column:
    """Equal as JSON and in type; an absent value equals null only."""
    if field.kind == "none":
        return F.lit(value is None)
    if value is None:
        return field.column.isNull()
    if field.kind == "string":
        return is_true(field.column == value) if isinstance(value, str) else F.lit(False)
    if field.kind == "boolean":
        return is_true(field.column == value) if isinstance(value, bool) else F.lit(False)
    if field.kind == "number":
        return is_true(field.column == value) if isinstance(value, (int, float)) and not isinstance(value, bool) else F.lit(False)
    return json_text(field) == _json(value)


def as_strings(field: Field) -> Column:
    """All text forms of a value: the items of a list, structs as JSON, nothing for null."""
    empty = F.array().cast("array<string>")
    if field.kind == "none":
        return empty
    if field.kind == "strings":
        return F.coalesce(F.array_compact(field.column), empty)
    if field.kind == "structs":
        return F.coalesce(F.transform(field.column, lambda s: F.to_json(s, _JSON)), empty)
    text = field.column if field.kind == "string" else json_text(field)
    return F.when(field.column.isNull(), empty).otherwise(F.array(text))


def in_range(value: Column, limits: Range) -> Column:
    tests = [value >= limits.min] * (limits.min is not None) + [value <= limits.max] * (limits.max is not None)
    return is_true(functools.reduce(lambda a, b: a & b, tests, F.lit(True)))


class Compiler:
    """Compiles checks for the pages of one DataFrame."""

    def __init__(self, source: str = "effective"):
        self.source = source
        self.view = View(source)

    def _field(self, name: str) -> Field:
        return self.view.field(name) or _NONE

    def failures(self, check: Check, inherited: str | None = None) -> Column:
        """Array of failure texts in a fixed order."""
        name = check.field or inherited
        parts: list[Column] = []
        for child in check.all or ():
            parts.append(self.failures(child, name))
        if check.any is not None:
            children = [self.failures(c, name) for c in check.any]
            passed = functools.reduce(lambda a, b: a | b, [F.size(c) == 0 for c in children], F.lit(False))
            joined = F.array_join(F.concat(*children), " or ") if children else F.lit("no alternative given")
            parts.append(self._one(passed, F.concat(F.lit("none of: "), joined)))
        if check.negated is not None:
            parts.append(self._one(F.size(self.failures(check.negated, name)) > 0, F.lit("must not hold but does")))
        if name is not None and check.operators:
            parts += [self._operator(key, value, name) for key, value in check.operators.items()]
        return F.concat(*parts) if parts else F.array().cast("array<string>")

    @staticmethod
    def _one(passed: Column, text: Column) -> Column:
        return F.when(passed, F.array().cast("array<string>")).otherwise(F.array(text))

    def _operator(self, key: str, value: Any, name: str) -> Column:
        field = self._field(name)
        say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
        match key:
            case "exists":
                return self._one(present(field) == F.lit(value), F.lit(f"{name} is missing" if value else f"{name} should be absent"))
            case "length":
                size = length_of(field)
                return self._one(in_range(size, value), say(f"{name} has length ", size.cast("string"), f", wanted {value.text()}"))
            case "range":
                passed = in_range(field.column, value) if field.kind == "number" else F.lit(False)
                return self._one(passed, say(f"{name} is ", show(field), f", wanted {value.text()}"))
            case "equals":
                return self._one(same(field, value), say(f"{name} is ", show(field), f", wanted {_json(value)}"))
            case "notEquals":
                return self._one(~same(field, value), F.lit(f"{name} must not be {_json(value)}"))
            case "matches":
                return self._one(F.exists(as_strings(field), lambda s: s.rlike(java_pattern(value))), say(f"{name} ", show(field), f" does not match {value}"))
            case "notMatches":
                hits = F.filter(as_strings(field), lambda s: s.rlike(java_pattern(value)))
                return self._one(F.size(hits) == 0, say(f"{name} matches {value}: ", show(Field("string", F.get(hits, F.lit(0))))))
            case "oneOf":
                passed = functools.reduce(lambda a, b: a | b, [same(field, v) for v in value], F.lit(False))
                return self._one(passed, say(f"{name} is ", show(field), f", wanted one of {_json(value)}"))
            case "contains":
                if field.kind in ("strings", "structs"):
                    passed = is_true(F.array_contains(as_strings(field), value))
                else:
                    passed = is_true(field.column.contains(value)) if field.kind == "string" else F.lit(False)
                return self._one(passed, F.lit(f"{name} does not contain {_json(value)}"))
            case "sameHost":
                if not value or field.kind != "string":
                    return F.array().cast("array<string>")
                own = site_key(hostname_of(F.col("final_url")))
                passed = ~present(field) | is_true(site_key(hostname_of(field.column)) == own)
                return self._one(passed, say(f"{name} ", show(field), " is on another host"))
            case "stableAcrossRender":
                if not value:
                    return F.array().cast("array<string>")
                raw, rendered = (View(s).field(name) or _NONE for s in ("raw", "rendered"))
                both = F.col("raw").isNotNull() & F.col("rendered").isNotNull()
                return self._one(~both | (json_text(raw) == json_text(rendered)), say(f"{name} changes from ", show(raw), " to ", show(rendered), " when rendered"))
        raise ValueError(key)

    def applies(self, applies: Applies) -> Column:
        """Blocked and external pages are never judged; then html, status, paths and indexability."""
        tests = [~is_true(F.col("robots_blocked")), ~is_true(F.col("external")), in_range(F.col("status"), applies.status)]
        if applies.html:
            tests.append(View().snap.isNotNull() & is_html(F.col("content_type")))
        path = View().field("path").column
        if applies.path:
            tests.append(is_true(functools.reduce(lambda a, b: a | b, [path.rlike(glob_pattern(g)) for g in applies.path])))
        if applies.exclude:
            tests.append(~is_true(functools.reduce(lambda a, b: a | b, [path.rlike(glob_pattern(g)) for g in applies.exclude])))
        if applies.indexable is not None:
            tests.append(View().indexable() == F.lit(applies.indexable))
        return functools.reduce(lambda a, b: a & b, tests)

    def message(self, rule: Rule, failures: Column) -> Column:
        detail = F.array_join(failures, "; ")
        if rule.message is None:
            return detail
        name = rule.check.field if isinstance(rule.check, Check) else None
        value = self._field(name) if name else _NONE
        text = value.column if value.kind == "string" else json_text(value)
        return fill(rule.message, {"value": F.coalesce(text, F.lit("null")), "field": F.lit(name if name else "null"), "url": F.col("url"), "detail": detail})


def fill(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` replaced where the name is known, else left as it is."""
    import re

    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m[1] in values:
            parts += [F.lit(template[at : m.start()]), values[m[1]]]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def finding_of(rule: Rule, order: int) -> Column:
    """A struct where the page breaks the rule, else null."""
    compiler = Compiler(rule.source)
    failures = compiler.failures(rule.check)
    test = compiler.applies(rule.applies)
    if rule.source != "effective":
        test = test & compiler.view.snap.isNotNull()
    if rule.when is not None:
        test = test & (F.size(compiler.failures(rule.when)) == 0)
    return F.when(test & (F.size(failures) > 0), F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.col("url").alias("url"), compiler.message(rule, failures).alias("message"), F.lit(order).alias("rule_seq")))
