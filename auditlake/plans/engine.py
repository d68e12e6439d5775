"""Evaluation of a rule set: one projection for all page rules, joins for site rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.site import SiteContext, SiteRules
from ..sources.store import scratch_table
from .checks import finding_of
from .model import Rule, RuleSet
from .plugins import page_findings, site_findings

ORDERED = ["rule_id", "severity", "url", "message", "part", "seq", "rule_seq", "ord"]


def page_rule_findings(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of all page rules from one scan; nothing is shuffled."""
    made = F.array_compact(F.array(*(finding_of(r, i) for i, r in enumerate(rules))))
    rows = pages.select("seq", F.explode(made).alias("f"))
    return rows.select("f.rule_id", "f.severity", "f.url", "f.message", F.lit(0).alias("part"), "seq", "f.rule_seq", F.lit(0).cast("long").alias("ord"))


def run_rules(pages: DataFrame, rules: RuleSet, site: SiteContext | None = None) -> DataFrame:
    """rule_id, severity, url, message, and part, seq, rule_seq, ord, which give the findings' order.

    Where several site rules read them, pages and resolved addresses are
    written to shared storage once, so no page is extracted again.
    """
    parts: list[DataFrame] = []
    several = sum(r.scope == "site" for r in rules.rules) > 1
    if several:
        pages = scratch_table(pages, "rule-pages")
    page = [r for r in rules.rules if r.scope == "page"]
    if page:
        parts.append(page_rule_findings(pages, page))
    count = len(page)
    for plugin in rules.plugins:
        if plugin.page_columns or plugin.check_page:
            parts.append(page_findings(pages, plugin, count))
            count += 1
    evaluation = SiteRules(pages, site or SiteContext(), scratch_table if several else None)
    for rule in rules.rules:
        if rule.scope == "site":
            parts.append(evaluation.run(rule, count))
            count += 1
    for plugin in rules.plugins:
        if plugin.check_site:
            parts.append(site_findings(pages, plugin, count))
            count += 1
    if not parts:
        return pages.sparkSession.createDataFrame([], "rule_id string, severity string, url string, message string, part int, seq long, rule_seq int, ord long")
    return reduce(DataFrame.unionByName, (p.select(*ORDERED) for p in parts))


def ordered(findings: DataFrame) -> DataFrame:
    """Page findings by page and rule, then site findings by rule, page and place."""
    return findings.orderBy("part", F.when(F.col("part") == 0, F.col("seq")), "rule_seq", "seq", "ord")
