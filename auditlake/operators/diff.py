"""Differences of two runs: pages, tracked fields and findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import View
from ..plans.checks import json_text

TRACKED = ("status", "redirectCount", "title", "metaDescription", "canonical", "noindex", "h1")


@dataclass
class RunDiff:
    added: DataFrame
    removed: DataFrame
    changes: DataFrame
    new_findings: DataFrame
    resolved_findings: DataFrame


def _side(pages: DataFrame) -> DataFrame:
    view = View()
    own = [F.struct(F.lit(name).alias("field"), json_text(view.field(name)).alias("value")) for name in TRACKED]
    rows = pages.where(~F.coalesce("external", F.lit(False)))
    return rows.select("url", "seq", F.coalesce("robots_blocked", F.lit(False)).alias("blocked"), F.array(*own).alias("values"))


def changed_fields(before: DataFrame, after: DataFrame) -> DataFrame:
    """url, field, before, after (JSON text) of pages in both runs and blocked in neither."""
    old = _side(before).select("url", F.col("values").alias("old"), F.col("blocked").alias("was_blocked"))
    both = _side(after).join(old, "url").where("not blocked and not was_blocked")
    rows = both.select("url", F.explode(F.arrays_zip("old", "values")).alias("z"))
    return rows.where("not (z.old.value <=> z.values.value)").select("url", F.col("z.old.field").alias("field"), F.col("z.old.value").alias("before"), F.col("z.values.value").alias("after"))


def diff_runs(before: DataFrame, after: DataFrame, findings_before: DataFrame, findings_after: DataFrame) -> RunDiff:
    """External pages are left out; findings are compared by rule and url, and duplicates survive."""
    old, new = _side(before).select("url", "seq"), _side(after).select("url", "seq")
    keys = ["rule_id", "url"]
    return RunDiff(
        new.join(old, "url", "left_anti"), old.join(new, "url", "left_anti"), changed_fields(before, after),
        findings_after.join(findings_before.select(*keys).distinct(), keys, "left_anti"), findings_before.join(findings_after.select(*keys).distinct(), keys, "left_anti"),
    )
