"""Aggregates that reports show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SEVERITIES


def severity_rank(column: Column) -> Column:
    return F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*(x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i)))), lambda k, _: k == column)), F.lit(0)), F.lit(len(SEVERITIES)))


def status_bucket() -> Column:
    return F.when(F.coalesce("robots_blocked", F.lit(False)), "robots").when(F.coalesce("status", F.lit(0)) == 0, "error").otherwise(F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")))


def status_buckets(pages: DataFrame) -> DataFrame:
    """bucket, n of pages that are not external, by name."""
    return pages.where(~F.coalesce("external", F.lit(False))).groupBy(status_bucket().alias("bucket")).agg(F.count("*").alias("n")).orderBy("bucket")


def page_counts(pages: DataFrame) -> DataFrame:
    """One row: pages (external left out), rendered, external."""
    outside = F.coalesce("external", F.lit(False))
    return pages.agg(F.count_if(~outside).alias("pages"), F.count_if(F.col("rendered").isNotNull() & ~outside).alias("rendered"), F.count_if(outside).alias("external"))


def severity_totals(findings: DataFrame) -> DataFrame:
    return findings.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def with_order(findings: DataFrame) -> DataFrame:
    """Findings with ``ordinal``, a struct that sorts them as evaluated."""
    return findings.withColumn("ordinal", F.struct(F.col("part"), F.when(F.col("part") == 0, F.col("seq")).alias("page"), F.col("rule_seq"), F.col("seq"), F.col("ord")))


def findings_per_rule(findings: DataFrame) -> DataFrame:
    """rule_id, severity (of the first finding), n, first; most severe and most frequent first."""
    rows = with_order(findings).groupBy("rule_id").agg(F.min_by("severity", "ordinal").alias("severity"), F.count("*").alias("n"), F.min("ordinal").alias("first"))
    return rows.orderBy(severity_rank(F.col("severity")), F.desc("n"), "first")


def examples_per_rule(findings: DataFrame, most: int) -> DataFrame:
    """The first ``most`` findings of every rule, with their rank."""
    by_rule = Window.partitionBy("rule_id").orderBy("ordinal")
    return with_order(findings).withColumn("rank", F.row_number().over(by_rule)).where(F.col("rank") <= most).drop("ordinal")


def most_severe(findings: DataFrame, most: int = 50) -> DataFrame:
    """Top findings by severity; evaluation order decides ties."""
    return with_order(findings).orderBy(severity_rank(F.col("severity")), "ordinal").limit(most).drop("ordinal")


def findings_per_page(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """url, n of every page, 0 where a page has none."""
    counts = findings.groupBy("url").agg(F.count("*").alias("n"))
    return pages.select("url").join(counts, "url", "left").select("url", F.coalesce("n", F.lit(0)).alias("n"))


def fails(findings: DataFrame, level: str) -> bool:
    """Any finding at ``level`` or above."""
    worst = SEVERITIES[: SEVERITIES.index(level) + 1]
    return not findings.where(F.col("severity").isin(*worst)).limit(1).isEmpty()


def fingerprint() -> Column:
    """First 32 hex digits of SHA-256 of the rule id followed by the address."""
    return F.substring(F.sha2(F.concat("rule_id", "url"), 256), 1, 32)
