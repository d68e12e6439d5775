"""Rules over the whole site: joins of pages, links and language alternates with resolved addresses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import View
from ..functions.urls import hostname_of, site_key, url_parts
from ..plans.checks import Compiler, as_strings, fill, is_true, present, show
from ..plans.model import Rule
from .resolve import addresses, links, target_columns

#: Fixed value: language codes of alternates.
LANGUAGE = r"(?i)^[a-z]{2,3}(?:-(?:[a-z]{2}|[0-9]{3}|[a-z]{4}))?\z"


@dataclass
class SiteContext:
    """``sitemap``: addresses listed (url), None without a sitemap; an empty one counts as none."""

    sitemap: DataFrame | None = None
    follow_links: bool = True


def _state() -> Column:
    return F.when(F.coalesce("t_status", F.lit(0)) == 0, F.coalesce("t_error", F.lit("no answer"))).otherwise(F.col("t_status").cast("string"))


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


class SiteRules:
    """Shares the resolved addresses and links between the rules of one evaluation."""

    def __init__(self, pages: DataFrame, site: SiteContext, keep: Callable[[DataFrame, str], DataFrame] | None = None):
        """``keep`` writes what several rules read."""
        self.pages, self.site, self.keep = pages, site, keep
        self._resolved: DataFrame | None = None

    @property
    def resolved(self) -> DataFrame:
        if self._resolved is None:
            found = addresses(self.pages)
            self._resolved = self.keep(found, "addresses") if self.keep else found
        return self._resolved

    def run(self, rule: Rule, order: int) -> DataFrame:
        """rule_id, severity, url, message, part, seq, rule_seq, ord of one rule."""
        kind, given = rule.check
        sources = self.pages.where(Compiler().applies(rule.applies))
        match kind:
            case "unique":
                made = self.unique(sources, given)
            case "orphans":
                made = self.orphans()
            case "missingFromSitemap":
                made = self.missing_from_sitemap(sources)
            case "hreflang":
                made = self.alternates(sources) if given == "valid" else self.without_default(sources)
            case "canonicalTarget":
                made = self.canonical_target(sources)
            case _:
                made = self.link_targets(sources, kind, given)
        message = fill(rule.message, {"url": F.col("url"), "detail": F.col("detail")}) if rule.message is not None else F.col("detail")
        return made.select(F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), "url", message.alias("message"), F.lit(1).alias("part"), "seq", F.lit(order).alias("rule_seq"), F.col("ord").cast("long").alias("ord"))

    def unique(self, sources: DataFrame, name: str) -> DataFrame:
        """Pages that share a present value, each with up to three of the others.

        Counts and the four first addresses are aggregated, so a value that a
        third of all pages share never becomes one long list; the members come
        from a join on the value.
        """
        field = View().field(name)
        if field is None or field.kind not in ("string", "number", "boolean", "strings"):
            return sources.select("seq", "url", F.lit("").alias("detail"), F.lit(0).alias("ord")).where("false")
        key = F.array_join(as_strings(field), "\n") if field.kind == "strings" else field.column.cast("string")
        rows = sources.where(present(field)).select("seq", "url", key.alias("key"), show(field).alias("shown"))
        # The group limit keeps four rows of a value in each task, so a value shared by many pages stays small.
        first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).where("rank <= 4")
        heads = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "url")))["url"].alias("head"))
        ranked = rows.groupBy("key").agg(F.count("*").alias("n")).join(heads, "key")
        repeated = ranked.where("n > 1")
        joined = rows.join(repeated, "key")
        others = F.filter("head", lambda u: u != F.col("url"))
        own = rows.groupBy("key", "url").agg(F.count("*").alias("mine"))
        joined = joined.join(own, ["key", "url"]).withColumn("left", F.col("n") - F.col("mine"))
        more = F.when(F.col("left") > 3, F.concat(F.lit(" (+"), (F.col("left") - 3).cast("string"), F.lit(")"))).otherwise("")
        return joined.select("seq", "url", _text(f"{name} ", F.col("shown"), " is also on ", F.array_join(F.slice(others, 1, 3), ", "), more).alias("detail"), F.lit(0).alias("ord"))

    def orphans(self) -> DataFrame:
        """Pages from the sitemap that no internal link of any page reaches, over redirects or not."""
        pages = self.pages.select("seq", "url", "final_url", "seed_source")
        if not self.site.follow_links:
            return pages.where("false").select("seq", "url", F.lit("").alias("detail"), F.lit(0).alias("ord"))
        targets = links(self.pages).where("internal").select("href").distinct()
        hit = self.resolved.select("address", "t_final")
        linked = targets.join(hit, F.col("href") == F.col("address"), "left").select(F.coalesce("t_final", "href").alias("linked")).distinct()
        from_map = pages.where("seed_source = 'sitemap'")
        lone = from_map.join(linked, F.col("url") == F.col("linked"), "left_anti").join(linked, F.col("final_url") == F.col("linked"), "left_anti")
        return lone.select("seq", "url", F.lit("listed in the sitemap, but no internal link leads here").alias("detail"), F.lit(0).alias("ord"))

    def missing_from_sitemap(self, sources: DataFrame) -> DataFrame:
        rows = sources.where(View().indexable() & ~is_true(F.col("seed_source") == "sitemap")).select("seq", "url", "final_url")
        listed = self.site.sitemap
        if listed is None or listed.isEmpty():
            rows = rows.where("false")
        else:
            listed = listed.select(url_parts("url")["url"].alias("listed")).distinct()  # compared as pages' addresses are
            rows = rows.join(listed, F.col("url") == F.col("listed"), "left_anti").join(listed, F.col("final_url") == F.col("listed"), "left_anti")
        return rows.select("seq", "url", F.lit("indexable, but not in the sitemap").alias("detail"), F.lit(0).alias("ord"))

    def without_default(self, sources: DataFrame) -> DataFrame:
        entries = View().snap["hreflang"]
        rows = sources.where(F.coalesce(F.size(entries), F.lit(0)) > 0).where(~F.exists(entries, lambda e: F.lower(e["lang"]) == "x-default"))
        return rows.select("seq", "url", F.lit("alternates without x-default").alias("detail"), F.lit(0).alias("ord"))

    def alternates(self, sources: DataFrame) -> DataFrame:
        """Bad codes, codes with several targets, no self reference, then each target's state and return link."""
        entries = View().snap["hreflang"]
        rows = sources.where(F.coalesce(F.size(entries), F.lit(0)) > 0).select("seq", "url", "final_url", entries.alias("entries"))
        flat = rows.select("seq", "url", "final_url", F.posexplode("entries").alias("pos", "e")).select("seq", "url", "final_url", "pos", F.col("e.lang").alias("lang"), F.col("e.href").alias("href")).withColumn("code", F.lower("lang"))
        bad = flat.where((F.col("code") != "x-default") & ~F.col("lang").rlike(LANGUAGE)).select("seq", "url", _text('language code "', F.col("lang"), '" is not valid').alias("detail"), F.col("pos").alias("ord"))
        distinct = flat.groupBy("seq", "url", "code", "href").agg(F.min("pos").alias("pos"))
        several = distinct.groupBy("seq", "url", "code").agg(F.array_sort(F.collect_list(F.struct("pos", "href"))).alias("targets")).where(F.size("targets") > 1)
        several = several.select("seq", "url", _text('"', F.col("code"), '" has several targets: ', F.array_join(F.col("targets.href"), ", ")).alias("detail"), (F.lit(100_000) + F.col("targets")[0]["pos"]).alias("ord"))
        alone = rows.where(~F.exists("entries", lambda e: e["href"] == F.col("final_url"))).select("seq", "url", F.lit("no alternate leads to the page itself").alias("detail"), F.lit(200_000).alias("ord"))
        hit = flat.where("href <> ''").join(self.resolved, F.col("href") == F.col("address")).where("not t_blocked")
        state = F.when(~is_true(F.col("t_status").between(200, 299)), _text('"', F.col("lang"), '" leads to ', F.col("href"), " (", _state(), ")")).when(
            F.col("t_redirected") & (F.col("href") != F.col("t_final")), _text('"', F.col("lang"), '" leads to a redirect to ', F.col("t_final"))
        )
        back = F.when(~is_true(F.array_contains("t_alternates", F.col("final_url"))), _text('"', F.col("lang"), '": ', F.col("href"), " does not link back"))
        told = hit.select("seq", "url", "pos", F.posexplode(F.array(state, back)).alias("which", "detail")).where("detail is not null")
        told = told.select("seq", "url", "detail", (F.lit(300_000) + 2 * F.col("pos") + F.col("which")).alias("ord"))
        return bad.unionByName(several).unionByName(alone).unionByName(told)

    def canonical_target(self, sources: DataFrame) -> DataFrame:
        """The first fault of a canonical address on the same site: state, redirect, noindex, chain."""
        canonical = View().snap["canonical"]
        rows = sources.select("seq", "url", "final_url", canonical.alias("canonical")).where("canonical is not null and canonical <> final_url")
        rows = rows.where(site_key(hostname_of(F.col("canonical"))) == site_key(hostname_of(F.col("final_url"))))
        hit = rows.join(self.resolved, F.col("canonical") == F.col("address")).where("not t_blocked and t_seq <> seq")
        fault = (
            F.when(~is_true(F.col("t_status").between(200, 299)), _text("canonical leads to ", F.col("canonical"), " (", _state(), ")"))
            .when(F.col("t_redirected") & (F.col("canonical") != F.col("t_final")), _text("canonical leads to a redirect to ", F.col("t_final")))
            .when(F.col("t_noindex"), _text("canonical leads to ", F.col("canonical"), ", which is noindex"))
            .when(F.col("t_canonical") != F.col("t_final"), _text("canonical chain: ", F.col("url"), " > ", F.col("canonical"), " > ", F.col("t_canonical")))
        )
        return hit.select("seq", "url", fault.alias("detail"), F.lit(0).alias("ord")).where("detail is not null")

    def link_targets(self, sources: DataFrame, kind: str, given: str) -> DataFrame:
        """Distinct links of each page whose target is broken, blocked or redirects."""
        inside = given == "internal"
        # The few targets at fault are chosen first, so that only links to them are grouped.
        target = self.resolved.where("not t_blocked")
        broken = F.coalesce((F.col("t_status") == 0) | (F.col("t_status") >= 400), F.lit(True))
        if kind == "brokenLinks":
            target = target.where(broken if inside else broken & ~is_true(F.col("t_status") == 403))
            detail = _text("link to ", F.col("href"), ": ", _state())
        elif kind == "blockedLinks":
            target = target.where("t_status = 403")
            detail = _text("link to ", F.col("href"), " refuses automatic requests (403)")
        else:
            target = target.where(F.col("t_redirected") & (F.col("address") != F.col("t_final")))
            detail = _text("link to ", F.col("href"), " redirects to ", F.col("t_final"))
        hit = links(sources).where(F.col("internal") == F.lit(inside)).join(target, F.col("href") == F.col("address"))
        return hit.groupBy("seq", "url", "href", detail.alias("detail")).agg(F.min("pos").alias("ord")).select("seq", "url", "detail", "ord")


__all__ = ["SiteContext", "SiteRules", "target_columns"]
