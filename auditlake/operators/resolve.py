"""From any address a crawl met to the page that it led to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import View


def target_columns() -> list[Column]:
    """What rules need to know of a link's target, the heavy columns left out."""
    view = View()
    return [
        F.col("url").alias("t_url"), F.col("final_url").alias("t_final"), F.col("status").alias("t_status"), F.col("error").alias("t_error"), F.col("seq").alias("t_seq"),
        F.coalesce("robots_blocked", F.lit(False)).alias("t_blocked"), (F.coalesce(F.size("redirects"), F.lit(0)) > 0).alias("t_redirected"),
        view.noindex().alias("t_noindex"), view.snap["canonical"].alias("t_canonical"), F.transform(view.snap["hreflang"], lambda h: h["href"]).alias("t_alternates"),
    ]


def addresses(pages: DataFrame) -> DataFrame:
    """address -> page: own addresses beat final ones and hops; among these the last page wins.

    One aggregation by address: ``max_by`` over (rank, seq, place), so no window
    sorts whole pages.
    """
    hops = F.transform(F.coalesce("redirects", F.array().cast("array<struct<url:string,status:int>>")), lambda h, i: F.struct(h["url"].alias("address"), F.lit(1).alias("rank"), (i + 1).cast("int").alias("place")))
    own = F.array(F.struct(F.col("final_url").alias("address"), F.lit(1).alias("rank"), F.lit(0).alias("place")), F.struct(F.col("url").alias("address"), F.lit(2).alias("rank"), F.lit(0).alias("place")))
    rows = pages.select(F.concat(own, hops).alias("every"), F.struct(*target_columns()).alias("target")).select(F.explode("every").alias("at"), "target")
    best = rows.where("at.address is not null").groupBy("at.address").agg(F.max_by("target", F.struct("at.rank", "target.t_seq", "at.place")).alias("target"))
    return best.select("address", "target.*")


def links(pages: DataFrame) -> DataFrame:
    """seq, url, pos and the parts of every link."""
    return pages.select("seq", "url", F.posexplode(View().snap["links"]).alias("pos", "link")).select("seq", "url", "pos", "link.*")
