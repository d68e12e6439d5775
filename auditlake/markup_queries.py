"""Queries over documents that are written from ``page_id``, beside SQL that states what has to be read from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.fields import View
from .functions.html import needs_render, snapshot
from .operators import crawl as C
from .operators.site import SiteContext, SiteRules
from .plans.model import Rule

Query = Callable[[SparkSession, str], DataFrame]

#: Parts of the document of page i, as Spark SQL; ``n`` is i as text.
_HEAD = {
    "base": "CASE WHEN i % 4 = 1 THEN '<base target=\"x\"><base href=\"/sub/\"><base href=\"/no/\">' ELSE '' END",
    "description": "CASE i % 3 WHEN 0 THEN concat('<META NAME=\"Description\" content=\"  Text ', n, chr(10), ' of &amp; page \"><meta name=description content=second>') WHEN 1 THEN '<meta name=\"description\" content=\"  \">' ELSE '' END",
    "robots": "CASE WHEN i % 6 = 1 THEN '<meta content=\"NoIndex,  Follow\" name=\"ROBOTS\">' ELSE '' END",
    "canonical": "CASE i % 5 WHEN 1 THEN concat('<link rel=\"nofollow CANONICAL\" href=\"c', n, '?x=1&amp;utm_source=q#f\">') WHEN 2 THEN '<link rel=\"canonical\" href=\"mailto:a@b.example\">' WHEN 3 THEN concat('<link href=\"https://OTHER.example:443/z/../c', n, '\" rel=canonical><link rel=\"canonical\" href=\"/second\">') WHEN 4 THEN '<link rel=\"canonical\" href=\"\">' ELSE '' END",
    "alternates": "CASE WHEN i % 2 = 0 THEN concat('<link rel=\"alternate\" hreflang=\"de\" href=\"/de/', n, '\"><link rel=\"alternate stylesheet\" hreflang=\" en-GB\" href=\"en\"><link rel=\"icon\" hreflang=\"fr\" href=\"/fr\"><link rel=\"alternate\" hreflang=\"x-default\">') ELSE '' END",
    "og": "CASE WHEN i % 2 = 1 THEN concat('<meta property=\"og:title\" content=\"first\"><meta property=\"og:image\" content=\" a  b \"><meta property=\"og:title\" content=\"last ', n, '\"><meta property=\"og:empty\" content=\" \"><meta name=\"og:no\" content=\"n\">') ELSE '' END",
    "json_ld": "CASE i % 4 WHEN 0 THEN '<script type=\"application/ld+json\">{\"@type\":\"A\",\"@graph\":[{\"@type\":[\"B\",3,\"C\"]},{\"x\":{\"@type\":\"D\"}}]}</script>' WHEN 1 THEN '<script type=\"application/ld+json\">[{\"@type\":\"E\"},{\"@graph\":{\"@type\":\"F\"}}]</script><script type=\"application/ld+json\">{bad</script>' WHEN 2 THEN '<script>{\"@type\":\"no\"}</script>' ELSE repeat('<script type=\"application/ld+json\">nothing</script>', 2) END",
}
_BODY = {
    "headings": "concat('<h2> Over <i>all</i> </h2>', repeat(concat('<h1>Head ', n, '</h1>'), cast(i % 3 AS INT)), '<h6></h6>')",
    "images": "CASE i % 3 WHEN 0 THEN '<img src=\"/a.png\" alt=\"\"><img data-src=\"b.png\"><img src=\"\" data-src=\"c.png\" alt=\" x \">' WHEN 1 THEN '<IMG SRC=\"data:image/png;base64,AA\">' ELSE '' END",
    "links": "concat('<a href=\"/l', n, '\" rel=\"NoFollow ugc\"> T <b>x</b> </a><a href=\"https://www.H.example/k?utm_source=1&amp;a=2#f\">in</a><a href=\"https://o.example\">out</a><a href=\"mailto:x@y.example\">m</a><a>none</a><a href=\"\">self</a>')",
}
_ROOTS = """'<div id="app"></div>', '<div id="approach"></div>', '<div id=app></div>', concat('<div class="x" id=', chr(39), '__next', chr(39), ' data-a>  </div>'), '<div id="root">x</div>', '<DIV ID="ROOT"></DIV>'"""

#: DuckDB: the address of page i, what relative addresses resolve against, and its folder.
_PLACES = "d AS (SELECT page_id AS i, CAST(page_id AS VARCHAR) AS n, concat('https://h.example/a/p', page_id) AS url, CASE WHEN page_id % 4 = 1 THEN 'https://h.example/sub/' ELSE concat('https://h.example/a/p', page_id) END AS root, CASE WHEN page_id % 4 = 1 THEN 'https://h.example/sub/' ELSE 'https://h.example/a/' END AS folder FROM pages)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html and its snapshot s."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("page_id").alias("i"), F.col("page_id").cast("string").alias("n"))
    html = F.concat(F.lit("<!doctype html><html><head>"), *map(F.expr, _HEAD.values()), F.lit("</head><body>"), *map(F.expr, _BODY.values()), F.lit("</body></html>"))
    rows = rows.select("page_id", F.concat(F.lit("https://h.example/a/p"), "n").alias("url"), html.alias("html"))
    return rows.withColumn("s", snapshot(F.col("html"), F.col("url")))


def _items(array: str, *fields: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = documents(spark, sf_dir).select("page_id", F.posexplode(f"s.{array}").alias("pos", "item"))
        return rows.select("page_id", "pos", *(F.col(f"item.{f}").alias(f) for f in fields))

    return query


def _root_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("<body>"), F.expr(f"element_at(array({_ROOTS}), cast(page_id % 6 AS INT) + 1)"), F.lit("word " * 60 + '<a href="/a">a</a><a href="/b">b</a></body>'))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", body.alias("html"))
    rows = rows.withColumn("s", snapshot(F.col("html"), F.lit("https://h.example/")))
    return rows.select("page_id", needs_render(F.col("html"), F.col("s")).alias("needs_render"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers of pages at /p<i>: time-outs, one-step redirects into them, and pages."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("i"))
    at = lambda i: F.concat(F.lit("https://n.example/p"), i.cast("string"))
    moved, failed = F.expr("i % 5 = 1"), F.expr("i % 5 = 2")
    headers = F.when(moved, F.create_map(F.lit("location"), at(F.col("i") + 1))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select(at(F.col("i")).alias("url"), F.lit("GET").alias("method"), F.lit(1).alias("attempt"), F.when(failed, 0).when(moved, 301).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), headers.alias("headers"), F.lit("<html></html>").alias("body"), F.lit(1).cast("long").alias("time_ms"), F.when(failed, F.concat(F.lit("timeout of p"), F.col("i").cast("string"))).alias("error"))


def _fetch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir)
    return C.follow_redirects(answers.select("url"), answers).where("status = 0").select("url", "final_url", "error")


def _robots_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of all pages by their own addresses, under a robots text that closes some paths."""
    answers = _answers(spark, sf_dir)
    seeds = answers.select("url", F.lit("url").alias("source"), F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("pos"))
    robots = {"https://n.example": "User-agent: *\nDisallow: /p1\nAllow: /p1*5$\nDisallow: /*7$\n"}
    pages, _ = C.crawl(spark, seeds, answers, C.Scope(max_depth=0, follow_links=False), robots)
    return pages.select("url", "robots_blocked")


def _listed_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap lists every second page by an address that has to be normalized first."""
    from .queries import overlay

    pages = overlay(spark, sf_dir)
    listed = pages.where("seq % 2 = 0").select(F.concat(F.lit(" "), F.regexp_replace("url", "^https://s", "HTTPS://S"), F.lit("?utm_campaign=x#top")).alias("url"))
    rows = SiteRules(pages, SiteContext(listed)).run(Rule("r", "site", ("missingFromSitemap", True)), 0)
    return rows.select("url", "message")


def _first_pages(state: str) -> str:
    return f"WITH p AS (SELECT page_id AS i, concat('https://n.example/p', page_id) AS url FROM pages) {state}"


_ROOT_SQL = "SELECT page_id, page_id % 6 IN (0, 3, 5) AS needs_render FROM pages"
_IMAGES = "SELECT i AS page_id, 0 AS pos, 'https://h.example/a.png' AS src, '' AS alt FROM d WHERE i % 3 = 0 UNION ALL SELECT i, 1, concat(folder, 'b.png'), NULL FROM d WHERE i % 3 = 0 UNION ALL SELECT i, 2, root, ' x ' FROM d WHERE i % 3 = 0 UNION ALL SELECT i, 0, 'data:image/png;base64,AA', NULL FROM d WHERE i % 3 = 1"
_LINKS = "SELECT i AS page_id, 0 AS pos, concat('https://h.example/l', n) AS href, 'T x' AS text, 'nofollow ugc' AS rel, true AS internal, true AS nofollow FROM d UNION ALL SELECT i, 1, 'https://www.h.example/k?a=2', 'in', '', true, false FROM d UNION ALL SELECT i, 2, 'https://o.example/', 'out', '', false, false FROM d UNION ALL SELECT i, 3, root, 'self', '', true, false FROM d"
_HEADINGS = "SELECT i AS page_id, 0 AS pos, 2 AS level, 'Over all' AS text FROM d UNION ALL SELECT i, CAST(k AS INTEGER), 1, concat('Head ', n) FROM d, range(1, 3) AS r(k) WHERE k <= i % 3 UNION ALL SELECT i, CAST(1 + i % 3 AS INTEGER), 6, '' FROM d"
_ALTERNATES = "SELECT i AS page_id, 0 AS pos, 'de' AS lang, concat('https://h.example/de/', n) AS href FROM d WHERE i % 2 = 0 UNION ALL SELECT i, 1, ' en-GB', concat(folder, 'en') FROM d WHERE i % 2 = 0 UNION ALL SELECT i, 2, 'x-default', root FROM d WHERE i % 2 = 0"

#: name -> (query, SQL)
_ALL: dict[str, tuple[Query, str]] = {
    "extract_meta": (lambda s, d: documents(s, d).select("page_id", "s.meta_description", "s.meta_robots"), f"WITH {_PLACES} SELECT i AS page_id, CASE WHEN i % 3 = 0 THEN concat('Text ', n, ' of & page') END AS meta_description, CASE WHEN i % 6 = 1 THEN 'NoIndex, Follow' END AS meta_robots FROM d"),
    "extract_canonical": (lambda s, d: documents(s, d).select("page_id", "s.canonical"), f"WITH {_PLACES} SELECT i AS page_id, CASE i % 5 WHEN 1 THEN concat(folder, 'c', n, '?x=1') WHEN 3 THEN concat('https://other.example/c', n) END AS canonical FROM d"),
    "extract_headings": (_items("headings", "level", "text"), f"WITH {_PLACES} {_HEADINGS}"),
    "extract_hreflang": (_items("hreflang", "lang", "href"), f"WITH {_PLACES} {_ALTERNATES}"),
    "extract_og": (lambda s, d: documents(s, d).select("page_id", F.explode("s.og").alias("property", "content")), f"WITH {_PLACES} SELECT i AS page_id, 'og:title' AS property, concat('last ', n) AS content FROM d WHERE i % 2 = 1 UNION ALL SELECT i, 'og:image', 'a b' FROM d WHERE i % 2 = 1"),
    "extract_json_ld": (lambda s, d: documents(s, d).select("page_id", F.array_join("s.json_ld_types", " ").alias("types"), F.col("s.json_ld_errors").alias("errors")), "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'A B C' WHEN 1 THEN 'E F' ELSE '' END AS types, CAST(CASE page_id % 4 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS INTEGER) AS errors FROM pages"),
    "extract_images": (_items("images", "src", "alt"), f"WITH {_PLACES} {_IMAGES}"),
    "extract_link_rows": (_items("links", "href", "text", "rel", "internal", "nofollow"), f"WITH {_PLACES} {_LINKS}"),
    "derived_counts": (
        lambda s, d: documents(s, d).select("page_id", F.lit(None).cast("struct<title:string>").alias("rendered"), F.col("s").alias("raw")).select("page_id", *(View("raw").field(f).column.cast("int").alias(c) for f, c in (("h1Count", "h1_count"), ("imagesMissingAlt", "missing_alt"), ("externalLinks", "external_links")))),
        "SELECT page_id, CAST(page_id % 3 AS INTEGER) AS h1_count, CAST(CASE WHEN page_id % 3 = 2 THEN 0 ELSE 1 END AS INTEGER) AS missing_alt, 1 AS external_links FROM pages",
    ),
    "needs_render_roots": (_root_query, _ROOT_SQL),
    "fetch_error": (_fetch_errors, _first_pages("SELECT url, CASE WHEN i % 5 = 2 THEN url ELSE concat('https://n.example/p', i + 1) END AS final_url, CASE WHEN i % 5 = 1 AND i = (SELECT max(i) FROM p) THEN 'no response' ELSE concat('timeout of p', CASE WHEN i % 5 = 2 THEN i ELSE i + 1 END) END AS error FROM p WHERE i % 5 IN (1, 2)")),
    "robots_blocked": (_robots_blocked, _first_pages("SELECT url, regexp_matches(url, '/p1') AND NOT regexp_matches(url, '/p1.*5$') OR regexp_matches(url, '7$') AS robots_blocked FROM p")),
    "sitemap_normalized": (_listed_raw, ""),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    from .queries import overlay_sql

    state = "SELECT url, 'indexable, but not in the sitemap' AS message FROM o WHERE judged AND indexable AND seed_source IS DISTINCT FROM 'sitemap' AND seq % 2 = 1"
    return {name: sql for name, (_, sql) in _ALL.items() if sql} | {"sitemap_normalized": f"WITH {overlay_sql()} {state}"}
