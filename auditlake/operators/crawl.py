"""Crawl over recorded responses, level by level: the graph expands by joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.html import needs_render, snapshot
from ..functions.urls import glob_pattern, hostname_of, is_html, is_text, normalize_url, path_of, site_key, site_key_text
from ..schema import PAGE, SNAPSHOT
from ..sources.robots import allowed

REDIRECTS = (301, 302, 303, 307, 308)
MAX_HOPS = 10
SEED_RANKS = {"url": 0, "file": 1, "sitemap": 2}


@dataclass
class Scope:
    hosts: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    max_depth: int = 3
    max_pages: int = 1000
    follow_links: bool = True
    check_external: bool = False
    max_external: int = 500
    render: str = "auto"
    respect_robots: bool = True


def merge_seeds(seeds: DataFrame) -> DataFrame:
    """url, source of each distinct address: its best source (url, file, sitemap), in order of first mention."""
    rank = F.element_at(F.create_map(*(x for k, v in SEED_RANKS.items() for x in (F.lit(k), F.lit(v)))), F.col("source"))
    rows = seeds.withColumn("rank", rank).groupBy("url").agg(F.min(F.struct("rank", "pos", "source")).alias("best"))
    return rows.select("url", F.col("best.source").alias("source"), F.struct(F.col("best.rank").alias("rank"), F.col("best.pos").alias("pos")).alias("place"))


def _start(seeds: DataFrame) -> DataFrame:
    return merge_seeds(seeds.withColumn("url", _resolved("url", "url")).where("url is not null"))


def _hosts(start: DataFrame, scope: Scope) -> list[str]:
    """The crawl's sites: those of the scope, or of the seeds where it names none."""
    return sorted({site_key_text(h) for h in scope.hosts} or {r[0] for r in start.select(site_key(hostname_of(F.col("url")))).distinct().collect()})


def robots_texts(addresses: DataFrame, responses: DataFrame | Callable[[DataFrame, str], DataFrame], known: dict[str, str | None]) -> dict[str, str | None]:
    """Robots texts of the origins of ``addresses`` (url) that ``known`` lacks: 2xx answers, behind redirects too, else None.

    One small row for each origin, of which a crawl has few.
    """
    origin = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    new = [r[0] for r in addresses.select(origin.alias("origin")).distinct().collect() if r[0] not in known]
    if not new:
        return {}
    asked = addresses.sparkSession.createDataFrame([(f"{o}/robots.txt",) for o in sorted(new)], "url string")
    got = follow_redirects(asked, responses).where("status between 200 and 299 and body is not null")
    return dict.fromkeys(new) | {r.url.removesuffix("/robots.txt"): r.body for r in got.select("url", "body").collect()}


def in_scope(url: Column, hosts: list[str], scope: Scope) -> Column:
    """The site is one of the crawl's, and the path passes the globs."""
    tests = [F.coalesce(site_key(hostname_of(url)).isin(*hosts), F.lit(False))]
    if scope.include:
        tests.append(reduce(lambda a, b: a | b, [path_of(url).rlike(glob_pattern(g)) for g in scope.include]))
    if scope.exclude:
        tests.append(~reduce(lambda a, b: a | b, [path_of(url).rlike(glob_pattern(g)) for g in scope.exclude]))
    return reduce(lambda a, b: a & b, tests)


@F.pandas_udf(StringType())
def _resolved(target: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([normalize_url(t, b) if isinstance(t, str) and isinstance(b, str) else None for t, b in zip(target, base, strict=True)], dtype=object)


def follow_redirects(requests: DataFrame, responses: DataFrame | Callable[[DataFrame, str], DataFrame], method: str = "GET", keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """The final response of every requested url (column ``url``; others are kept).

    ``responses`` is a table, or a callable that fetches the addresses it is given.
    Each round joins the open requests with the responses and is written to
    shared storage, so the rounds stop as soon as no chain is open: eleven at
    most.  A redirect without target ends the chain; a loop, an eleventh
    redirect, an address without response and a network error (status 0, with
    the response's own ``error``) are errors.
    """
    keep = keep or _kept
    live = callable(responses)
    target = F.when(F.col("status").isin(*REDIRECTS), _resolved(F.col("headers").getItem("location"), F.col("url")))
    # Rounds move addresses only; bodies are joined once, to the last answer of each chain.
    told = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    steps = [F.col("url").alias("r_url"), "status", target.alias("target"), "time_ms", told.alias("told")]
    if not live:
        answer = responses.where(F.upper("method") == method).where("attempt = 1")
        moves = keep(answer.select(*steps), "redirect-moves")
    answers: list[DataFrame] = []
    extra = list(requests.columns)
    elapsed = F.col("elapsed") + F.coalesce("time_ms", F.lit(0))
    open_ = requests.withColumns({"at": F.col("url"), "redirects": F.array().cast("array<struct<url:string,status:int>>"), "elapsed": F.lit(0).cast("long")})
    done: list[DataFrame] = []
    for hop in range(MAX_HOPS + 1):
        if live:
            answers.append(keep(responses(open_.select(F.col("at").alias("url")).distinct(), method), "fetched"))
            moves = answers[-1].select(*steps)
        met = open_.join(moves, F.col("at") == F.col("r_url"), "left")
        seen = F.array_contains(F.transform("redirects", lambda h: h["url"]), F.col("target")) | (F.col("target") == F.col("at"))
        fault = F.when(F.col("status").isNull(), "no response").when(F.col("status") == 0, F.coalesce("told", F.lit("no answer"))).when(F.col("target").isNull(), None).when(seen, "redirect loop").when(F.lit(hop == MAX_HOPS), "too many redirects")
        met = keep(met.withColumn("fault", fault), "redirect-round")
        ended = met.where("target is null or fault is not null")
        done.append(ended.select(*extra, F.col("at").alias("final_url"), "redirects", F.when(F.col("fault").isNotNull(), 0).otherwise(F.col("status")).alias("status"), elapsed.alias("time_ms"), F.col("fault").alias("error")))
        going = met.where("target is not null and fault is null")
        if going.isEmpty():
            break
        open_ = going.select(*extra, F.col("target").alias("at"), F.array_append("redirects", F.struct(F.col("at").alias("url"), F.col("status").cast("int").alias("status"))).alias("redirects"), elapsed.alias("elapsed"))
    ended = reduce(DataFrame.unionByName, done)
    if live:
        # An address may be asked for in several rounds; one of its answers is enough.
        answer = reduce(DataFrame.unionByName, answers).dropDuplicates(["url"])
    content = answer.select(F.col("url").alias("c_final"), "content_type", "headers", "body")
    return ended.join(content, (F.col("final_url") == F.col("c_final")) & F.col("error").isNull(), "left").drop("c_final")


def numbered(rows: DataFrame, order: str, first: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Adds ``seq``: ``first``, ``first`` + 1 and so on in order.

    Ranges of the order are sorted in tasks of their own; only their row counts
    meet on the driver, one number for each.
    """
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    ranged = keep(ranged, "crawl-ranges")
    begins, at = {}, first
    for number, many in sorted(ranged.groupBy("_range").count().collect()):
        begins[number], at = at, at + many
    begin = F.element_at(F.create_map(*(F.lit(x) for pair in begins.items() for x in pair)), F.col("_range")) if begins else F.lit(first)
    return ranged.withColumn("seq", (begin + F.col("_row")).cast("long")).drop("_range", "_row")


def take_budget(candidates: DataFrame, budget: int, order: list) -> DataFrame:
    """The first ``budget`` candidates in crawl order."""
    return candidates.orderBy(*order).limit(max(0, budget))


def host_round_robin(queue: DataFrame, host: str = "host", order: str = "pos") -> DataFrame:
    """Adds ``turn``: all hosts' first items, then their second ones, and so on."""
    return queue.withColumn("turn", F.row_number().over(Window.partitionBy(host).orderBy(order)))


def _rendering(renderer: Callable[[str], str]):
    """html and error of each address that is not null; whatever the renderer raises is a result."""

    @F.pandas_udf("html string, error string")
    def run(urls: pd.Series) -> pd.DataFrame:
        rows: list[tuple[str | None, str | None]] = []
        for url in urls:
            try:
                rows.append((renderer(url), None) if isinstance(url, str) else (None, None))
            except Exception as problem:
                rows.append((None, str(problem) or type(problem).__name__))
        return pd.DataFrame(rows, columns=["html", "error"], dtype=object)

    return run


def pages_of(fetched: DataFrame, render: str = "auto", renderer: Callable[[str], str] | None = None) -> DataFrame:
    """Page rows from fetched responses: snapshots of textual HTML answers, rendered ones where asked for and there.

    Rendered documents come from ``renderer`` (address to HTML, called on the
    executors for the pages that need it) or else from a column ``rendered_html``.
    """
    text = F.when(is_html(F.col("content_type")) & is_text(F.col("content_type")), F.col("body"))
    rows = fetched.withColumn("raw", F.when(F.col("duplicate_of").isNull(), snapshot(text, F.col("final_url"), F.col("status"), F.col("time_ms"))))
    if (renderer or "rendered_html" in fetched.columns) and render != "raw":
        fine = F.col("status").between(200, 299) & F.col("raw").isNotNull()
        wanted = fine & (needs_render(text, F.col("raw")) if render == "auto" else F.lit(True))
        fault = F.lit("no rendered version")
        if renderer:
            rows = rows.withColumn("made", _rendering(renderer)(F.when(wanted, F.col("final_url"))))
            rows, fault = rows.withColumn("rendered_html", F.col("made.html")), F.coalesce(F.col("made.error"), fault)
        rows = rows.withColumn("rendered", snapshot(F.when(wanted, F.col("rendered_html")), F.col("final_url"), F.col("status")))
        rows = rows.withColumn("render_error", F.when(wanted & F.col("rendered_html").isNull(), fault))
    else:
        rows = rows.withColumns({"rendered": F.lit(None).cast(SNAPSHOT), "render_error": F.lit(None).cast("string")})
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in PAGE))


def crawl(spark: SparkSession, seeds: DataFrame, responses: DataFrame | Callable[[DataFrame, str], DataFrame], scope: Scope, robots: dict[str, str] | None = None, agent: str = "*", should_stop: Callable[[], bool] = lambda: False, on_level: Callable[[DataFrame, int], None] | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None, renderer: Callable[[str], str] | None = None, warn: Callable[[str], None] = lambda text: None) -> tuple[DataFrame, bool]:
    """Breadth-first crawl: (pages, whether it was aborted).

    ``seeds``: url, source, pos.  ``responses``: url, method, attempt, status,
    content_type, headers, body, time_ms and perhaps rendered_html, or a callable
    that fetches (see sources.live).  ``robots``: text by origin, read as
    ``agent``; where it is None, each level asks ``responses`` for the texts of
    its new origins.  Seeds pass the page budget but use it up; links of 2xx pages join the next level while depth and budget
    last.  A page whose redirect leads to a known address keeps no content.
    ``keep`` writes a level to shared storage (default: the operator's own);
    ``renderer`` gives rendered documents (see ``pages_of``); ``warn`` is told of
    external targets beyond ``max_external``.
    """
    if keep is None:
        keep = _kept
    start = _start(seeds)
    hosts = _hosts(start, scope)
    level = start.select("url", F.lit(None).cast("string").alias("found_on"), F.col("source").alias("seed_source"), F.struct(F.lit(0).cast("long").alias("a"), F.col("place.rank").cast("long").alias("b"), F.col("place.pos").cast("long").alias("c")).alias("place"))
    texts: dict[str, str | None] = dict(robots or {})
    known: DataFrame | None = None
    parts: list[DataFrame] = []
    accepted = done = 0
    aborted = False
    for depth in range(scope.max_depth + 1):
        if should_stop():
            aborted = True
            break
        level = numbered(level, "place", done, keep)
        count = level.count()
        if not count:
            break
        accepted, done = accepted + count, done + count
        if scope.respect_robots and robots is None:
            fresh_texts = robots_texts(level, responses, texts)
            texts |= fresh_texts
            if hasattr(responses, "robots"):
                responses.robots({k: v for k, v in fresh_texts.items() if v})
        may = allowed({k: v for k, v in texts.items() if v}, F.col("url"), agent) if scope.respect_robots else F.lit(True)
        level = level.withColumn("blocked", ~may)
        fetched = follow_redirects(level.where("not blocked"), responses, keep=keep)
        if not callable(responses) and "rendered_html" in responses.columns:
            fetched = fetched.join(responses.where("attempt = 1 and method = 'GET'").select(F.col("url").alias("v_url"), "rendered_html"), F.col("final_url") == F.col("v_url"), "left").drop("v_url")
        # A redirect's target that is known, or that an earlier page of this level claims, keeps its content there.
        claims = level.select(F.col("url").alias("c_url"), F.col("seq").alias("c_seq"))
        claims = claims.unionByName(fetched.where(F.size("redirects") > 0).select(F.col("final_url").alias("c_url"), F.col("seq").alias("c_seq")))
        if known is not None:
            claims = claims.unionByName(known.select(F.col("address").alias("c_url"), F.lit(-1).cast("long").alias("c_seq")))
        # The own row of a level is a claim at any seq: it beats redirects.
        own = level.select(F.col("url").alias("c_url"), F.lit(-1).cast("long").alias("c_seq"))
        first = claims.unionByName(own).groupBy("c_url").agg(F.min("c_seq").alias("c_seq"))
        fetched = fetched.join(first, F.col("final_url") == F.col("c_url"), "left")
        second = (F.size("redirects") > 0) & (F.col("c_seq") < F.col("seq"))
        fetched = fetched.withColumn("duplicate_of", F.when(second, F.col("final_url"))).drop("c_url", "c_seq")
        rows = pages_of(fetched.withColumns({"depth": F.lit(depth), "external": F.lit(False), "robots_blocked": F.lit(False)}), scope.render, renderer)
        blocked = level.where("blocked").select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in level.columns else _blank(f, depth) for f in PAGE))
        pages = keep(rows.unionByName(blocked), "crawl-pages")
        parts.append(pages)
        if on_level:
            on_level(pages, depth)
        met = pages.select(F.explode(F.array_distinct(F.array("url", "final_url"))).alias("address"))
        known = keep((met if known is None else known.unionByName(met)).distinct(), "crawl-known")
        if not scope.follow_links or depth == scope.max_depth:
            break
        snap = F.coalesce("rendered", "raw")
        found = pages.where(F.col("status").between(200, 299)).select("seq", "url", F.posexplode(snap["links"]).alias("pos", "link")).where(in_scope(F.col("link.href"), hosts, scope))
        place = F.struct(F.lit(1).cast("long").alias("a"), F.col("seq").cast("long").alias("b"), F.col("pos").cast("long").alias("c"))
        fresh = found.groupBy(F.col("link.href").alias("url")).agg(F.min(place).alias("place"), F.min_by(F.col("url"), place).alias("found_on"))
        fresh = fresh.join(known, fresh["url"] == known["address"], "left_anti").select("url", "found_on", F.lit(None).cast("string").alias("seed_source"), "place")
        level = take_budget(fresh, scope.max_pages - accepted, ["place"])
    every = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], PAGE)
    if scope.check_external and not aborted:
        every = every.unionByName(keep(check_external(every, responses, scope.max_external, done, warn), "crawl-external"))
    return every, aborted


def _blank(f, depth: int) -> Column:
    value = {"depth": depth, "external": False, "status": 0, "robots_blocked": True}.get(f.name)
    column = F.col("url") if f.name == "final_url" else F.lit(value)
    return column.cast(f.dataType).alias(f.name)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A written table in the folder that spark.checkpoint.dir names, or in a temporary one where it is unset."""
    from ..sources.store import scratch_table

    return scratch_table(df, name)


def external_targets(pages: DataFrame) -> DataFrame:
    """url, place, found_on of every distinct external link, by first mention."""
    found = pages.where(~F.coalesce("external", F.lit(False))).select("seq", "url", F.posexplode(F.coalesce("rendered", "raw")["links"]).alias("pos", "link")).where("not link.internal")
    place = F.struct(F.col("seq").cast("long").alias("b"), F.col("pos").cast("long").alias("c"))
    return found.groupBy(F.col("link.href").alias("url")).agg(F.min(place).alias("place"), F.min_by(F.col("url"), place).alias("found_on"))


def check_external(pages: DataFrame, responses: DataFrame | Callable[[DataFrame, str], DataFrame], most: int, first_seq: int, warn: Callable[[str], None] = lambda text: None) -> DataFrame:
    """Page rows (external, without content) of external targets that the crawl itself has not visited.

    HEAD first; GET where HEAD gives no answer, 405 or 501; one more GET after a
    429 that names a numeric wait of up to thirty seconds.  Targets beyond
    ``most`` are not checked; ``warn`` gets their number and the first five.
    """
    targets = external_targets(pages)
    visited = pages.select(F.explode(F.array_distinct(F.array("url", "final_url"))).alias("address")).distinct()
    open_ = targets.join(visited, F.col("url") == F.col("address"), "left_anti")
    left = open_.count() - most
    if left > 0:
        some = [r.url for r in open_.orderBy("place").offset(most).limit(5).collect()]
        warn(f"{left} external targets are not checked (maxExternal is {most}): {', '.join(some)}{' and more' if left > len(some) else ''}")
    chosen = open_.orderBy("place").limit(most)
    chosen = numbered(chosen, "place", first_seq, _kept).select("url", "found_on", "seq")
    head = follow_redirects(chosen, responses, "HEAD")
    again = F.col("status").isin(405, 501, 0)
    got = follow_redirects(head.where(again).select("url", "found_on", "seq"), responses, "GET")
    one = head.where(~again).unionByName(got)
    wait = F.expr("try_cast(headers['retry-after'] as double)")
    limited = (F.col("status") == 429) & F.coalesce((wait > 0) & (wait <= 30), F.lit(False))
    if callable(responses):
        one = _kept(one, "crawl-checked")
        later = responses(one.where(limited).select(F.col("final_url").alias("url"), wait.alias("wait_s")).dropDuplicates(["url"]), "GET")
        later = _kept(later, "crawl-again")
    else:
        later = responses.where("attempt = 2")
    second = later.select(F.col("url").alias("s_url"), F.col("status").alias("s_status")).dropDuplicates(["s_url"])
    one = one.join(second, F.col("final_url") == F.col("s_url"), "left").withColumn("status", F.when(limited & F.col("s_status").isNotNull(), F.col("s_status")).otherwise(F.col("status")))
    rows = one.withColumns({"depth": F.lit(-1), "external": F.lit(True), "robots_blocked": F.lit(False), "raw": F.lit(None).cast(SNAPSHOT), "rendered": F.lit(None).cast(SNAPSHOT), "render_error": F.lit(None), "duplicate_of": F.lit(None), "seed_source": F.lit(None)})
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in PAGE))
