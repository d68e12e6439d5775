"""Rules, crawl, store and diff on recorded sites."""

import json

import pytest
from pyspark.sql import functions as F

from auditlake import queries
from auditlake.functions.html import extract
from auditlake.operators.crawl import Scope, crawl
from auditlake.operators.diff import diff_runs
from auditlake.operators.site import SiteContext
from auditlake.plans.engine import run_rules
from auditlake.plans.model import RuleError, load_rules
from auditlake.plans.plugins import Plugin
from auditlake.sources.store import Store

HOST = "https://site.example"


def html(title=None, head="", body=""):
    return f"<html lang=en><head>{f'<title>{title}</title>' if title else ''}{head}</head><body>{body}</body></html>"


SITE = {
    "/": (200, html("Start page", f'<link rel=canonical href="{HOST}/">', "<h1>S</h1>" + "".join(f'<a href="{p}">x</a>' for p in ("/a", "/b", "/old", "/private", "/gone", "https://other.example/x")) + "<img src=i>")),
    "/a": (200, html("Same", "<meta name=description content=d>", "<h1>1</h1><h1>2</h1>")),
    "/b": (200, html("Same", '<link rel=canonical href="/gone"><link rel=alternate hreflang=de href="/a"><link rel=alternate hreflang=zz1 href="/b">')),
    "/old": (301, "/a"),
    "/gone": (404, html("Gone")),
    "/map": (200, html("Only in the map")),
    "/loop": (302, "/loop"),
}


@pytest.fixture(scope="module")
def responses(spark):
    rows = [(HOST + p, "GET", 1, s, "text/html", {"location": b} if s in (301, 302) else {}, None if s in (301, 302) else b, 5) for p, (s, b) in SITE.items()]
    rows += [("https://other.example/x", "HEAD", 1, 405, "text/html", {}, None, 1), ("https://other.example/x", "GET", 1, 429, "text/html", {"retry-after": "1"}, None, 1), ("https://other.example/x", "GET", 2, 200, "text/html", {}, None, 1)]
    return spark.createDataFrame(rows, "url string, method string, attempt int, status int, content_type string, headers map<string,string>, body string, time_ms long")


@pytest.fixture(scope="module")
def pages(spark, responses):
    seeds = spark.createDataFrame([(HOST, "url", 0), (HOST + "/map", "sitemap", 1), (HOST + "/loop", "file", 2), (HOST + "/", "sitemap", 3)], "url string, source string, pos long")
    made, aborted = crawl(spark, seeds, responses, Scope(check_external=True), {HOST: "User-agent: *\nDisallow: /private"})
    assert not aborted
    return made.cache()


def test_crawl(pages):
    got = {r.url.removeprefix(HOST): r for r in pages.collect()}
    assert {k: r.status for k, r in got.items()} == {"/": 200, "/map": 200, "/loop": 0, "/a": 200, "/b": 200, "/old": 200, "/private": 0, "/gone": 404, "https://other.example/x": 200}
    assert got["/old"].duplicate_of == HOST + "/a" and got["/old"].raw is None
    assert got["/private"].robots_blocked and got["/loop"].error == "redirect loop"
    assert got["/"].seed_source == "url" and got["/a"].depth == 1 and got["/a"].found_on == HOST + "/"
    assert got["https://other.example/x"].external


def test_rules_on_the_site(spark, pages):
    found = run_rules(pages, load_rules(), SiteContext(spark.createDataFrame([(HOST + "/map",)], "url string")))
    got = {(r.rule_id, r.url.removeprefix(HOST)) for r in found.collect()}
    for wanted in [("fetch-error", "/loop"), ("status-ok", "/gone"), ("h1-single", "/a"), ("image-alt", "/"), ("duplicate-title", "/a"), ("duplicate-title", "/b"), ("broken-internal-link", "/"), ("redirecting-internal-link", "/"), ("canonical-target", "/b"), ("hreflang", "/b"), ("hreflang-x-default", "/b"), ("orphan-from-sitemap", "/map"), ("missing-from-sitemap", "/a")]:
        assert wanted in got, wanted
    assert not any(url == "/private" for _, url in got)
    assert ("missing-from-sitemap", "/map") not in got and ("broken-external-link", "/") not in got


def test_page_budget_and_depth(spark, responses):
    seeds = spark.createDataFrame([(HOST, "url", 0)], "url string, source string, pos long")
    assert crawl(spark, seeds, responses, Scope(max_pages=3))[0].count() == 3
    assert crawl(spark, seeds, responses, Scope(max_depth=0))[0].count() == 1
    made, aborted = crawl(spark, seeds, responses, Scope(), should_stop=lambda: True)
    assert aborted and made.count() == 0


def test_rule_files():
    with pytest.raises(RuleError) as problem:
        load_rules([{"rules": [{"id": "x", "check": {"field": "title", "exsts": True}}, {"id": "y", "check": {"field": "title", "matches": "("}}, {"id": "z", "check": {"exists": True}}]}])
    assert len(problem.value.problems) == 3
    rules = load_rules(["builtin:default", {"rules": [{"id": "title", "severity": "info", "check": {"field": "title", "length": {"min": 2}}}]}], {"lang": {"enabled": False}, "noindex": {"severity": "error"}})
    by_id = {r.id: r for r in rules.rules}
    assert len(load_rules().rules) == 30 and "lang" not in by_id and by_id["noindex"].severity == "error" and by_id["title"].severity == "info"
    assert [r.id for r in rules.rules].index("title") == 4


def test_plugins(spark, pages):
    def broken(page):
        raise ValueError("no")

    rules = load_rules([{"rules": []}])
    rules.plugins = [Plugin("one", check_page=lambda p: "bad" if p["status"] == 404 else None), Plugin("two", check_page=broken), Plugin("three", severity="info", check_site=lambda t: t.where("status = 0").select("url", F.lit("none").alias("message"))), Plugin("four", check_site=lambda t: t.select("nope"))]
    got = [(r.rule_id, r.severity, r.url.removeprefix(HOST)) for r in run_rules(pages, rules).collect()]
    assert ("one", "warning", "/gone") in got and ("three", "info", "/loop") in got and ("four", "error", "") in got
    assert sum(g[:2] == ("two", "error") for g in got) == 8


def test_store_and_diff(spark, pages, tmp_path):
    store = Store(spark, str(tmp_path))
    first = store.start_run("x", {"a": 1})
    store.save_pages(first, pages)
    store.save_pages(first, pages.where("depth = 0").withColumns({"seq": F.col("seq") + 100, "status": F.lit(500)}))
    store.finish_run(first, spark.createDataFrame([("r", "error", HOST + "/", "m"), ("r", "error", HOST + "/a", "m")], "rule_id string, severity string, url string, message string"))
    second = store.start_run("x", {})
    store.save_pages(second, pages.where(F.col("url") != HOST + "/map"))
    store.finish_run(second, spark.createDataFrame([("r", "info", HOST + "/", "other")], "rule_id string, severity string, url string, message string"))
    assert store.diff_pair() == (first, second) and [r.id for r in store.runs().collect()] == [second, first]
    assert store.runs().first().pages == 8 and store.pages(first).where("status = 500").count() == 3
    diff = diff_runs(store.pages(first), store.pages(second), store.findings(first), store.findings(second))
    assert [r.url for r in diff.removed.collect()] == [HOST + "/map"] and diff.added.count() == 0
    assert {(r.url, r.field, r.before, r.after) for r in diff.changes.collect()} == {(HOST + "/", "status", "500", "200"), (HOST + "/loop", "status", "500", "0")}
    assert [r.url for r in diff.resolved_findings.collect()] == [HOST + "/a"] and diff.new_findings.count() == 0


def test_reports(spark, pages):
    from auditlake.sources import reports

    found = run_rules(pages, load_rules())
    summary = reports.summarize(pages, found, load_rules())
    assert summary["pages"] == 8 and summary["external"] == 1
    assert "duplicate-title" in reports.as_text(summary) and reports.as_markdown(summary).startswith("# ")
    sarif = json.loads(reports.as_sarif(found, load_rules()))
    assert sarif["version"] == "2.1.0" and {r["level"] for r in sarif["runs"][0]["results"]} <= {"error", "warning", "note"}
    page = reports.as_html(summary, pages, found)
    assert "<script" in page and "http://" not in page.split("</style>")[0]
    assert reports.annotations(found).startswith("::error")


def test_crawl_command_respects_robots(spark, responses, tmp_path):
    from auditlake.cli import main

    robots = "User-agent: *\nDisallow: /b\n\nUser-agent: checker\nDisallow: /a\n"
    extra = [(HOST + "/robots.txt", "GET", 1, 301, "text/plain", {"location": "/rules.txt"}, None, 1), (HOST + "/rules.txt", "GET", 1, 200, "text/plain", {}, robots, 1), ("https://other.example/robots.txt", "GET", 1, 404, "text/plain", {}, "User-agent: *\nDisallow: /", 1)]
    responses.unionByName(spark.createDataFrame(extra, responses.schema)).write.parquet(str(tmp_path / "responses"))
    blocked = {}
    for agent, respect in (("Checker/1.0", "true"), ("someone", "true"), ("Checker/1.0", "false")):
        folder = tmp_path / f"{agent[:4]}-{respect}"
        folder.mkdir()
        (folder / "site.yaml").write_text(f"start: {{urls: ['{HOST}/', 'https://other.example/x']}}\npoliteness: {{respectRobots: {respect}, userAgent: {agent}}}\n")
        assert main(["crawl", "-c", str(folder / "site.yaml"), "--responses", str(tmp_path / "responses")], spark) == 0
        pages = Store(spark, str(folder / "audit-store")).pages(1).collect()
        blocked[agent, respect] = {r.url.removeprefix(HOST) for r in pages if r.robots_blocked}
        assert all(r.status == 0 and r.raw is None for r in pages if r.robots_blocked)
    assert blocked == {("Checker/1.0", "true"): {"/a"}, ("someone", "true"): {"/b"}, ("Checker/1.0", "false"): set()}


def test_diff_report_lists_every_row(spark):
    from auditlake.operators.diff import RunDiff
    from auditlake.sources import reports

    pages = spark.range(1205).select(F.format_string("https://a.de/%05d", "id").alias("url"))
    none = pages.where("false")
    diff = RunDiff(pages, none, none, none, pages.withColumn("rule_id", F.lit("r")).select("rule_id", "url"))
    lines = reports.diff_text(diff, "run 1", "run 2").split("\n")
    urls = [f"https://a.de/{i:05d}" for i in range(1205)]
    assert lines == ["run 1 to run 2", "", "Added (1205)", *urls, "", "Removed (0)", "", "Changed (0)", "", "New findings (0)", "", "Resolved findings (1205)", *(f"r {u}" for u in urls)]
    assert reports.diff_text(diff, "run 1", "run 2", True, True).count("\n- ") == 2410


def test_unclosed_references_agree_with_sql(spark, tmp_path):
    """A title cut inside a reference: the queries give what their SQL gives, the reader what browsers do."""
    import duckdb

    titles = ["a &amp;&amp; b &amp", "x" * 26 + "&amp", "&lt &ltb; &gt; &#x27;", "&copy 2 & 3 &b=1", "&amp;amp", "plain", "&quot;" * 7 + "&quo"]
    body = "<p>one&nbsp;two &amp three</p>" + '<a href="/a?b=1&c=2&amp;d=3">x</a>'
    rows = [(i, f"https://a.example/{i}", f'<html lang="en"><head><title>{t}</title></head><body><h1>{t}</h1>{body}</body></html>') for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        for name in ("extract_title", "extract_h1", "pack_page_findings", "word_count", "extract_links"):
            got = sorted(map(tuple, queries.queries()[name](spark, str(tmp_path)).collect()))
            assert got == sorted(con.execute(queries.oracle_sql()[name]).fetchall()), name
    assert extract("<title>a &amp</title>", "https://a.example/")["title"] == "a &"
