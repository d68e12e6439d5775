"""Live fetching with an injected opener and clock, and the command line over recorded and fetched pages."""

import gzip
import json

import pytest

from auditlake import cli
from auditlake.operators.crawl import Scope, crawl
from auditlake.plans.config import load_config
from auditlake.sources import inputs
from auditlake.sources.live import HostQueue, LiveResponses, Manners, gaps, serve
from auditlake.sources.store import Store


def test_hosts_take_turns_and_keep_their_gap():
    queue = HostQueue(2, gaps(Manners(delay_ms=100), {"slow": 1000}))
    for host, item in (("a", 1), ("a", 2), ("a", 3), ("slow", 4), ("slow", 5)):
        queue.add(host, item)
    assert [queue.take(0.0) for _ in range(3)] == [("a", 1), ("slow", 4), None]  # a cold host gets one request
    assert queue.soonest() is None
    queue.release("a")
    assert queue.take(0.05) is None and queue.soonest() == pytest.approx(0.1)
    assert queue.take(0.1) == ("a", 2) and queue.take(0.2) == ("a", 3)  # two at once when it has answered
    queue.release("slow")
    assert queue.take(0.9) is None and queue.take(1.0) == ("slow", 5)
    queue.add("a", 6)
    queue.close()
    assert queue.take(9.0) is None and queue.soonest() is None


def test_a_slow_host_does_not_hold_up_others():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    queue = HostQueue(1, gaps(Manners(delay_ms=10), {"slow": 5000}))
    for k in range(6):
        queue.add("slow" if k < 2 else "fast", k)
    order = list(serve(queue, lambda item: item, 1, lambda: now[0], sleep))
    assert sorted(order) == list(range(6)) and order[-1] == 1 and now[0] == pytest.approx(5.0, abs=0.2) and max(slept) > 4


SITE = {
    "https://a.example/robots.txt": (200, "text/plain", "User-agent: *\nDisallow: /private\nCrawl-delay: 0.05", None),
    "https://a.example/": (200, "text/html", '<title>Home</title><a href="/b">b</a><a href="/private">p</a><a href="/old">o</a><a href="/gone">g</a><a href="https://x.example/limited">x</a><a href="https://x.example/dead">d</a>', None),
    "https://a.example/b": (200, "text/html", "<title>B</title>", None),
    "https://a.example/old": (301, "text/html", "", "/b"),
    "https://x.example/dead": (0, None, None, None),
}


def opener():
    site, asked = dict(SITE), {}

    def one(url, method="GET", timeout=20, agent=""):
        asked[url] = asked.get(url, 0) + 1
        if url == "https://x.example/limited":
            status, headers = (429, {"retry-after": "0.01"}) if method == "HEAD" else (200, {})
            return url, method, 1, status, "text/html", headers, None, 1, None
        status, kind, body, target = site.get(url, (404, "text/html", "none", None))
        return url, method, 1, status, kind, {"location": target} if target else {}, body, 1, "timeout" if status == 0 else None

    return one


def test_live_crawl(spark):
    seeds = spark.createDataFrame([("https://a.example", "url", 0)], "url string, source string, pos long")
    live = LiveResponses(Manners(delay_ms=1), opener())
    levels = []
    pages, aborted = crawl(spark, seeds, live, Scope(check_external=True), on_level=lambda p, depth: levels.append((depth, p.count())))
    got = {r.url: r for r in pages.collect()}
    assert not aborted and levels == [(0, 1), (1, 4)] and live.delays == {"a.example": 50}
    assert got["https://a.example/"].raw.title == "Home" and got["https://a.example/private"].robots_blocked
    assert got["https://a.example/old"].duplicate_of == "https://a.example/b" and got["https://a.example/gone"].status == 404
    assert got["https://x.example/limited"].status == 200 and (got["https://x.example/dead"].status, got["https://x.example/dead"].error) == (0, "timeout")
    assert sorted(r.seq for r in got.values()) == list(range(len(got)))


def test_renderer_and_skipped_external_targets(spark):
    seeds = spark.createDataFrame([("https://a.example", "url", 0)], "url string, source string, pos long")
    told = []

    def renderer(url):
        if url.endswith("/b"):
            raise RuntimeError("no browser")
        return SITE[url][2].replace("Home", "Rendered")

    pages, _ = crawl(spark, seeds, LiveResponses(Manners(delay_ms=1), opener()), Scope(check_external=True, max_external=1), renderer=renderer, warn=told.append)
    got = {r.url: r for r in pages.collect()}
    assert got["https://a.example/"].rendered.title == "Rendered" and got["https://a.example/gone"].rendered is None
    assert got["https://a.example/b"].render_error == "no browser" and got["https://a.example/b"].rendered is None
    assert told == ["1 external targets are not checked (maxExternal is 1): https://x.example/dead"] and "https://x.example/dead" not in got


def test_command_line_over_recorded_pages(spark, tmp_path, capsys):
    one = opener()
    rows = [one(u) for u in SITE] + [one("https://a.example/gone")]
    spark.createDataFrame(rows, inputs.RESPONSES).write.parquet(str(tmp_path / "answers"))
    (tmp_path / "sitemap.xml").write_bytes(gzip.compress(b'<urlset xmlns="s"><url><loc> https://A.example/b?utm_source=q#x </loc></url><url><loc>mailto:no</loc></url></urlset>'))
    (tmp_path / "list.txt").write_text("# none\n\nhttps://a.example/b\n")
    (tmp_path / "c.yaml").write_text(f"name: t\nstart:\n  urls: [https://a.example]\n  urlFile: {tmp_path}/list.txt\n  sitemaps: ['file://{tmp_path}/sitemap.xml']\npoliteness:\n  delayMs: 1\noutput:\n  db: {tmp_path}/store\n")
    assert load_config(str(tmp_path / "c.yaml"), {"scope.maxDepth": 2}).scope.maxDepth == 2
    code = cli.main(["crawl", "-c", str(tmp_path / "c.yaml"), "--responses", str(tmp_path / "answers"), "--fail-on", "error", "--json", str(tmp_path / "r.json"), "--sarif", str(tmp_path / "r.sarif"), "--html", str(tmp_path / "r.html")], spark)
    out = capsys.readouterr()
    assert code == 1 and "not an address, left out: mailto:no" in out.err
    store = Store(spark, f"{tmp_path}/store")
    found = {(r.rule_id, r.url) for r in store.findings(1).collect()}
    assert ("status-ok", "https://a.example/gone") in found and ("missing-from-sitemap", "https://a.example/b") not in found and ("missing-from-sitemap", "https://a.example/") in found
    assert store.pages(1).where("robots_blocked").count() == 1 and json.loads((tmp_path / "r.sarif").read_text())["version"] == "2.1.0"
    assert cli.main(["runs", "--db", f"{tmp_path}/store"], spark) == 0 and cli.main(["report", "1", "--db", f"{tmp_path}/store"], spark) == 0
    assert cli.main(["rules"], spark) == 0 and "fetch-error" in capsys.readouterr().out
    assert cli.main(["diff", "--db", f"{tmp_path}/store"], spark) == 2 and cli.main(["diff", "1", "1", "--db", f"{tmp_path}/store"], spark) == 0
    assert cli.main(["crawl"], spark) == 2


def test_sitemap_index_is_read_breadth_first():
    files = {"s": b"<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>b</loc></sitemap><sitemap><loc>a</loc></sitemap></sitemapindex>", "a": b"<urlset><url><loc>1</loc></url></urlset>", "b": b"<urlset><url><loc>2</loc></url><url><loc>3</loc></url></urlset>"}
    assert inputs.load_sitemap("s", files.__getitem__) == ["1", "2", "3"] and inputs.load_sitemap("s", files.__getitem__, 2) == ["1", "2"]
    with pytest.raises(ValueError):
        inputs.parse_sitemap(b"<other/>")
