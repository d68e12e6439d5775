"""Sitemaps, URL lists, and fetching of live pages behind the recorded-response schema."""

from __future__ import annotations

import gzip
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import normalize_url

SITEMAP_CAP = 50_000
RESPONSES = "url string, method string, attempt int, status int, content_type string, headers map<string,string>, body string, time_ms long, error string"


def parse_sitemap(content: bytes) -> tuple[list[str], list[str]]:
    """(addresses, child sitemaps) of one file, gzip recognised by its first bytes."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    root = ElementTree.fromstring(content)
    places = {"urlset": [], "sitemapindex": []}
    kind = root.tag.rpartition("}")[2]
    if kind not in places:
        raise ValueError(f"not a sitemap: <{kind}>")
    for child in root:
        for part in child:
            if part.tag.rpartition("}")[2] == "loc" and part.text:
                places[kind].append(part.text.strip())
    return places["urlset"], places["sitemapindex"]


def load_sitemap(start: str, read: Callable[[str], bytes], cap: int = SITEMAP_CAP) -> list[str]:
    """Breadth-first through indexes, every sitemap once; any failure fails the whole tree."""
    queue, seen, found = [start], {start}, []
    while queue and len(found) < cap:
        addresses, children = parse_sitemap(read(queue.pop(0)))
        found += addresses
        for child in children:
            if child not in seen:
                seen.add(child)
                queue.append(child)
    return found[:cap]


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file without blanks and comments: url, source, pos."""
    rows = spark.read.text(path).select(F.trim("value").alias("url"), F.monotonically_increasing_id().alias("pos")).where("url <> '' and not startswith(url, '#')")
    return rows.select("url", F.lit("file").alias("source"), "pos")


def seeds(spark: SparkSession, urls: list[str] = (), files: list[str] = (), sitemaps: list[str] = (), read: Callable[[str], bytes] | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """(seeds, normalized sitemap addresses, warnings): a source that fails and a text that is no address are warned about and left out."""
    rows, listed, warnings = [(u, "url", i) for i, u in enumerate(urls)], [], []
    made = []
    for path in files:
        try:
            frame = url_list(spark, path)
            frame.limit(1).count()
            made.append(frame)
        except Exception as problem:  # an unreadable source must not end the crawl
            warnings.append(f"{path}: {str(problem).splitlines()[0]}")
    for place in sitemaps:
        try:
            listed += load_sitemap(place, read or fetch_bytes)
        except Exception as problem:
            warnings.append(f"{place}: {problem}")
    rows += [(u, "sitemap", i) for i, u in enumerate(listed)]
    warnings += [f"not an address, left out: {u}" for u, _, _ in rows if normalize_url(u) is None]
    listed = [n for u in listed if (n := normalize_url(u)) is not None]
    frame = spark.createDataFrame(rows, "url string, source string, pos long")
    for other in made:
        frame = frame.unionByName(other)
    return frame, listed, warnings


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_args, **_more):
        return None


_OPENER = urllib.request.build_opener(_NoRedirect)


def fetch_bytes(url: str, timeout: float = 20) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read()


def fetch(url: str, method: str = "GET", timeout: float = 20, agent: str = "auditlake") -> tuple:
    """One request without following redirects, as a response row; network errors have status 0."""
    began = time.monotonic()
    request = urllib.request.Request(url, method=method, headers={"User-Agent": agent})
    try:
        answer = _OPENER.open(request, timeout=timeout)
    except urllib.error.HTTPError as answered:
        answer = answered
    except Exception as problem:  # whatever the network does is a result
        return url, method, 1, 0, None, {}, None, round(1000 * (time.monotonic() - began)), str(problem)
    with answer:
        headers = {k.lower(): v for k, v in answer.headers.items()}
        kind = headers.get("content-type", "")
        textual = any(t in kind for t in ("text/", "html", "xml", "json"))
        body = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace") if method == "GET" and textual else None
        return url, method, 1, answer.status, kind, headers, body, round(1000 * (time.monotonic() - began)), None
