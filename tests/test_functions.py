"""Unit tests of URL, pattern and HTML functions."""

import pytest

from auditlake.functions.html import extract
from auditlake.functions.patterns import PatternError, java_pattern
from auditlake.functions.urls import glob_pattern, normalize_url
from auditlake.sources.robots import delay_ms, is_allowed


@pytest.mark.parametrize(
    ("text", "base", "wanted"),
    [
        ("https://a.de", None, "https://a.de/"),
        ("HTTP://A.de:80/x/../y/./z?b=1#q", None, "http://a.de/y/z?b=1"),
        ("https://a.de/ä b", None, "https://a.de/%C3%A4%20b"),
        ("https://münchen.de/", None, "https://xn--mnchen-3ya.de/"),
        ("mailto:x@y", None, None),
        ("https://a.de/?utm_source=x&b=1 2", None, "https://a.de/?b=1+2"),
        ("https://a.de/?b=1%202", None, "https://a.de/?b=1%202"),
        ("https://a.de/?GCLID=1", None, "https://a.de/"),
        ("http://a.de:99999/", None, None),
        ("http://0x7f.1/", None, "http://127.0.0.1/"),
        ("?q", "https://a.de", "https://a.de/?q"),
        ("../c", "https://a.de/x/y/z", "https://a.de/x/c"),
        ("//b.de/x", "https://a.de/", "https://b.de/x"),
        ("", "http://a.de/q?x", "http://a.de/q?x"),
        ("x", None, None),
        (None, None, None),
    ],
)
def test_normalize_url(text, base, wanted):
    assert normalize_url(text, base) == wanted


def test_extract_reads_what_rules_need():
    page = extract(
        '<html lang=de><head><title>a <b>x</b> &amp; c</title><meta name=Description content=" d  e"><link rel="x canonical" href=/c><base href="/base/">'
        '<script type="application/ld+json">{"@graph":[{"@type":["A","B"]}]}</script><script type="application/ld+json">{</script></head>'
        '<body><h1>H</h1><h2></h2><p>a</p><p>b c</p><a href=x rel="NoFollow">t<b>u</b></a><a href="mailto:q">m</a><img src=i><img alt="" data-src=j><svg><text>no</text></svg></body>',
        "https://www.a.de/q",
    )
    assert (page["title"], page["meta_description"], page["canonical"], page["lang"]) == ("a <b>x</b> & c", "d e", "https://www.a.de/c", "de")
    assert page["headings"] == [{"level": 1, "text": "H"}, {"level": 2, "text": ""}] and page["h1"] == ["H"]
    assert page["json_ld_types"] == ["A", "B"] and page["json_ld_errors"] == 1
    assert page["links"] == [{"href": "https://www.a.de/base/x", "text": "tu", "rel": "nofollow", "internal": True, "nofollow": True}]
    assert [i["alt"] for i in page["images"]] == [None, ""]


@pytest.mark.parametrize("broken", ["", "<", "<title>", "<title>x", "<a href='", "<!-- x", "<p a=\"", "&am", "<script>x"])
def test_extract_never_fails(broken):
    assert extract(broken, "https://a.de/")["links"] == []


def test_patterns(spark):
    assert java_pattern("/a$/") == r"a\z"
    with pytest.raises(PatternError):
        java_pattern("(")
    rows = spark.createDataFrame([("änoindex",), ("ÄPFEL",), ("x\n",)], "t string")
    from pyspark.sql import functions as F

    got = rows.select(F.col("t").rlike(java_pattern(r"\bnoindex")), F.col("t").rlike(java_pattern("äpfel")), F.col("t").rlike(java_pattern("x$"))).collect()
    assert [list(r) for r in got] == [[True, False, True], [False, True, False], [False, False, False]]


def test_globs_and_robots():
    import re

    def match(glob, text):
        return bool(re.search(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), glob_pattern(glob)).replace(r"\z", r"\Z"), text))

    assert match("/a/**", "/a/b/c") and match("/a/*", "/a/b") and not match("/a/*", "/a/b/c") and match("/?.x", "/q.x")
    text = "User-agent: *\nDisallow: /p\nAllow: /p/ok$\nCrawl-delay: 1.5\nUser-agent: bad\nDisallow: /"
    assert not is_allowed(text, "/p/x") and is_allowed(text, "/p/ok") and is_allowed(text, "/") and not is_allowed(text, "/", "bad")
    assert delay_ms(text) == 1500


def test_shown_values_are_cut_by_utf16_units(spark):
    from auditlake.functions.fields import Field
    from auditlake.plans.checks import show

    texts = ["x" * 88, "x" * 89, "🙂" * 60, "x" + "🙂" * 60, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    shown = [r.v for r in rows.orderBy("i").select(show(Field("string", rows["t"])).alias("v")).collect()]
    assert shown == [f'"{"x" * 88}"', f'"{"x" * 86}…', f'"{"🙂" * 43}…', f'"x{"🙂" * 42}…', "null"]
