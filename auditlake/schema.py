"""Fixed schemas of pages, snapshots, findings and runs."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _INT, _LONG, _BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


HEADING = _struct(level=_INT, text=_STRING)
HREFLANG = _struct(lang=_STRING, href=_STRING)
LINK = _struct(href=_STRING, text=_STRING, rel=_STRING, internal=_BOOL, nofollow=_BOOL)
IMAGE = _struct(src=_STRING, alt=_STRING)
HOP = _struct(url=_STRING, status=_INT)
STRINGS, STRING_MAP = T.ArrayType(_STRING), T.MapType(_STRING, _STRING)
SNAPSHOT = _struct(
    status=_INT, time_ms=_LONG, bytes=_LONG, title=_STRING, meta_description=_STRING, meta_robots=_STRING, canonical=_STRING, lang=_STRING, h1=STRINGS,
    headings=T.ArrayType(HEADING), hreflang=T.ArrayType(HREFLANG), og=STRING_MAP, json_ld_types=STRINGS, json_ld_errors=_INT,
    links=T.ArrayType(LINK), images=T.ArrayType(IMAGE), word_count=_INT,
)
PAGE = _struct(
    seq=_LONG, url=_STRING, final_url=_STRING, depth=_INT, found_on=_STRING, seed_source=_STRING, external=_BOOL, status=_INT, content_type=_STRING, headers=STRING_MAP,
    redirects=T.ArrayType(HOP), robots_blocked=_BOOL, duplicate_of=_STRING, error=_STRING, render_error=_STRING, raw=SNAPSHOT, rendered=SNAPSHOT,
)
FINDING = _struct(rule_id=_STRING, severity=_STRING, url=_STRING, message=_STRING)
RUN = _struct(id=_LONG, name=_STRING, started_at=T.TimestampType(), finished_at=T.TimestampType(), config=_STRING, pages=_LONG, findings=_LONG, aborted=_BOOL)
URL = _struct(url=_STRING, host=_STRING, hostname=_STRING, path=_STRING, origin=_STRING)

SEVERITIES = ("error", "warning", "info")
EXTERNAL_DEPTH = -1
