"""URL normalization after the WHATWG rules for http and https, site keys and globs."""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import parse_qsl, quote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import URL

#: Campaign and click parameters that are dropped.
_TRACKING = re.compile(r"^(?:utm_.+|fbclid|gclid|msclkid|mc_cid|mc_eid)$", re.I | re.S)
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")
_PORTS = {"http": "80", "https": "443"}
_HEX = re.compile(rb"%([0-9A-Fa-f]{2})")
_BAD_HOST = frozenset("\0\t\n\r #/:<>?@[\\]^|%") | {chr(c) for c in range(32)} | {"\x7f"}
_PATH_ESCAPED, _QUERY_ESCAPED, _USER_ESCAPED = frozenset(b' "#<>?^`{}'), frozenset(b" \"#<>'"), frozenset(b' "#<>?`{}/:;=@[\\]^|')


class Url(NamedTuple):
    """Parts of a normalized address; ``host`` has the port if it is not the usual one."""

    url: str
    host: str
    hostname: str
    path: str
    origin: str


def _escape(text: str, also: frozenset[int]) -> str:
    return "".join(chr(b) if 32 < b < 127 and b not in also else f"%{b:02X}" for b in text.encode("utf-8", "surrogatepass"))


def _ipv4(host: str) -> str | None:
    """Dotted form of a numeric host, "" if it is out of range, None if it is a name."""
    parts = host.rstrip(".").split(".")
    if not re.fullmatch(r"[0-9]+|0[xX][0-9A-Fa-f]*", parts[-1]):
        return None
    numbers = []
    for part in parts:
        try:
            numbers.append(int(part, 16) if part[:2].lower() == "0x" and len(part) > 2 else 0 if part.lower() == "0x" else int(part, 8) if len(part) > 1 and part[0] == "0" else int(part))
        except ValueError:
            return ""
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return ""
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _hostname(raw: str) -> str | None:
    if raw.startswith("["):
        import ipaddress

        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") else None
        except ValueError:
            return None
    try:
        host = _HEX.sub(lambda m: bytes([int(m[1], 16)]), raw.encode()).decode()
        host = host.lower() if host.isascii() else host.encode("idna").decode().lower()
    except UnicodeError:
        return None
    if not host or any(c in _BAD_HOST for c in host):
        return None
    number = _ipv4(host)
    return host if number is None else number or None


def _path(base: list[str], raw: str) -> str:
    """Dot segments resolved over the base's segments, the rest escaped."""
    out = list(base)
    pieces = re.split(r"[/\\]", raw)
    for i, piece in enumerate(pieces):
        plain = piece.lower().replace("%2e", ".")
        final = i == len(pieces) - 1
        if plain == "..":
            if out:
                out.pop()
            if final:
                out.append("")
        elif plain == ".":
            if final:
                out.append("")
        else:
            out.append(_escape(piece, _PATH_ESCAPED))
    return "/" + "/".join(out)


def _without_tracking(query: str) -> str:
    """Unchanged without a tracking parameter; otherwise the rest is written anew as a form."""
    if not query:
        return query
    pairs = parse_qsl(query, keep_blank_values=True)
    left = [(k, v) for k, v in pairs if not _TRACKING.match(k)]
    if len(left) == len(pairs):
        return query
    return "&".join(f"{quote_plus(k, safe='*-._').replace('~', '%7E')}={quote_plus(v, safe='*-._').replace('~', '%7E')}" for k, v in left)


def parse_url(text: str | None, base: str | None = None) -> Url | None:
    """The normalized address, or None where it is no http(s) target."""
    if text is None:
        return None
    text = re.sub(r"[\t\n\r]", "", text.strip().strip("".join(map(chr, range(33)))))
    text = text.partition("#")[0]
    root = parse_url(base) if base else None
    scheme = _SCHEME.match(text)
    relative = None
    if scheme:
        kind = scheme[0][:-1].lower()
        if kind not in _PORTS:
            return None
        rest = text[scheme.end() :]
        if root and root.origin.startswith(kind + ":") and not re.match(r"[/\\]", rest):
            relative = rest
        else:
            rest = re.sub(r"^[/\\]*", "", rest)
    elif root is None:
        return None
    else:
        kind = root.origin.partition(":")[0]
        if re.match(r"[/\\]{2}", text):
            rest = re.sub(r"^[/\\]*", "", text)
        else:
            relative = text
    user = ""
    if relative is None:
        cut = re.search(r"[/\\?]", rest)
        authority, tail = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
        credentials, at, place = authority.rpartition("@")
        if at and credentials not in ("", ":"):
            name, colon, secret = credentials.partition(":")
            user = _escape(name, _USER_ESCAPED) + (":" + _escape(secret, _USER_ESCAPED) if colon and secret else "") + "@"
        found = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", place)
        hostname = _hostname(found[1]) if found else None
        if not hostname:
            return None
        port = (found[2] or "").lstrip("0") or ("0" if found[2] else "")
        if port and int(port) > 65535:
            return None
        host = hostname if port in ("", _PORTS[kind]) else f"{hostname}:{port}"
        base_path: list[str] = []
        where, question, query = tail.partition("?")
        path = _path([], where[1:]) if where else "/"
    else:
        host, hostname = root.host, root.hostname
        where, question, query = relative.partition("?")
        if re.match(r"[/\\]", where):
            path = _path([], where[1:])
        elif where:
            base_path = root.path[1:].split("/")[:-1]
            path = _path(base_path, where)
        else:
            path = root.path
            if not question:
                question, query = ("?", root.url.partition("?")[2]) if "?" in root.url else ("", "")
    query = _without_tracking(_escape(query, _QUERY_ESCAPED))
    origin = f"{kind}://{host}"
    return Url(f"{kind}://{user}{host}{path}{'?' + query if query else ''}" if question else f"{kind}://{user}{host}{path}", host, hostname, path, origin)


def normalize_url(text: str | None, base: str | None = None) -> str | None:
    found = parse_url(text, base)
    return found.url if found else None


@F.pandas_udf(URL)
def url_parts(text: pd.Series) -> pd.DataFrame:
    """Normalized address and its parts; all null where there is none."""
    rows = [parse_url(t) if isinstance(t, str) else None for t in text]
    return pd.DataFrame([tuple(r) if r else (None,) * 5 for r in rows], columns=list(Url._fields))


def site_key_text(hostname: str) -> str:
    return re.sub(r"^www\.", "", hostname.lower())


def site_key(hostname: Column) -> Column:
    """Lower case without one leading ``www.``."""
    return F.regexp_replace(F.lower(hostname), r"^www\.", "")


def hostname_of(url: Column) -> Column:
    """Host name of an absolute address, null where there is none; JVM only."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """Path of a normalized address, ``/`` where it is empty."""
    found = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def glob_pattern(glob: str) -> str:
    """Java pattern of a path glob: ``**`` any text, ``*`` and ``?`` within a segment."""
    out, at = [], 0
    while at < len(glob):
        if glob.startswith("**", at):
            out.append(".*")
            at += 2
            continue
        c = glob[at]
        out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "/_" else f"\\x{{{ord(c):x}}}")
        at += 1
    return rf"(?s)\A(?:{''.join(out)})\z"


def is_html(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).rlike("text/html|application/xhtml"), F.lit(False))


def is_text(content_type: Column) -> Column:
    """Content types whose bodies are read."""
    return F.coalesce(content_type.rlike(r"(?i)^(?:text/|application/(?:xhtml\+xml|xml|json|ld\+json|rss\+xml|atom\+xml))"), F.lit(False))
