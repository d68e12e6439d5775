"""Tolerant HTML reading: one pass of a small tokenizer, no tree."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SNAPSHOT
from .urls import parse_url, site_key_text

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*>?|(/?)([A-Za-z][^\s/>\0]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"?|'[^']*'?)?|\"|')*)>?)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?", re.S)
_SPACE = re.compile("[\\s\\ufeff]+")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_HIDDEN = frozenset("script style noscript template svg".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def collapse(text: str | None) -> str | None:
    """White space to single spaces, trimmed; nothing left is None."""
    return _SPACE.sub(" ", text).strip(" ") or None if text is not None else None


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """("text", data, ""), ("open", name, attributes) and ("close", name, ""); raw elements give their content as text."""
    at, n = 0, len(source)
    while at < n:
        less = source.find("<", at)
        if less < 0:
            yield "text", source[at:], ""
            return
        if less > at:
            yield "text", source[at:less], ""
        found = _TAG.match(source, less)
        if not found:
            yield "text", "<", ""
            at = less + 1
            continue
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if not found[0].endswith(">"):  # cut off by the end of the document
            return
        if found[1]:
            yield "close", name, ""
            continue
        yield "open", name, found[3] or ""
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            stop = end.start() if end else n
            yield ("text" if name in ("title", "textarea") else "raw"), source[at:stop], ""
            yield "close", name, ""
            at = end.end() if end else n


def attributes(text: str) -> dict[str, str]:
    """First of each name wins; names in lower case, values with entities resolved."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        out.setdefault(m[1].lower(), html.unescape(value))
    return out


def _types(value, out: list[str]) -> None:
    if isinstance(value, list):
        for part in value:
            _types(part, out)
    elif isinstance(value, dict):
        kind = value.get("@type")
        out += [kind] if isinstance(kind, str) else [k for k in kind if isinstance(k, str)] if isinstance(kind, list) else []
        if "@graph" in value:
            _types(value["@graph"], out)


def _no_constant(name: str):
    raise ValueError(name)


def extract(source: str, page_url: str, status: int | None = None, time_ms: int | None = None, size: int | None = None) -> dict:
    """Everything rules see of one document; absent parts are None or empty, never an error."""
    found = {"title": None, "meta_description": None, "meta_robots": None, "canonical": None, "lang": None, "h1": [], "headings": [], "hreflang": [], "og": {}, "json_ld_types": [], "json_ld_errors": 0, "links": [], "images": []}
    pending: list[tuple] = []  # addresses wait for <base>
    base: str | None = None
    seen: set[str] = set()
    hidden: list[str] = []
    heading: tuple[int, list[str]] | None = None
    anchor: tuple[dict, list[str]] | None = None
    title: list[str] | None = None
    json_ld = False
    words: list[str] = []
    in_body = False

    def close_heading() -> None:
        nonlocal heading
        if heading:
            found["headings"].append({"level": heading[0], "text": collapse("".join(heading[1])) or ""})
        heading = None

    def close_anchor() -> None:
        nonlocal anchor
        if anchor:
            pending.append(("a", anchor[0], collapse("".join(anchor[1])) or ""))
        anchor = None

    for kind, value, rest in tokens(source):
        if kind == "text":
            plain = html.unescape(value)
            if title is not None:
                title.append(plain)
            elif not hidden:
                if heading:
                    heading[1].append(plain)
                if anchor:
                    anchor[1].append(plain)
                if in_body or plain.strip():
                    in_body = True
                    words.append(plain)
        elif kind == "raw":
            if json_ld:
                try:
                    _types(json.loads(value, parse_constant=_no_constant), found["json_ld_types"])
                except (ValueError, RecursionError):
                    found["json_ld_errors"] += 1
        elif kind == "open":
            own = attributes(rest) if rest else {}
            if value in ("template", "svg", "noscript") and not rest.rstrip().endswith("/"):
                hidden.append(value)
            json_ld = value == "script" and own.get("type", "").strip().lower() == "application/ld+json"
            if value in _HIDDEN or hidden and hidden[0] in ("template",):
                continue
            if value == "title" and "title" not in seen and not hidden:
                title = []
            elif value == "html" and "lang" not in seen:
                seen.add("lang")
                found["lang"] = collapse(own.get("lang"))
            elif value == "body":
                in_body = True
            elif value == "base" and base is None and "href" in own:
                base = own["href"]
            elif value == "meta":
                name = own.get("name", "").lower()
                if name in ("description", "robots") and name not in seen:
                    seen.add(name)
                    found[f"meta_{name}"] = collapse(own.get("content"))
                if own.get("property", "").startswith("og:") and (content := collapse(own.get("content"))):
                    found["og"][own["property"]] = content
            elif value == "link":
                rel = own.get("rel", "").lower().split()
                if "canonical" in rel and "canonical" not in seen:
                    seen.add("canonical")
                    pending.append(("canonical", own.get("href")))
                if "alternate" in rel and "hreflang" in own:
                    pending.append(("hreflang", own["hreflang"], own.get("href", "")))
            elif re.fullmatch("h[1-6]", value):
                close_heading()
                heading = (int(value[1]), [])
            elif value == "a":
                close_anchor()
                if "href" in own:
                    anchor = (own, [])
            elif value == "img":
                pending.append(("img", own.get("src", own.get("data-src", "")), own.get("alt")))
        else:
            if hidden and value in hidden:
                del hidden[hidden.index(value) :]
            if value == "title" and title is not None:
                seen.add("title")
                found["title"] = collapse("".join(title))
                title = None
            elif re.fullmatch("h[1-6]", value):
                close_heading()
            elif value == "a":
                close_anchor()
            json_ld = json_ld and value != "script"
    close_heading()
    close_anchor()
    if title is not None:
        found["title"] = collapse("".join(title))
    page = parse_url(page_url)
    home = site_key_text(page.hostname) if page else ""
    start = parse_url(base, page_url) if base is not None else None
    root = start.url if start else page_url
    for kind, *parts in pending:
        if kind == "canonical":
            target = parse_url(parts[0], root) if parts[0] else None
            found["canonical"] = target.url if target else None
        elif kind == "hreflang":
            target = parse_url(parts[1], root)
            found["hreflang"].append({"lang": parts[0], "href": target.url if target else ""})
        elif kind == "img":
            target = parse_url(parts[0], root)
            found["images"].append({"src": target.url if target else parts[0], "alt": parts[1]})
        else:
            own, text = parts
            target = parse_url(own["href"], root)
            if target:
                rel = own.get("rel", "").lower()
                found["links"].append({"href": target.url, "text": text, "rel": rel, "internal": site_key_text(target.hostname) == home, "nofollow": "nofollow" in rel.split()})
    found["h1"] = [h["text"] for h in found["headings"] if h["level"] == 1]
    found["word_count"] = len(_SPACE.sub(" ", "".join(words)).split(" ")) - sum(not w for w in _SPACE.sub(" ", "".join(words)).split(" "))
    return found | {"status": status, "time_ms": time_ms, "bytes": len(source.encode()) if size is None else size}


@F.pandas_udf(SNAPSHOT)
def snapshot_of(source: pd.Series, url: pd.Series, status: pd.Series, time_ms: pd.Series) -> pd.DataFrame:
    """Arrow-batched extraction; a null document gives a row of nulls (wrap with ``snapshot``)."""
    names = SNAPSHOT.fieldNames()
    rows = []
    for text, address, code, took in zip(source, url, status, time_ms, strict=True):
        if text is None:
            rows.append(dict.fromkeys(names))
            continue
        made = extract(text, address or "", None if pd.isna(code) else int(code), None if pd.isna(took) else int(took))
        rows.append(made)
    return pd.DataFrame(rows, columns=names).astype(object).where(lambda f: f.notna(), None) if rows else pd.DataFrame(columns=names)


def snapshot(source: Column, url: Column, status: Column | None = None, time_ms: Column | None = None) -> Column:
    """Snapshot struct of an HTML column; null where the document is null."""
    made = snapshot_of(source, url, (status if status is not None else F.lit(None)).cast("int"), (time_ms if time_ms is not None else F.lit(None)).cast("long"))
    return F.when(source.isNotNull(), made)


#: The ids of application roots, in quotes of either kind.
EMPTY_ROOT = r"(?i)<div[^>]+id=[\"'](?:app|root|__next|__nuxt|___gatsby)[\"'][^>]*>\s*</div>"


def needs_render(source: Column, snap: Column) -> Column:
    """An empty application root, fewer than 50 words or fewer than two links."""
    empty_root = source.rlike(EMPTY_ROOT)
    return F.coalesce(empty_root | (snap["word_count"] < 50) | (F.size(snap["links"]) < 2), F.lit(False))
