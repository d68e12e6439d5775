"""Rule-visible field names as typed columns, resolved when a rule is compiled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import path_of


@dataclass(frozen=True)
class Field:
    """kind: string, number, boolean, strings, structs, struct, map or none (an unknown name: always null)."""

    kind: str
    column: Column


#: snapshot fields: public name -> (column name, kind)
_SNAPSHOT = {
    "title": ("title", "string"), "metaDescription": ("meta_description", "string"), "metaRobots": ("meta_robots", "string"), "canonical": ("canonical", "string"), "lang": ("lang", "string"),
    "h1": ("h1", "strings"), "headings": ("headings", "structs"), "hreflang": ("hreflang", "structs"), "og": ("og", "map"), "jsonLdTypes": ("json_ld_types", "strings"),
    "jsonLdErrors": ("json_ld_errors", "number"), "links": ("links", "structs"), "images": ("images", "structs"), "wordCount": ("word_count", "number"), "bytes": ("bytes", "number"), "timeMs": ("time_ms", "number"),
}
_PAGE = {
    "url": ("url", "string"), "finalUrl": ("final_url", "string"), "depth": ("depth", "number"), "status": ("status", "number"), "contentType": ("content_type", "string"), "headers": ("headers", "map"),
    "redirects": ("redirects", "structs"), "error": ("error", "string"), "renderError": ("render_error", "string"),
}
_DERIVED = ("path", "redirectCount", "rendered", "xRobotsTag", "noindex", "canonicalIsSelf", "indexable", "h1Count", "imagesMissingAlt", "internalLinks", "externalLinks")
NAMES = (*_SNAPSHOT, *_PAGE, *_DERIVED)
_MEMBERS = {
    "headings": {"level": "number", "text": "string"}, "hreflang": {"lang": "string", "href": "string"}, "images": {"src": "string", "alt": "string"}, "redirects": {"url": "string", "status": "number"},
    "links": {"href": "string", "text": "string", "rel": "string", "internal": "boolean", "nofollow": "boolean"},
}


class View:
    """The fields of a page as one of its versions gives them: "effective", "raw" or "rendered"."""

    def __init__(self, source: str = "effective", prefix: str = ""):
        at = lambda name: F.col(f"{prefix}{name}")
        self.at = at
        self.snap = F.coalesce(at("rendered"), at("raw")) if source == "effective" else at(source)

    def _member(self, name: str) -> Column:
        return self.snap.getField(name)

    def noindex(self) -> Column:
        tag = self.at("headers").getItem("x-robots-tag")
        both = F.lower(F.concat_ws(",", F.nullif(self._member("meta_robots"), F.lit("")), F.nullif(tag, F.lit(""))))
        return both.rlike("(?<![A-Za-z0-9_])(?:noindex|none)(?![A-Za-z0-9_])")

    def canonical_is_self(self) -> Column:
        return self._member("canonical") == self.at("final_url")

    def indexable(self) -> Column:
        fine = F.coalesce(self.at("status").between(200, 299), F.lit(False))
        return fine & ~self.noindex() & F.coalesce(self.canonical_is_self(), F.lit(True))

    def _count(self, name: str, test=None) -> Column:
        items = self._member(name)
        return F.coalesce(F.size(F.filter(items, test)) if test else F.when(items.isNotNull(), F.size(items)), F.lit(0))

    def field(self, name: str) -> Field | None:
        """The field, or None where no page can have it."""
        if name in _PAGE:
            return Field(_PAGE[name][1], self.at(_PAGE[name][0]))
        if name in _SNAPSHOT:
            return Field(_SNAPSHOT[name][1], self._member(_SNAPSHOT[name][0]))
        match name:
            case "path":
                return Field("string", path_of(self.at("final_url")))
            case "redirectCount":
                return Field("number", F.coalesce(F.when(self.at("redirects").isNotNull(), F.size(self.at("redirects"))), F.lit(0)))
            case "rendered":
                return Field("boolean", self.at("rendered").isNotNull())
            case "xRobotsTag":
                return Field("string", self.at("headers").getItem("x-robots-tag"))
            case "noindex":
                return Field("boolean", self.noindex())
            case "canonicalIsSelf":
                return Field("boolean", self.canonical_is_self())
            case "indexable":
                return Field("boolean", self.indexable())
            case "h1Count":
                return Field("number", self._count("h1"))
            case "imagesMissingAlt":
                return Field("number", self._count("images", lambda i: i["alt"].isNull()))
            case "internalLinks":
                return Field("number", self._count("links", lambda i: i["internal"]))
            case "externalLinks":
                return Field("number", self._count("links", lambda i: ~i["internal"]))
        return self._descend(name)

    def _descend(self, name: str) -> Field | None:
        """Dotted paths: a map key, an array's length, or one element and its member."""
        head, _, rest = name.partition(".")
        root = self.field(head) if "." in name else None
        if root is None or not rest:
            return None
        if root.kind == "map":
            return None if "." in rest else Field("string", root.column.getItem(rest))
        if root.kind in ("strings", "structs"):
            if rest == "length":
                return Field("number", F.when(root.column.isNotNull(), F.size(root.column)))
            index, _, member = rest.partition(".")
            if not index.isdigit():
                return None
            element = F.get(root.column, F.lit(int(index)))
            if root.kind == "strings":
                return None if member else Field("string", element)
            kinds = _MEMBERS[head]
            if not member:
                return Field("struct", element)
            return Field(kinds[member], element.getField(member)) if member in kinds else None
        return None


def known(name: str) -> bool:
    """Whether a page can have the field; no session is needed."""
    head, _, rest = name.partition(".")
    if not rest:
        return name in NAMES
    kind = ({k: v[1] for k, v in (_SNAPSHOT | _PAGE).items()}).get(head)
    if kind == "map":
        return "." not in rest
    if kind not in ("strings", "structs"):
        return False
    index, _, member = rest.partition(".")
    return rest == "length" or index.isdigit() and (not member or kind == "structs" and member in _MEMBERS[head])
