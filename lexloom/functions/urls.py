"""Column functions on URLs and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address blocks that aren't public (first two numbers, bits).
_BLOCKS = ((10, 0, 8), (172, 16, 12), (192, 168, 16), (169, 254, 16), (127, 0, 8), (0, 0, 8))


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def host(url: Column) -> Column:
    return F.lower(_part(url, "HOST"))


def is_public_url(url: Column) -> Column:
    """http or https to a host that isn't local, private or link-local."""
    h = F.regexp_replace(host(url), r"^\[|\]$", "")
    octets = F.transform(F.split(h, r"\."), lambda x: x.try_cast("int"))
    is_v4 = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~F.exists(octets, lambda o: o > 255)
    ip = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o)
    private = F.lit(False)
    for a, b, bits in _BLOCKS:
        private = private | (F.shiftright(ip, 32 - bits) == ((a << 24 | b << 16) >> (32 - bits)))
    v6 = h.contains(":") & (h.isin("::1", "::") | h.rlike("^(fc|fd|fe80)"))
    ok = F.lower(_part(url, "PROTOCOL")).isin("http", "https") & h.isNotNull() & (h != "localhost") & ~(is_v4 & private) & ~v6
    return F.coalesce(ok, F.lit(False))


def source_chapter_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(\d+)/?$", 1), F.lit(""))


def _dashed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_from_url(url: Column) -> Column:
    """Site label and the first numeric path segment, or else the path."""
    labels = F.split(F.regexp_replace(host(url), r"^www\.", ""), r"\.")
    site = F.element_at(labels, F.when(F.size(labels) > 1, -2).otherwise(1))
    path = F.coalesce(F.nullif(_part(url, "PATH"), F.lit("")), F.lit("/"))
    number = F.get(F.filter(F.split(path, "/"), lambda s: s.rlike(r"^\d+$")), F.lit(0))
    return _dashed(F.concat(site, F.lit("-"), F.coalesce(number, path)))


def page_title(html: Column) -> Column:
    """What stands in the title element, trimmed; null where that is nothing."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?i)<title\b[^>]*>([^<]*)</title\s*>", 1)), F.lit(""))


def meta_tags(html: Column) -> Column:
    """The meta elements of a page in order: an array of (key, content), the key being the property or name."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    pair = r"""(?s)([A-Za-z][\w:.-]*)\s*=\s*("[^"]*"|'[^']*')"""

    def read(tag: Column) -> Column:
        names = F.transform(F.regexp_extract_all(tag, F.lit(pair), F.lit(1)), F.lower)
        values = F.transform(F.regexp_extract_all(tag, F.lit(pair), F.lit(2)), lambda v: F.substring(v, F.lit(2), F.length(v) - 2))
        said = lambda name: F.get(values, F.nullif(F.array_position(names, name), F.lit(0)).cast("int") - 1)
        return F.struct(F.coalesce(said("property"), said("name")).alias("key"), F.trim(said("content")).alias("content"))

    return F.transform(tags, read)


def meta_fields(html: Column) -> dict[str, Column]:
    """Title, description, cover and author of a page; null where absent.  Of several meta elements the first that says something counts."""
    tags = meta_tags(html)
    of = lambda key: F.get(F.filter(tags, lambda t: (F.lower(t["key"]) == key) & (t["content"] != "")), F.lit(0))["content"]
    return {"title": page_title(html), "description": F.coalesce(of("og:description"), of("description")), "cover": of("og:image"), "author": of("author")}


def client_key(forwarded: Column, real: Column) -> Column:
    first = F.nullif(F.trim(F.substring_index(forwarded, ",", 1)), F.lit(""))
    return F.sha2(F.coalesce(first, F.nullif(F.trim(real), F.lit("")), F.lit("unknown")), 256)
