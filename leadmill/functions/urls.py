"""URLs as Column functions: JVM expressions only. Null gives the empty text or false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from leadmill.functions.text import has, text


def is_http(c: Column) -> Column:
    return F.startswith(text(c), F.lit("http"))


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(text(c), r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def netloc(c: Column) -> Column:
    return F.regexp_extract(text(c), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)


def host(c: Column) -> Column:
    """Lower-cased host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(c), r"^.*@", ""), r":\d*$", ""))


def path(c: Column) -> Column:
    return F.regexp_extract(text(c), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def normalize_url(c: Column) -> Column:
    """https, lower host without www., no trailing slash, query or fragment."""
    return F.concat(F.lit("https://"), F.regexp_replace(F.lower(netloc(c)), r"^www\.", ""), F.regexp_replace(path(c), "/+$", ""))


def drop_query(c: Column) -> Column:
    return F.regexp_replace(c, r"[?#].*$", "")


def is_test_url(c: Column) -> Column:
    return has(c, r"(?i)[/?&=#](?:test|demo|sample|preview|staging|sandbox|dummy)[/?&#=]|/(?:test|demo|sample|preview|staging)$")


def is_article_url(c: Column) -> Column:
    return has(c, r"(?i)/(?:columns?|articles?|blogs?|media|news|topics|knowledge|magazine|guide|howto|faq|qa|help|feature|special|column\d|media\d|note|journal|report|review|ranking|compare)/")


def host_contains_any(c: Column, parts: list[str]) -> Column:
    return has(host(c), "|".join("\\Q" + p.lower() + "\\E" for p in parts) or "(?!)")


def host_suffixes(h: Column) -> Column:
    """The host and every parent of it."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def query_value(c: Column, key: str) -> Column:
    """Decoded value of a query key; null if there is none."""
    raw = F.regexp_extract(text(c), rf"[?&]{key}=([^&#]*)", 1)
    return F.when(raw != "", F.try_url_decode(raw))


def unwrap_tracker(c: Column, own: str = "(?!)") -> Column:
    """Landing page inside a tracking link: a query value, a path after /r/, /** or /*, or base64 in `u`; else null.
    own: pattern of the tracker's own addresses, which are no landing pages."""
    good = lambda v: F.when(F.startswith(v, F.lit("http")) & ~has(v, own), v)
    keys = ["adurl", "q", "url", "u", "murl", "ru", "landing", "dest", "to"]
    tail = lambda mark: F.try_url_decode(F.regexp_extract(text(c), rf"{mark}(.+)$", 1))
    packed = F.translate(F.regexp_replace(F.coalesce(query_value(c, "u"), F.lit("")), r"^a\d", ""), "-_", "+/")
    padded = F.rpad(packed, (F.ceil(F.length(packed) / 4) * 4).cast("int"), "=")
    decoded = F.when(has(packed, r"^[A-Za-z0-9+/]{8,}={0,2}$"), F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))
    return F.coalesce(*[good(query_value(c, k)) for k in keys], *[good(tail(m)) for m in ("/r/", r"/\*\*", r"/\*")], good(decoded))


def resolve_link(base: Column, href: Column, external: bool = False) -> Column:
    """Absolute address of a link on a page; null if it leads to another host and that isn't allowed."""
    h = F.trim(text(href))
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    joined = (
        F.when(has(h, r"(?i)^https?://"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(scheme(base), F.lit(":"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(root, h))
        .when(has(h, r"^(?:#|$)|^[a-zA-Z][a-zA-Z0-9+.\-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(root, F.regexp_replace(path(base), "[^/]*$", ""), h))
    )
    joined = F.regexp_replace(joined, r"(?<!:)/(?:\./)+", "/")
    joined = reduce(lambda x, _: F.regexp_replace(x, r"/(?!\.\.)[^/:]+/\.\./", "/"), range(6), joined)
    return joined if external else F.when(host(joined) == host(base), joined)
