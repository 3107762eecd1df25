"""Fields of web pages by pattern, as columns: text, title, links, addresses, company names, structured data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import any_of, filled, found, has_any, host, label, squeeze, strip
from .validate import web_company_name, web_email

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}"  # fixed value
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


def unescape(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def no_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(?:script|style|noscript)\b[^>]*>.*?</(?:script|style|noscript)>|<!--.*?-->", " ")


def visible(html: Column) -> Column:
    """Text outside tags, scripts and styles, with single spaces."""
    return squeeze(unescape(F.regexp_replace(no_scripts(html), "<[^>]*>", " ")))


def lined(html: Column) -> Column:
    """The same text with a line for each block."""
    t = F.regexp_replace(squeeze(no_scripts(html)), r"(?i)</?(?:address|article|br|dd|div|dt|footer|h[1-6]|header|li|main|p|section|table|td|th|tr|ul)\b[^>]*>", "\n")
    return strip(F.regexp_replace(unescape(F.regexp_replace(t, "<[^>]*>", "")), r"[ \t]*\n[ \t\n]*", "\n"))


def inner(html: Column, tag: str) -> Column:
    """Text of the first such element."""
    return squeeze(unescape(F.regexp_replace(found(no_scripts(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", " ")))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?href="([^"]*)"'), F.lit(1))


def emails(html: Column, text: Column) -> Column:
    """Valid business addresses of mailto links and the text, sorted."""
    links = F.transform(F.filter(hrefs(html), lambda x: x.startswith("mailto:")), lambda x: F.substring_index(F.substring(x, 8, 10_000), "?", 1))
    all_ = F.array_union(F.transform(links, F.lower), F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower))
    return F.array_sort(F.array_distinct(F.filter(F.transform(all_, web_email), lambda x: x.isNotNull())))


def phone_candidates(text: Column) -> Column:
    """Numbers that stand after a phone word."""
    return F.regexp_extract_all(text, F.lit(r"(?i)(?:phone|tel|telefon|telephone|mobile|cell|fax)[ \t\n:]*([+0-9 \t\-()]{7,})"), F.lit(1))


def copyright_name(footer: Column) -> Column:
    return strip(found(footer, r"(?i)(?:©|Copyright|Copr\.?)[ \t\n]*(?:[0-9]{4})?[ \t\n]*(?:by[ \t\n]+)?([^|,\n]{3,50})", 1))


def company_name(structured: Column, footer: Column, page_title: Column, h1: Column, domain: Column) -> Column:
    """The best candidate: structured data, copyright line, first part of the title, whole short title, headline; shorter ones first; else the domain's label."""
    parted = r"^(.*?)(?: \| | - | :: | — | – )"
    has_parts = page_title.rlike(parted)
    ranked = [
        (web_company_name(structured), 15),
        (web_company_name(copyright_name(footer)), 10),
        (F.when(has_parts, web_company_name(F.regexp_extract(page_title, parted, 1))), 5),
        (F.when(~has_parts & (F.length(page_title) < 50), web_company_name(page_title)), 3),
        (F.when(F.length(h1) < 60, web_company_name(h1)), 2),
    ]
    options = F.filter(F.array(*(F.struct(F.lit(rank).alias("rank"), (-F.length(name)).alias("length"), name.alias("name")) for name, rank in ranked)), lambda x: x["name"].isNotNull())
    fallback = F.when(F.length(F.substring_index(domain, ".", 1)) > 2, label(domain)).otherwise(domain)
    return F.coalesce(F.array_max(options)["name"], fallback)


def resolve(base: Column, href: Column) -> Column:
    """An absolute URL of a link on a page; null for scripts, mail and phone links."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1)
    return (
        F.when(href.rlike(r"(?i)^(?:javascript|mailto|tel|data):"), None)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .otherwise(F.concat(origin, F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", "")), href))
    )


def link_kind(href: Column, text: Column) -> Column:
    """legal, contact or about; null for other links. The first that fits."""
    h, t = F.lower(href), F.lower(text)
    is_ = lambda words: has_any(h, words) | has_any(t, words)
    return F.when(is_(L.LEGAL_LINKS), "legal").when(is_(L.CONTACT_LINKS), "contact").when(is_(L.ABOUT_LINKS), "about")


def page_plan(base: Column, links: Column, most: int = 5) -> Column:
    """Pages to read next: the links found, then the usual paths of the top-level domain, each once, at most `most`."""
    tld = F.lower(found(base, r"\.([A-Za-z]+)(?:[:/?#]|$)", 1))
    usual = F.array(*map(F.lit, L.FALLBACK_PATHS[()]))
    for tlds, paths in L.FALLBACK_PATHS.items():
        if tlds:
            usual = F.when(tld.isin(*tlds), F.array(*map(F.lit, paths))).otherwise(usual)
    plan = F.array_distinct(F.concat(links, F.transform(usual, lambda p: F.concat(base, p))))
    return F.slice(F.filter(plan, lambda x: (x != base) & (x != F.concat(base, F.lit("/")))), 1, most)


def json_ld(html: Column) -> Column:
    """The JSON-LD blocks of a page, as text."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by name or property."""
    return unescape(F.coalesce(found(html, rf"""(?is)<meta\b[^>]*(?:name|property)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1), found(html, rf"""(?is)<meta\b[^>]*content=["']([^"']*)["'][^>]*(?:name|property)=["']{name}["']""", 1)))


__all__ = ["any_of", "company_name", "emails", "filled", "host", "hrefs", "inner", "json_ld", "link_kind", "meta", "page_plan", "phone_candidates", "resolve", "unescape", "visible"]
