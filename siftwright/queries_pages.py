"""Queries over pages and documents: text, links, contact data, names, classes and the flagship export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify, countries, notices, udfs, web
from .functions import lexicon as L
from .functions.text import found, host, squeeze, strip
from .functions.validate import skip_domain
from .operators import dom, store, structured
from .plans import export, records
from .queries_store import table
from .sources import readers


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", "html", host(F.col("url")).alias("domain"), web.visible(F.col("html")).alias("text"))


def footer(html: Column) -> Column:
    return F.coalesce(web.inner(html, "footer"), web.visible(html))


def queue_hosts(spark, d):
    return readers.domains(table(spark, d, "pages").select(host(F.col("url")).alias("domain")), "pages")


def html_text(spark, d):
    return pages(spark, d).select("page_id", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


def html_title_h1(spark, d):
    return table(spark, d, "pages").select("page_id", web.inner(F.col("html"), "title").alias("title"), web.inner(F.col("html"), "h1").alias("h1"))


def html_links(spark, d):
    links = F.col("html")
    return table(spark, d, "pages").select("page_id", F.size(web.hrefs(links)).cast("long").alias("n"), F.array_join(web.hrefs(links), " ").alias("hrefs"))


def html_footer(spark, d):
    name = web.copyright_name(footer(F.col("html")))
    return table(spark, d, "pages").select("page_id", name.alias("copyright"))


def emails(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.array_join(web.emails(F.lit(""), F.col("text")), "; ").alias("emails"))
    return rows.where("emails <> ''")


def phones_context(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.size(web.phone_candidates(F.col("text"))).cast("long").alias("n"))
    return rows.where("n > 0")


def vat_ids(spark, d):
    vat = found(F.col("text"), r"(?i)(?:VAT|USt[- \t]?Id[- \t]?Nr\.?|UID|TVA|IVA|NIF|BTW|MWST|GST)[ \t:]*([A-Z]{2}[ \t]?[0-9][0-9 \t]*)", 1)
    return table(spark, d, "documents").select("doc_id", vat.alias("vat")).where("vat is not null")


def company_name(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").withColumn("domain", host(F.col("url"))).select("page_id", web.company_name(F.lit(None).cast("string"), footer(h), web.inner(h, "title"), web.inner(h, "h1"), F.col("domain")).alias("company_name"))


def parked(spark, d):
    return pages(spark, d).select("page_id", classify.parked(web.inner(F.col("html"), "title"), F.col("text")).alias("parked"))


def confidence(spark, d):
    p = _extracted(spark, d)
    return p.select("page_id", "confidence_score")


def industry(spark, d):
    return table(spark, d, "documents").select("doc_id", classify.industry(F.col("text")).alias("industry"))


def country_detect(spark, d):
    return pages(spark, d).select("page_id", classify.country(F.col("url"), F.col("text")).alias("country"))


def country_context(spark, d):
    return pages(spark, d).select("page_id", classify.country_context(F.col("domain"), F.col("text")).alias("context"))


def host_sizes(spark, d):
    return pages(spark, d).select("domain", classify.company_size(F.lit(None).cast("string"), F.col("domain")).alias("size"), skip_domain(F.col("domain")).alias("skipped")).distinct()


def legal_links(spark, d):
    """Links of each page on its own host, by kind, in order."""
    rows = table(spark, d, "pages").select("page_id", "url", F.posexplode(web.hrefs(F.col("html"))).alias("ord", "href")).withColumn("target", web.resolve(F.col("url"), F.col("href")))
    kind = F.coalesce(web.link_kind(F.col("href"), F.lit("")), F.lit("other"))
    return rows.where(host(F.col("target")) == host(F.col("url"))).groupBy("page_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.min_by("target", "ord").alias("first"))


def page_plan(spark, d):
    base = F.concat(F.lit("https://"), host(F.col("url")))
    return table(spark, d, "pages").select("page_id", F.array_join(web.page_plan(base, F.array().cast("array<string>")), " ").alias("plan"))


def content_quality(spark, d):
    """0.3 for the share of text in the page, 0.5 for legal words, 0.2 for length."""
    words = F.size(F.filter(F.split("text", " "), lambda x: x != ""))
    hits = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in ("impressum", "contact", "address", "company")), F.lit(0))
    score = 0.3 * F.least(F.lit(1.0), 10.0 * F.length("text") / F.length("html")) + 0.5 * F.least(F.lit(1.0), hits / 3.0) + 0.2 * F.least(F.lit(1.0), words / 500.0)
    return pages(spark, d).select("page_id", F.round(score, 2).alias("quality"), (words >= 100).alias("substantial"))


def keyword_context(spark, d):
    return table(spark, d, "documents").select("doc_id", dom.around(F.col("text"), "license").alias("context")).where("context is not null")


def dom_nodes(spark, d):
    parsed = dom.parse(table(spark, d, "pages"))
    return parsed.select("page_id", F.explode("nodes").alias("n")).groupBy("page_id", "n.tag").agg(F.count("*").alias("n"), F.count_if("n.in_footer").alias("in_footer"))


def dom_clean_content(spark, d):
    return dom.parse(table(spark, d, "pages")).select("page_id", "title", "lang", F.length("text").alias("text_length"), "main_text")


def dom_sections(spark, d):
    return dom.sections(dom.parse(table(spark, d, "pages")))


def dom_links(spark, d):
    parsed = dom.parse(table(spark, d, "pages"))
    return parsed.select("page_id", "url", F.explode(dom.select("a")).alias("n")).select("page_id", F.col("n.ord").alias("ord"), web.resolve(F.col("url"), F.coalesce(F.col("n.attrs")["href"], F.lit(""))).alias("target"), web.link_kind(F.coalesce(F.col("n.attrs")["href"], F.lit("")), F.col("n.text")).alias("kind"), F.col("n.in_footer").alias("in_footer"))


def language(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", udfs.stop_word_language("text").alias("detected"))


def _extracted(spark, d):
    h = F.col("html")
    p = pages(spark, d).withColumns({"page_title": web.inner(h, "title"), "h1": web.inner(h, "h1"), "footer": footer(h), "organisation": structured.organisation(h)})
    p = p.withColumns({
        "company_name": web.company_name(F.col("organisation")["name"], F.col("footer"), F.col("page_title"), F.col("h1"), F.col("domain")),
        "emails": F.array_join(web.emails(h, F.col("text")), ","), "phones": F.array_join(F.transform(web.phone_candidates(F.col("text")), strip), ","), "address": notices.address_text(h, F.col("text")),
        "description": F.coalesce(web.meta(h, "description"), web.meta(h, "og:description"), F.substring("text", 1, 500)), "social": F.nullif(F.to_json(structured.social(web.hrefs(h))), F.lit("{}")),
        "is_parked": classify.parked(F.col("page_title"), F.col("text")),
    })
    p = p.withColumn("industry", classify.industry(F.col("text"), F.col("description")))
    return p.withColumn("confidence_score", classify.weighted(classify.WEB_WEIGHTS))


def export_pages(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: pages to one company record per host, joined to the queue and exported in the unified columns."""
    p = _extracted(spark, d).where("domain is not null and not is_parked")
    none = F.lit(None).cast("string")
    best = p.select("domain", F.struct("confidence_score", (-F.col("page_id")).alias("o"), "company_name", "description", "emails", "phones", "industry").alias("r")).groupBy("domain").agg(F.max("r").alias("r"))
    results = best.select("domain", "r.company_name", "r.description", "r.emails", "r.phones", "r.industry", "r.confidence_score", *(none.alias(f"social_{k}") for k in ("linkedin", "twitter", "facebook", "instagram", "youtube")), F.lit("1").alias("crawled_at"), F.lit("run").alias("run_id"))
    legal = store.migrated(records.legal_records(p, by_country=False), ", ".join(f"{c} string" for c in ("country", "fax_number", "registered_street", "registered_zip", "registered_city", "registered_country")))
    queue = queue_hosts(spark, d).withColumns({"robots_status": F.lit("ALLOWED"), "robots_reason": none})
    return export.unified(results, legal, queue).select("domain", "company_name", "legal_form", "registration_number", "ceo_names", "street", "postal_code", "city", "country", "industry", "company_size", "emails", "robots_allowed", "confidence_score")


QUERIES = {
    f.__name__: f
    for f in (
        export_pages, queue_hosts, html_text, html_title_h1, html_links, html_footer, emails, phones_context, vat_ids, company_name, parked, confidence, industry, country_detect, country_context, host_sizes, legal_links,
        page_plan, content_quality, keyword_context, dom_nodes, dom_clean_content, dom_sections, dom_links, language,
    )
}


# ---------------------------------------------------------------- SQL
def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _sum(c: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + ")"


def _unescape(c: str) -> str:
    for a, b in web.ENTITIES:
        c = f"""replace({c}, '{a}', '{b.replace("'", "''")}')"""
    return c


_WS = r"'[ \t\n\r\f]+', ' ', 'g'"
_squeeze = lambda c: rf"regexp_replace(regexp_replace({c}, {_WS}), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"
_NOSCRIPT = r"regexp_replace(html, '(?is)<(?:script|style|noscript)\b[^>]*>.*?</(?:script|style|noscript)>|<!--.*?-->', ' ', 'g')"
_tagless = lambda c: _squeeze(_unescape(f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"))
_inner = lambda tag: _tagless(rf"nullif(regexp_extract(ns, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1), '')")
_HOST = r"lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), ''))"
_P = f"n AS (SELECT *, {_HOST} AS domain, {_NOSCRIPT} AS ns FROM pages), p AS (SELECT *, {_tagless('ns')} AS text, {_inner('title')} AS title, {_inner('h1')} AS h1, {_inner('footer')} AS foot FROM n)"
_SKIP = f"(domain IS NULL OR domain = '' OR regexp_matches(domain, '[/:]') OR (len(string_split(domain, '.')) >= 3 AND string_split(domain, '.')[1] IN ({', '.join(repr(x) for x in L.SERVICE_PREFIXES)})) OR {_any('domain', L.NON_COMMERCIAL)})"
_COPY = r"trim(nullif(regexp_extract(coalesce(foot, text), '(?i)(?:©|Copyright|Copr\.?)[ \t\n]*(?:[0-9]{4})?[ \t\n]*(?:by[ \t\n]+)?([^|,\n]{3,50})', 1), ''))"
_ABC, _NUM = "A-Za-zÄÖÜäöüßÀ-ÖØ-öø-ÿ", "A-Za-z0-9ÄÖÜäöüßÀ-ÖØ-öø-ÿ"


def _name(c: str) -> str:
    """The web name check on a squeezed value."""
    c = _squeeze(c)
    return rf"""CASE WHEN {c} <> '' AND length({c}) BETWEEN 3 AND 100 AND len(string_split({c}, ' ')) <= 10
      AND NOT regexp_matches(lower({c}), '[0-9]{{4}}|https?://|www\.|^[0-9.,]+$|\([0-9]+\)|[|/\\]{{2,}}|^[0-9]+\.|cookie|newsletter|warenkorb|anmelden|registrieren|suche|menü|navigation')
      AND NOT {_any(f"lower({c})", L.NAME_NOISE)} AND lower({c}) NOT IN ({", ".join(repr(x) for x in L.GENERIC_TITLES)})
      AND length(regexp_replace({c}, '[^{_ABC}]', '', 'g')) >= length({c}) * 0.4 AND length(regexp_replace({c}, '[{_NUM} .\-&()]', '', 'g')) <= length({c}) * 0.2
      AND length({c}) - length(replace({c}, '|', '')) <= 1 AND (length({c}) - length(replace({c}, ' - ', ''))) / 3 <= 2 THEN {c} END"""


_PARTED = r"'^(.*?)(?: \| | - | :: | — | – )'"
_LABEL = "list_reduce(list_transform(string_split(translate(string_split(domain, '.')[1], '-_', '  '), ' '), lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b)"
_COMPANY = f"""coalesce((SELECT arg_max(v, (r, -length(v))) FROM (VALUES (10, {_name(_COPY)}), (5, CASE WHEN regexp_matches(title, {_PARTED}) THEN {_name(f"regexp_extract(title, {_PARTED}, 1)")} END),
   (3, CASE WHEN NOT regexp_matches(title, {_PARTED}) AND length(title) < 50 THEN {_name("title")} END), (2, CASE WHEN length(h1) < 60 THEN {_name("h1")} END)) t(r, v) WHERE v IS NOT NULL),
   CASE WHEN length(string_split(domain, '.')[1]) > 2 THEN {_LABEL} ELSE domain END)"""
_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}"
_BUSINESS = f"string_split(e, '@')[1] IN ({', '.join(repr(x) for x in L.BUSINESS_PREFIXES)})"
_GOODMAIL = rf"regexp_matches(e, '^[a-z0-9_%+\-]+(?:\.[a-z0-9_%+\-]+)*@(?:[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?\.)+[a-z]{{2,}}$') AND ({_BUSINESS} OR (string_split(e, '@')[-1] NOT IN ({', '.join(repr(x) for x in L.FREE_MAIL)}) AND NOT regexp_matches(string_split(e, '@')[1], '^[a-z]{{3,}}\.[a-z]{{3,}}$')))".replace("string_split(e, '@')[1] IN", "string_split(e, '@')[1] IN")
_MAILS = lambda t, sep: f"(SELECT string_agg(e, '{sep}' ORDER BY e) FROM (SELECT DISTINCT lower(unnest(regexp_extract_all({t}, '{_MAIL}'))) AS e) WHERE {_GOODMAIL})"
_PHONES = lambda t: f"len(regexp_extract_all({t}, '(?i)(?:phone|tel|telefon|telephone|mobile|cell|fax)[ \\t\\n:]*([+0-9 \\t\\-()]{{7,}})', 1))"
_PARKED = f"({_any('lower(coalesce(title, $$$$))', L.PARKED)} OR {_any('substr(lower(text), 1, 3000)', L.PARKED)} OR length(trim(text)) < 100)"
_argmax = lambda c, classes: "(SELECT arg_max(k, (s, -o)) FROM (VALUES " + ", ".join(f"({i}, '{k}', {_sum(c, w)})" for i, (k, w) in enumerate(classes.items())) + ") t(o, k, s) WHERE s > 0)"
_ADDRESS = r"""(regexp_matches(regexp_replace(regexp_extract(html, '(?is)<address\b[^>]*>(.*?)</address>', 1), '<[^>]*>', ' ', 'g'), '[^\s,]')
   OR regexp_matches(text, '\p{Lu}[\p{L} .-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring)[ ]?\d+[a-z]?[ ,]+\d{5}[ ]+\p{Lu}\p{L}+'))"""
_INDUSTRY = lambda t, extra="''": f"coalesce({_argmax(f'lower(substr({t}, 1, 2000) || $$ $$ || {extra})', L.INDUSTRIES)}, '')"
_COUNTRY = "CASE " + " ".join(f"WHEN contains(lower(url), '{a}') THEN '{b}'" for a, b in L.URL_COUNTRIES) + " " + " ".join(f"WHEN {_any('lower(text)', w)} THEN '{c}'" for c, w in L.TEXT_COUNTRIES) + " ELSE 'UNKNOWN' END"
_CONTEXT = f"CASE WHEN domain LIKE '%.at' THEN 'austrian' WHEN domain LIKE '%.de' THEN 'german' WHEN domain LIKE '%.uk' THEN 'uk' ELSE coalesce({_argmax('lower(text)', L.CONTEXT)}, CASE WHEN domain LIKE '%.fr' OR domain LIKE '%.ch' THEN 'german' ELSE 'uk' END) END"
_SIZE = f"CASE WHEN {_any('domain', L.GOVERNMENT)} THEN 'government' WHEN {_any('domain', L.ENTERPRISES)} THEN 'enterprise' ELSE 'unknown' END"
_HREF = r"""regexp_extract_all(html, '(?i)<a\b[^>]*?href="([^"]*)"', 1)"""
_TARGET = r"""CASE WHEN regexp_matches(href, '(?i)^(?:javascript|mailto|tel|data):') THEN NULL WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN href WHEN href LIKE '//%' THEN string_split(url, ':')[1] || ':' || href
   WHEN href LIKE '/%' THEN origin || href WHEN href LIKE '#%' THEN regexp_replace(url, '#.*$', '') || href WHEN href LIKE '?%' THEN origin || path || href ELSE origin || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END"""
_KIND = f"CASE WHEN {_any('lower(href)', L.LEGAL_LINKS)} THEN 'legal' WHEN {_any('lower(href)', L.CONTACT_LINKS)} THEN 'contact' WHEN {_any('lower(href)', L.ABOUT_LINKS)} THEN 'about' ELSE 'other' END"
_PATHS = "CASE regexp_extract(domain, '\\.([a-z]+)$', 1) " + " ".join(f"WHEN '{t}' THEN {paths!r}" for tlds, paths in L.FALLBACK_PATHS.items() for t in tlds) + f" ELSE {L.FALLBACK_PATHS[()]!r} END"

SQL = {
    "queue_hosts": f"WITH n AS (SELECT DISTINCT {_HOST} AS domain FROM pages) SELECT domain, 'pages' AS source FROM n WHERE NOT {_SKIP}",
    "html_text": f"WITH {_P} SELECT page_id, CAST(length(text) AS BIGINT) AS n, md5(text) AS digest FROM p",
    "html_title_h1": f"WITH {_P} SELECT page_id, title, h1 FROM p",
    "html_links": f"SELECT page_id, CAST(len({_HREF}) AS BIGINT) AS n, array_to_string({_HREF}, ' ') AS hrefs FROM pages",
    "html_footer": f"WITH {_P} SELECT page_id, {_COPY} AS copyright FROM p",
    "emails": f"SELECT * FROM (SELECT doc_id, {_MAILS('text', '; ')} AS emails FROM documents) WHERE emails <> ''",
    "phones_context": f"SELECT * FROM (SELECT doc_id, CAST({_PHONES('text')} AS BIGINT) AS n FROM documents) WHERE n > 0",
    "vat_ids": r"SELECT * FROM (SELECT doc_id, nullif(regexp_extract(text, '(?i)(?:VAT|USt[- \t]?Id[- \t]?Nr\.?|UID|TVA|IVA|NIF|BTW|MWST|GST)[ \t:]*([A-Z]{2}[ \t]?[0-9][0-9 \t]*)', 1), '') AS vat FROM documents) WHERE vat IS NOT NULL",
    "company_name": f"WITH {_P} SELECT page_id, {_COMPANY} AS company_name FROM p",
    "parked": f"WITH {_P} SELECT page_id, {_PARKED} AS parked FROM p",
    "confidence": f"WITH {_P}, c AS (SELECT page_id, coalesce({_MAILS('text', ',')}, '') AS emails, {_PHONES('text')} AS phones, {_INDUSTRY('text', 'substr(text, 1, 500)')} AS industry, {_ADDRESS} AS address FROM p) SELECT page_id, 35.0::DOUBLE + 15 * coalesce(address, false)::INT + 20 * (emails <> '')::INT + 20 * (phones > 0)::INT + 5 * (industry <> '')::INT AS confidence_score FROM c",
    "industry": f"SELECT doc_id, {_INDUSTRY('text')} AS industry FROM documents",
    "country_detect": f"WITH {_P} SELECT page_id, {_COUNTRY} AS country FROM p",
    "country_context": f"WITH {_P} SELECT page_id, {_CONTEXT} AS context FROM p",
    "host_sizes": f"WITH {_P} SELECT DISTINCT domain, {_SIZE} AS size, {_SKIP} AS skipped FROM p",
    "legal_links": rf"WITH l AS (SELECT page_id, url, unnest({_HREF}) AS href, generate_subscripts({_HREF}, 1) AS ord, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?', 1) AS path FROM pages), t AS (SELECT *, {_TARGET} AS target FROM l) SELECT page_id, {_KIND} AS kind, count(*) AS n, arg_min(target, ord) AS first FROM t WHERE {_HOST.replace('url', 'target')} = {_HOST} GROUP BY page_id, 2",
    "page_plan": f"SELECT page_id, array_to_string(list_transform(({_PATHS})[1:5], lambda x: 'https://' || domain || x), ' ') AS plan FROM (SELECT page_id, {_HOST} AS domain FROM pages)",
    "content_quality": f"WITH {_P}, w AS (SELECT *, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS words, {_sum('lower(text)', ['impressum', 'contact', 'address', 'company'])} AS hits FROM p) SELECT page_id, round(0.3::DOUBLE * least(1.0::DOUBLE, 10.0::DOUBLE * length(text) / length(html)) + 0.5::DOUBLE * least(1.0::DOUBLE, hits / 3.0::DOUBLE) + 0.2::DOUBLE * least(1.0::DOUBLE, words / 500.0::DOUBLE), 2) AS quality, words >= 100 AS substantial FROM w",
    "keyword_context": "SELECT doc_id, substr(text, greatest(1, i - 50), i - greatest(1, i - 50) + 207) AS context FROM (SELECT doc_id, text, instr(lower(text), 'license') AS i FROM documents) WHERE i > 0",
}
