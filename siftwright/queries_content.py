"""Queries over parts of pages, and exports of legal entities, with known answers or SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import web
from .operators import content, dom, store
from .plans import export, records
from .queries_fixtures import answer, rows
from .queries_store import TABLES, table, tables

LONG = "Beispiel GmbH, Musterstraße 12, 10115 Berlin, Geschäftsführer Max Mustermann, Amtsgericht Charlottenburg HRB 12345, Telefon 030 1234567"
FILL = " ".join(["word"] * 60)
#: (page_id, html, section)
SECTIONS = [
    (1, f"<body><div class='x'>{FILL}</div><div id='impressum'>{LONG}</div></body>", LONG),
    (2, f"<body><div class='Legal-Notice'>{LONG}</div><p id='imprint'>short</p></body>", LONG),
    (3, f"<body><div id='legal'>{LONG} A</div><div class='impressum'>{LONG} B</div></body>", f"{LONG} B"),
    (4, f"<body><article>{LONG} A</article><main>{LONG} B</main></body>", f"{LONG} B"),
    (5, f"<body><div>{FILL}</div><div>Impressum Angaben gemäß TMG {FILL}</div></body>", f"Impressum Angaben gemäß TMG {FILL}"),
    (6, "<body>Only <b>this</b></body>", "Only this"),
    (7, "<p>no body</p>", None),
    (8, "", None),
    (9, None, None),
    (10, f"<body><div><div><div id=impressum><p>{LONG}</p><p>Webdesign: Nice Agentur</p><p>Tel. 030 1</p></div></div></div></body>", f"{LONG}\nWebdesign: Nice Agentur\nTel. 030 1"),
]
LINKS = [
    (1, '<a href="/kontakt">Kontakt</a><a href="/impressum">Impressum</a><a href="/x">X</a>', "https://a.de/impressum https://a.de/kontakt"),
    (2, '<a href="/kontakt">K</a><footer><a href="/angaben">A</a><a href="/about-us">U</a></footer>', "https://a.de/angaben https://a.de/about-us https://a.de/kontakt"),
    (3, '<div class="site-bottom"><a href="/legal">L</a></div><a href="/legal">again</a>', "https://a.de/legal"),
    (4, '<a>none</a><a href="mailto:x@a.de">Impressum</a>', ""),
    (5, "", ""),
    (6, "".join(f'<a href="/legal{i}">x</a>' for i in range(12)), " ".join(f"https://a.de/legal{i}" for i in range(10))),
]
SHOP = '<div itemscope itemtype="https://schema.org/Organization"><span itemprop="name">Acme GmbH</span><div itemprop="address" itemscope itemtype="https://schema.org/PostalAddress"><span itemprop="streetAddress">Weg 1</span><span itemprop="postalCode">10115</span><span itemprop="name">Inner</span></div><a itemprop="email" href="mailto:info@acme.de">Mail</a><meta itemprop="telephone" content="+49 30 1"></div>'
MICRODATA = [
    (1, SHOP, "Acme GmbH", "+49 30 1", "info@acme.de", "Weg 1, 10115"),
    (2, '<div itemscope itemtype="http://schema.org/LocalBusiness"><p itemprop="name">One<p itemprop="name">Two</div>', "One", None, None, None),
    (3, '<div itemscope itemtype="http://schema.org/Person"><b itemprop="name">Max</b></div>', None, None, None, None),
    (4, '<div itemscope itemtype="http://schema.org/Organization"><div itemprop="founder" itemscope><b itemprop="name">Max</b></div><b itemprop="name">Beta</b></div><b itemprop="email">x@y.de</b>', "Beta", None, None, None),
    (5, "", None, None, None, None),
]
META = [
    (1, '<title>T</title><meta property="og:title" content="OG"><meta name="author" content="Max"><meta name="Description" content="D"><meta property="og:site_name" content="S"><meta name="date" content="2024-01-02">', "OG", "Max", "2024-01-02", "D", "S"),
    (2, "<title> A  B </title>", "A B", "", "", "", ""),
    (3, "", "", "", "", "", ""),
    (4, '<meta property="og:description" content="O"><meta name="description" content=""><meta name="author">', "", "", "", "O", ""),
]
_ld = lambda s: f'<script type="application/ld+json">{s}</script>'
ENTITIES = [
    (1, _ld('{"@type":"Organization","legalName":"Acme GmbH","name":"Acme","vatID":"DE 123456789","address":{"streetAddress":"Weg 1","postalCode":"10115","addressLocality":"Berlin"}}'), ("Acme GmbH", "DE 123456789", "Berlin"), ("Acme GmbH", "DE123456789", "Berlin")),
    (2, _ld('[{"@type":"Corporation","name":"First AG"},{"@type":"Corporation","name":"Second AG","taxID":"12"}]'), ("First AG", "12", None), ("Second AG", None, None)),
    (3, _ld('{"@type":"Company","name":"Cee GmbH"}'), (None, None, None), ("Cee GmbH", None, None)),
    (4, _ld('{"@type":"LegalService","name":"Law KG"}'), ("Law KG", None, None), (None, None, None)),
    (5, '<meta property="og:site_name" content="Site">' + _ld('{"@type":"NGO","name":"N"}'), ("Site", None, None), (None, None, None)),
    (6, _ld("broken") + _ld('{"@graph":[{"@type":"Organization","name":"Graph GmbH"},{"@type":"WebSite","name":"W"}]}'), ("Graph GmbH", None, None), ("Graph GmbH", None, None)),
    (7, "", (None, None, None), (None, None, None)),
]
SUBSTANCE = [(f"Impressum {' '.join(['x'] * 99)}", True), (f"Impressum {' '.join(['x'] * 98)}", False), (" ".join(["x"] * 200), False), (f"Acme GmbH {' '.join(['x'] * 98)}", True), ("", False), (None, False)]


def _parsed(spark, cases):
    return dom.parse(rows(spark, "page_id url html", *((c[0], "https://a.de/", c[1]) for c in cases)))


def content_section(spark, d):
    return _parsed(spark, SECTIONS).select("page_id", content.legal_section(F.col("nodes"), F.col("flow")).alias("section"))


def content_own_notice(spark, d):
    return _parsed(spark, SECTIONS[-1:]).select("page_id", content.own_notice(F.col("nodes"), F.col("flow")).alias("notice"))


def content_links(spark, d):
    return _parsed(spark, LINKS).select("page_id", F.array_join(content.ranked_links(F.col("url"), F.col("nodes")), " ").alias("links"))


def content_footer_links(spark, d):
    return _parsed(spark, LINKS).select("page_id", F.array_join(content.footer_links(F.col("nodes")), " ").alias("links"))


def content_microdata(spark, d):
    return _parsed(spark, MICRODATA).select("page_id", content.microdata(F.col("nodes"), F.col("flow")).alias("m")).select("page_id", "m.company_name", "m.phone", "m.email", "m.address")


def content_metadata(spark, d):
    return _parsed(spark, META).select("page_id", content.metadata(F.col("nodes"), F.col("title")).alias("m")).select("page_id", "m.*")


def content_entity_strict(spark, d):
    e = content.legal_entity(F.col("html"))
    return rows(spark, "page_id html", *(c[:2] for c in ENTITIES)).select("page_id", e["legal_name"].alias("name"), e["vat_id"].alias("vat"), e["city"].alias("city"))


def content_entity_checked(spark, d):
    e = content.legal_entity(F.col("html"), strict=False)
    return rows(spark, "page_id html", *(c[:2] for c in ENTITIES)).select("page_id", e["legal_name"].alias("name"), e["vat_id"].alias("vat"), e["city"].alias("city"))


def content_substantial(spark, d):
    return rows(spark, "t", *((t,) for t, _ in SUBSTANCE)).select(F.length("t").alias("n"), content.substantial(F.col("t")).alias("ok"))


def content_sections_all(spark, d):
    """Legal section and structured sections of every page, from one parse."""
    parsed = dom.parse(table(spark, d, "pages"))
    return parsed.select("page_id", F.length(content.legal_section(F.col("nodes"), F.col("flow"))).alias("section_length"), F.size("nodes").alias("n_nodes"), "error")


def best_legal_page(spark, d):
    """Documents as candidate pages of their source."""
    docs = table(spark, d, "documents")
    return content.best_legal_page(docs.select(F.col("source").alias("domain"), F.col("doc_id").alias("ord"), F.concat(F.lit("p"), "doc_id").alias("url"), F.when(F.col("doc_id") % 7 == 3, F.concat(F.col("text"), F.lit(" Impressum, Amtsgericht"))).otherwise(F.col("text")).alias("text")))


def source_engine(spark, d):
    html = '<li class="b_algo"><h2><a href="https://www.Acme.de/x">A</a></h2><a href="https://no.de">N</a></li><div class="x b_algo"><h2><a href="https://www.bing.com/r">B</a></h2></div><h2><a href="https://out.de">O</a></h2><ol><li class=b_algo><h2>t <b><a href="http://beta.de/">b</a></b></h2></ol>'
    return content.engine_results(_parsed(spark, [(1, html), (2, ""), (3, None)]))


def source_targeted(spark, d):
    found = rows(spark, "query ord domain", ("a", 0, "Acme.de"), ("a", 0, "shop.big.com"), ("b", 1, "big.com"), ("b", 1, "acme.de"), ("b", 1, "ok.org"), ("c", 2, None), ("f", 9, "late.de"))
    return content.targeted(found, rows(spark, "entry", ("big.com",), ("ok.example",), (None,)))


def source_targeted_stop(spark, d):
    found = rows(spark, "query ord domain", ("a", 0, "first.de"), ("b", 1, None), ("c", 2, None), ("d", 3, None), ("e", 4, "late.de"))
    return content.targeted(found, rows(spark, "entry", ("x.y",)))


NOTICE = "<h1>Impressum</h1><p>Beispiel GmbH<br>Musterstraße 12<br>10115 Berlin</p><p>Geschäftsführer: Max Mustermann</p><p>Amtsgericht Charlottenburg, HRB 12345</p><p>USt-IdNr.: DE123456789</p>"
#: page_id, url, domain, html
NOTICES = [
    (1, "https://a.de/impressum", "a.de", "<p>Impressum</p><p>Amtsgericht Bonn, HRB 1</p>"),
    (2, "https://a.de/legal", "a.de", NOTICE),
    (3, "https://a.de/legal/2", "a.de", NOTICE.replace("HRB 12345", "HRB 777")),
    (4, "https://b.de/", "b.de", "<p>Beta GmbH, Weg 1, 10115 Berlin</p>"),
    (5, "https://c.de/impressum", "c.de", "<script>GmbH</script>"),
    (6, None, None, None),
    (7, "https://d.de/impressum", "d.de", None),
]


def legal_records(spark, d):
    p = rows(spark, "page_id url domain html", *NOTICES).withColumns({"page_title": F.lit(None).cast("string"), "text": web.visible(F.col("html"))})
    return records.legal_records(p).select("domain", "legal_name", "legal_form", "registration_number", "directors", "vat_id", "street_address", "postal_code", "city")


def export_robust_legal(spark, d):
    return export.robust_legal(tables(spark, d)[1], "de").select("domain", "legal_name", "street_address", "postal_code", "city", "country", "phone", "email", "fax", "registrant_name", "register_court")


def export_json(spark, d):
    return export.json_rows(tables(spark, d)[0].select("domain", "emails", "phones", "run_id"))


def store_migrated(spark, d):
    return store.migrated(table(spark, d, "region").select("r_regionkey", "r_name"), "r_name string, r_comment string, r_rank long").select("r_regionkey", "r_name", "r_comment", "r_rank")


def store_created(spark, d):
    return store.created(spark, "queue").select("id", "domain", "status")


_OTHER = (content_section, content_own_notice, content_links, content_footer_links, content_microdata, content_metadata, content_entity_strict, content_entity_checked, content_substantial, content_sections_all, best_legal_page, source_engine, source_targeted, source_targeted_stop, legal_records, export_robust_legal, export_json, store_migrated, store_created)
QUERIES = {f.__name__: f for f in _OTHER}
_hit = " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in content.PAGE_WORDS)
SQL = {
    "content_section": answer("page_id section", *((i, s) for i, _, s in SECTIONS)),
    "content_own_notice": answer("page_id notice", (10, f"{LONG}\nTel. 030 1")),
    "content_links": answer("page_id links", *((i, s) for i, _, s in LINKS)),
    "content_footer_links": answer("page_id links", (1, ""), (2, "/angaben /about-us"), (3, "/legal"), (4, ""), (5, ""), (6, "")),
    "content_microdata": answer("page_id company_name phone email address", *((i, *x) for i, _, *x in MICRODATA)),
    "content_metadata": answer("page_id title author date description sitename", *((i, *x) for i, _, *x in META)),
    "content_entity_strict": answer("page_id name vat city", *((i, *s) for i, _, s, _ in ENTITIES)),
    "content_entity_checked": answer("page_id name vat city", *((i, *c) for i, _, _, c in ENTITIES)),
    "content_substantial": answer("n ok", *((None if t is None else len(t), ok) for t, ok in SUBSTANCE)),
    "best_legal_page": f"SELECT source AS domain, arg_min('p' || doc_id, doc_id + CASE WHEN ({_hit}) >= 2 THEN 0 ELSE 1000000000000 END) AS url FROM (SELECT *, lower(coalesce(CASE WHEN doc_id % 7 = 3 THEN text || ' Impressum, Amtsgericht' ELSE text END, '')) AS t FROM documents) GROUP BY source",
    "source_engine": answer("domain", ("www.acme.de",), ("beta.de",)),
    "source_targeted": answer("domain ord", ("acme.de", 0), ("ok.org", 1)),
    "source_targeted_stop": answer("domain ord", ("first.de", 0)),
    "legal_records": answer("domain legal_name legal_form registration_number directors vat_id street_address postal_code city", ("a.de", "Beispiel GmbH", "GmbH", "HRB 12345", '["Max Mustermann"]', "DE123456789", "Musterstraße 12", "10115", "Berlin")),
    "export_robust_legal": f"WITH {TABLES} SELECT domain, legal_name, coalesce(street_address, registered_street, '') AS street_address, coalesce(postal_code, registered_zip, '') AS postal_code, coalesce(city, registered_city, '') AS city, coalesce(country, registered_country, '') AS country, coalesce(phone, '') AS phone, coalesce(email, '') AS email, coalesce(fax_number, '') AS fax, CAST(NULL AS VARCHAR) AS registrant_name, register_court FROM legal WHERE legal_name <> '' AND domain ILIKE '%.de'",
    "export_json": f"WITH {TABLES} SELECT domain, to_json({{'domain': domain, 'emails': list_filter(string_split(emails, ','), lambda x: x <> ''), 'phones': list_filter([phones], lambda x: x IS NOT NULL), 'run_id': run_id}})::VARCHAR AS json FROM web",
    "store_migrated": "SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS r_comment, CAST(NULL AS BIGINT) AS r_rank FROM region",
    "store_created": "SELECT CAST(NULL AS BIGINT) AS id, '' AS domain, '' AS status WHERE false",
}
