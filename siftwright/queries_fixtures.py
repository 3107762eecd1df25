"""Queries over fixed inputs with known answers: validators, country packs, structured data, merges, robots rules, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify, countries, legal, udfs
from .functions import validate as V
from .operators import dom, merge, structured
from .sources import readers


def rows(spark: SparkSession, columns: str, *values: tuple) -> DataFrame:
    """A small table of literals, built on the JVM."""
    names = columns.split()
    quote = lambda v: "CAST(NULL AS STRING)" if v is None else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v) if not isinstance(v, str) else "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(quote, v)) + ')' for v in values)} AS t({', '.join(names)})")


def answer(columns: str, *values: tuple) -> str:
    """SQL of a table of literals."""
    quote = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else f"CAST({v} AS {'DOUBLE' if isinstance(v, float) else 'BIGINT'})" if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, v)) + ')' for v in values)}) t({', '.join(columns.split())})"


#: name: (function of the input column, [(input, result)])
SCALARS = {
    "validate_domain_skip": (lambda c: V.skip_domain(c), [("mail.example.de", True), ("mail.de", False), ("uni-bonn.de", True), ("www.tuwien.ac.at", True), ("a/b", True), ("shop.example.de", False), ("", True)]),
    "validate_postal": (V.postal_code, [("12345", "12345"), ("CH-8001", "CH-8001"), ("1012 lg", "1012 LG"), ("sw1a 2aa", "SW1A 2AA"), ("123", ""), (" 8001 ", "8001"), ("123456", "")]),
    "validate_city": (V.city, [("Berlin", "Berlin"), ("Telgte", ""), ("B", ""), ("  Köln ", "Köln"), ("12345 X", "")]),
    "validate_street": (V.street, [("Musterstraße 1", "Musterstraße 1"), ("Hagenstraße 5", ""), ("Hauptstr. 1, 12345, Berlin", "Hauptstr. 1"), ("DE", ""), ("Weg\n1 xx", "")]),
    "validate_ceo": (V.ceo_name, [("Max Mustermann", "Max Mustermann"), ("Team", ""), ("Dr. Eva Muster", "Dr. Eva Muster"), ("Person des Anbieters", ""), ("A B", ""), ("Amtsgericht Berlin", "")]),
    "validate_vat": (V.vat_id, [("DE 123 456 789", "DE123456789"), ("ATU12345678", "ATU12345678"), ("FR12345678901", "FR12345678901"), ("US123456789", None), ("nl123456789b01", "NL123456789B01")]),
    "validate_regno": (V.registration_number, [("hrb 12345 b", "HRB 12345b"), ("01234567", "01234567"), ("rcs paris 123456789", "RCS Paris 123456789"), ("abc", None), ("FN 1a", "FN 1a")]),
    "validate_legal_form": (V.legal_form, [("gmbh", "GmbH"), ("LTD", "Ltd"), ("ag", "AG"), ("Something unusual", "Something unusual"), ("A form that is far too long", None)]),
    "validate_company_field": (V.field_company_name, [("Beispiel GmbH", "Beispiel GmbH"), ("Cookie Shop", None), ("12345 6789", None), ("GoDaddy LLC", None), ("beispiel gmbh", None), ("Haus und Garten", None), ("Datenschutz AG", None)]),
    "validate_company_web": (V.web_company_name, [("Acme  Corporation", "Acme Corporation"), ("Home", None), ("Acme 2024", None), ("Login page", None), ("a", None), ("www.acme.com", None)]),
    "validate_email_web": (V.web_email, [("Info@Acme.com", "info@acme.com"), ("max.muster@acme.com", None), ("info@gmail.com", "info@gmail.com"), ("joe@gmail.com", None), ("a..b@acme.com", None), ("x@acme", None)]),
    "validate_email_field": (V.field_email, [("INFO@acme.de", "info@acme.de"), ("a@example.com", None), ("no mail", None), ("a@test.com", None)]),
    "validate_person": (V.person_name, [("Marie Curie", "Marie Curie"), ("Marie@Curie", None), ("12345", None), ("Wird Nicht", None), ("Jo", None)]),
    "validate_phone": (lambda c: V.phone(c, "DE"), [("+49 30 1234567", "+49 301234567"), ("030 1234567", "+49 301234567"), ("123", None), ("+1 212 5550199", "+1 2125550199")]),
    "company_size_form": (lambda c: classify.company_size(c, F.lit("x.de")), [("AG", "enterprise"), ("GmbH", "sme"), ("e.K.", "solo"), ("UG", "solo"), ("Genossenschaft", "enterprise"), ("", "unknown")]),
    "company_size_domain": (lambda c: classify.company_size(F.lit(""), c), [("garden.de", "enterprise"), ("stadt.example.de", "government"), ("siemens.com", "enterprise"), ("muster.de", "unknown")]),
    "rdap_dates": (structured.date, [("2020-05-01T10:00:00Z", "2020-05-01"), ("2021-06-30", "2021-06-30"), ("30.06.2021 noon", "30.06.2021")]),
    "validate_menu_name": (legal.menu_free_name, [("Home | About", None), ("Beispiel GmbH", "Beispiel GmbH"), ("Shop (0)", None), ("news", None), ("10115 Berlin", None), ("Kontakt - Firma AG", None), ("Nord - Süd GmbH", "Nord - Süd GmbH")]),
    "validate_strict_person": (legal.strict_person, [("Max Mustermann", "Max Mustermann"), ("Siemens AG", None), ("Hauptstraße 1", None), ("Max", None), ("Dr. Eva von der Muster", "Dr. Eva von der Muster")]),
    "validate_vat_number": (legal.vat_number, [("DE 123456789", True), ("ATU12345678", True), ("XX1", False), ("CHE123456789", True)]),
    "saved_street": (legal.saved_street, [("Weg 1", "Weg 1"), ("a\nb 12", ""), ("x@y.de 1", ""), ("", "")]),
    "saved_person": (legal.saved_person, [("Team", ""), ("Max Mustermann", "Max Mustermann"), ("X", "")]),
    "primary_block": (legal.primary_block, [("\nAcme GmbH\nWeg 1\nKonzeption und Design\nAgentur X\nTelefon 1\nEnde", "Acme GmbH\nWeg 1\nTelefon 1\nEnde")]),
    "llm_json": (lambda c: F.get_json_object(structured.answer(c), "$.a"), [('x ```json\n{"a": "1"}\n``` y', "1"), ('so {"a": "2"} it is', "2"), ("none", None), ("{broken", None)]),
}

TEXTS = {
    "german": "Beispiel GmbH\nAnschrift: Musterstraße 12, 10115 Berlin, Deutschland\n\nGeschäftsführer: Max Mustermann\n\nAmtsgericht Charlottenburg, HRB 12345 B\nUSt-IdNr.: DE123456789\nTelefon: +49 30 1234567\nE-Mail: info@beispiel.de\n",
    "austrian": "Firmenbuchnummer: 123456a\nGeschäftsführer: Mag. Anna Huber\nUID: ATU12345678\nAnschrift: Ringstraße 1, 1010 Wien\n",
    "uk": "Company Number: 01234567\nDirectors: John Smith and Jane Doe\nRegistered Office: 10 High Street, SW1A 2AA\nExample Widgets Ltd\n",
    "french": "Raison sociale: Exemple SARL\nSiège social: 12 rue de la Paix, 75002 Paris\n\nRCS Paris 123456789\nSIREN: 123456789\nGérant: Marie Curie\nEmail: contact@exemple.fr",
    "generic": "Company Name: Wicker Works B.V.\nAddress: Keizersgracht 1, 10115 Amsterdam\nCompany No: 12345678\nCEO: Jan Jansen\nEmail: info@widget.nl\n",
}
LEGAL = {
    "german": dict(legal_name="Beispiel GmbH", legal_form="GmbH", register_type="HRB", register_court="Amtsgericht Charlottenburg", registration_number="HRB 12345 B", directors="Max Mustermann", ceo_name="Max Mustermann", vat_id="DE123456789", street="Musterstraße 12", postal_code="10115", city="Berlin", country="Germany", phone="+49 30 1234567", email="info@beispiel.de", confidence=100.0),
    "austrian": dict(registration_number="FN 123456a", directors="Anna Huber", ceo_name="Anna Huber", vat_id="ATU12345678", street="Ringstraße 1", postal_code="1010", city="Wien", country="Austria", confidence=83.0),
    "uk": dict(legal_form="Ltd", register_court="Companies House", registration_number="01234567", directors="John Smith; Jane Doe", ceo_name="John Smith", street="10 High Street", postal_code="SW1A 2AA", country="United Kingdom", confidence=89.0),
    "french": dict(legal_name="Exemple SARL", legal_form="SARL", register_type="RCS", register_court="RCS Paris", registration_number="123456789", siren="123456789", directors="Marie Curie", ceo_name="Marie Curie", street="12 rue de la Paix", postal_code="75002", city="Paris", country="France", email="contact@exemple.fr", confidence=0.0),
    "generic": dict(legal_name="Wicker Works B.V.", legal_form="B.V.", registration_number="12345678", directors="Jan Jansen", ceo_name="Jan Jansen", street="Keizersgracht 1", postal_code="10115", city="Amsterdam", email="info@widget.nl", confidence=0.0),
}
_LEGAL_COLUMNS = [*countries.FIELDS, "confidence"]


def _legal(context: str):
    def query(spark, d):
        t = rows(spark, "t", (TEXTS[context],)).withColumn("x", countries.PACKS[context](F.col("t")))
        return t.select("x.*", countries.confidence(F.col("x"), F.lit(context)).alias("confidence"))

    return query


PAGE = """<html><head><title>Acme Corporation - Home</title><meta name="description" content="We make things"><meta property="og:site_name" content="Acme">
<script type="application/ld+json">{"@context": "https://schema.org", "@graph": [{"@type": "WebSite", "name": "site"}, {"@type": "Corporation", "name": "Acme Corporation", "legalName": "Acme Corp.", "vatID": "DE123456789", "email": "hello@acme.com",
"telephone": "+49 30 1234567", "address": {"streetAddress": "Main 1", "postalCode": "10115", "addressLocality": "Berlin", "addressCountry": "DE"}, "sameAs": ["https://linkedin.com/company/acme"]}]}</script></head>
<body><nav class="menu"><a href="/impressum">Impressum</a></nav><h1>Acme</h1><p>First paragraph of the page<p>Second paragraph of it<ul><li>one<li>two</ul>
<a href="https://twitter.com/acme">t</a><a href="mailto:support@acme.com?x=1">mail</a><footer>&copy; 2024 Acme Corporation <a href="/kontakt">Kontakt</a></footer></body></html>"""


def extract_routed(spark, d):
    """All countries' texts at once: the context is found and each row read by its country's patterns."""
    t = rows(spark, "domain t", *((f"x.{tld}", TEXTS[c]) for c, tld in (("german", "de"), ("austrian", "at"), ("uk", "co.uk")))).withColumn("context", classify.country_context(F.col("domain"), F.col("t")))
    x = countries.by_country(F.col("context"), F.col("t"))
    return t.select("context", F.to_json(F.struct(x["registration_number"].alias("n"), x["city"].alias("c"))).alias("found"))


def jsonld_organisation(spark, d):
    return rows(spark, "h", (PAGE,)).select(structured.organisation(F.col("h")).alias("o")).select("o.name", "o.legal_name", "o.vat_id", "o.email", "o.phone", "o.street", "o.postal_code", "o.city", "o.country", F.array_join("o.same_as", ";").alias("same_as"))


def open_graph(spark, d):
    from .functions import web

    return rows(spark, "h", (PAGE,)).select(structured.open_graph(F.col("h"))["site_name"].alias("site_name"), web.meta(F.col("h"), "description").alias("description"), F.to_json(structured.social(web.hrefs(F.col("h")))).alias("social"))


def dom_fixture(spark, d):
    """Unclosed paragraphs and list items, as sections."""
    parsed = dom.parse(rows(spark, "page_id url html", (1, "https://acme.com/", PAGE)))
    return dom.sections(parsed).select("kind", "text")


RDAP = '{"entities": [{"handle": "H1", "roles": ["registrar"], "vcardArray": ["vcard", [["fn", {}, "text", "Registrar Inc"]]]}, {"handle": "H2", "roles": ["registrant"], "vcardArray": ["vcard", [["fn", {}, "text", "Acme Owner"], ["org", {}, "text", "Acme"], ["adr", {}, "text", ["", "", "Main 1", "Berlin", "", "10115", "DE"]]]]}], "events": [{"eventAction": "registration", "eventDate": "2010-01-02T03:04:05Z"}, {"eventAction": "expiration", "eventDate": "2030-01-02"}], "status": ["active", "locked"]}'


def rdap_parse(spark, d):
    return rows(spark, "j", (RDAP,)).select(structured.rdap(F.col("j")).alias("r")).select("r.*")


def _lookup(spark, *values):
    base = rows(spark, "domain registrant_name registrant_country name_servers status", *values)
    empty = {c: F.lit(None).cast("string") for c in merge.REGISTRY_FIELDS if c not in ("registrant_name", "registrant_country")}
    return base.withColumns({**empty, "name_servers": F.split("name_servers", ","), "status": F.split("status", ",")})


def registry_merge(spark, d):
    rdap = _lookup(spark, ("a.de", "Example GmbH", "DE", "NS1.x,ns2.x", "ok"), ("b.de", "Bee", None, "n.b", "ok"))
    whois = _lookup(spark, ("a.de", "example gmbh", None, "ns1.x,ns3.x", "active"), ("c.de", "Cee Ltd", "GB", "n.c", "held"))
    out = merge.registry(rdap, whois)
    return out.select("domain", "registrant_name", "registrant_country", F.array_join("name_servers", ";").alias("name_servers"), F.array_join("registry_status", ";").alias("registry_status"), "source", "whois_confidence")


def whois_confidence(spark, d):
    t = rows(spark, "a b c", ("Example GmbH", "example gmbh", True), ("", "", False), ("Example", "Example GmbH", False))
    return t.select("a", classify.whois_confidence(F.col("a"), F.col("b"), F.col("c"), F.lit(False)).alias("confidence"))


def legal_accumulate(spark, d):
    t = rows(spark, "domain page_ord legal_name legal_form registration_number ceo_name vat_id", ("x.de", 1, "A", None, "R1", None, None), ("x.de", 2, "B", "F", None, "C", None), ("x.de", 3, "D", None, None, None, "V"), ("y.de", 1, None, "G", None, None, None))
    return merge.accumulate_legal(t)


def generic_accumulate(spark, d):
    t = rows(spark, "domain ord emails title", ("x.de", 1, "b,a", ""), ("x.de", 2, "c,a", "T2"), ("x.de", 3, "d", "T3")).withColumn("emails", F.split("emails", ","))
    return merge.accumulate_pages(t, "domain", "ord", ["emails"], ["title"]).select("domain", F.array_join("emails", ";").alias("emails"), "title")


def structured_over_section(spark, d):
    section = rows(spark, "domain legal_name city", ("x.de", "Section GmbH", ""), ("y.de", None, "Bonn"))
    other = rows(spark, "domain legal_name city", ("x.de", "Other", "Berlin"), ("y.de", "Why AG", "Köln"))
    return merge.prefer(section, other, "domain", ["legal_name", "city"])


def validate_address(spark, d):
    t = rows(spark, "s z c k", ("Musterstraße 1", "123 45", "Berlin", "deutschland"), ("Menu", "sw1a 2aa", "1234", "uk"), ("", "12", "B", "Norway"))
    return t.select(V.address(F.col("s"), F.col("z"), F.col("c"), F.col("k")).alias("a")).select("a.*")


def robots_decision(spark, d):
    body = "User-agent: *\nDisallow: /private"
    t = rows(spark, "domain status body url", ("a.de", 200, body, "https://a.de/"), ("b.de", 200, body, "https://b.de/private/x"), ("c.de", 404, "", "https://c.de/"), ("d.de", 0, None, "https://d.de/"))
    allowed = F.when(F.col("status") == 0, "ERROR").when(F.col("status") != 200, "ALLOWED").when(udfs.robots_allows("body", "url"), "ALLOWED").otherwise("DISALLOWED")
    return t.select("domain", allowed.alias("robots_status"), (allowed == "ALLOWED").cast("string").alias("robots_allowed"))


def source_certificates(spark, d):
    t = rows(spark, "value", ('[{"common_name": "*.acme.de", "name_value": "x"}, {"common_name": "", "name_value": "a.acme.de\\nb.acme.de"}, {"common_name": "mail.acme.de"}]',))
    return readers.domains(readers.certificates(t), "crtsh", "de")


def source_archive(spark, d):
    t = rows(spark, "value", ('[["original"], ["http://shop.acme.de:80/x"], ["acme.de/y"], ["https://other.fr/"]]',))
    return readers.domains(readers.archive_index(t), "wayback", "de")


def source_crawl_index(spark, d):
    t = rows(spark, "value", ('{"url": "https://Acme.de/a"}',), ("broken",), ('{"url": "https://acme.de/b"}',), ('{"url": "https://beta.de/"}',))
    return readers.domains(readers.crawl_index(t), "common_crawl", "de", 1)


def source_search(spark, d):
    html = '<a class="result__a" href="//r.example/l/?uddg=https%3A%2F%2Facme.de%2Fx&amp;z=1">A</a><a class="result__a" href="https://beta.de/">B</a><a href="https://no.de">N</a>'
    return readers.domains(readers.search_results(dom.parse(rows(spark, "page_id url html", (1, "https://s.example", html)))), "search", "de")


def discover_plan(spark, d):
    c = lambda name, n: spark.range(n).select(F.concat(F.lit(name), F.col("id"), F.lit(".de")).alias("domain"))
    found = readers.discover({"targeted": c("t", 50), "tranco": c("r", 50), "majestic": c("m", 5), "common_crawl": c("t", 60), "search": c("s", 9)}, "de", 30, "all")
    return found.groupBy("domain").agg(F.min_by("source", "ord").alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def name_fits_domain(spark, d):
    t = rows(spark, "name domain", ("Acme GmbH", "www.acme.de"), ("Nice Agentur", "acme.de"), ("Other GmbH", "acme.de"), ("Other", "acme.de"), (None, "acme.de"))
    return t.select("name", legal.name_fits_domain(F.col("name"), F.col("domain")).alias("fits"))


def legal_page_score(spark, d):
    t = rows(spark, "url title t", ("https://a.de/impressum", "Impressum", TEXTS["german"]), ("https://a.de/", "Shop", "buy now"), ("https://a.co.uk/x", "About", TEXTS["uk"]))
    return t.select("url", legal.page_score(F.col("url"), F.col("title"), F.col("t")).cast("long").alias("score"))


def public_sector(spark, d):
    t = rows(spark, "form domain t", ("AG", "x.gv.at", ""), ("GmbH", "x.de", "Die Verwaltung"), ("GmbH", "x.de", "Firma"))
    return t.select("domain", legal.public_sector_form(F.col("form"), F.col("domain"), F.col("t")).alias("form"))


def german_address(spark, d):
    t = rows(spark, "s z c", ("Weg 1", "10115", "Berlin"), ("7", "10115", "Berlin"), ("Anschrift:", "10115", "Berlin"), ("Weg 1", "1011", "Wien"), (None, "10115", "Berlin"))
    return t.select("s", "z", legal.german_address(F.col("s"), F.col("z"), F.col("c")).alias("ok"))


def crawl_status(spark, d):
    t = rows(spark, "k resolves http n late", (1, True, 200, 9000, False), (2, False, 0, 0, False), (3, True, 503, 0, False), (4, True, 200, 10, False), (5, True, 200, 9000, True))
    return t.select(F.col("k").cast("long").alias("k"), legal.crawl_status(F.col("resolves"), F.col("http"), F.col("n"), F.col("late")).alias("status"))


def persist_gate(spark, d):
    t = rows(spark, "k status method source", ("a", "SUCCESS", None, None), ("b", "NO_DATA", "whois_fallback", None), ("c", None, None, "rdap"), ("d", "NO_DATA", "whois_fallback_only", "none"))
    return t.where(legal.worth_saving(F.col("status"), F.col("method"), F.col("source"))).select("k")


def saved_names(spark, d):
    t = rows(spark, "name domain", ("Cookie settings", "acme.de"), ("Acme GmbH", "acme.de"), ("Since 2024", "beta-x.de"), ("A", "gamma.de"))
    return t.select("domain", legal.saved_name(F.col("name"), F.col("domain")).alias("name"))


def notice_urls(spark, d):
    t = rows(spark, "base links", ("https://a.de", "https://a.de/kontakt https://a.de/shop https://a.de/impressum https://a.de/kontakt"), ("https://b.de", "https://b.de/shop"))
    return t.select("base", F.array_join(legal.notice_urls(F.col("base"), F.split("links", " ")), " ").alias("urls"))


def export_grades(spark, d):
    t = rows(spark, "score", (100.0,), (65.5,), (40.0,), (21.0,), (0.0,))
    return t.select("score", classify.grade(F.col("score")).alias("grade"))


def _scalar(f, pairs):
    return lambda spark, d: rows(spark, "x", *((a,) for a, _ in pairs)).select("x", f(F.col("x")).alias("y"))


_OTHER = (extract_routed, jsonld_organisation, open_graph, dom_fixture, rdap_parse, registry_merge, whois_confidence, legal_accumulate, generic_accumulate, structured_over_section, validate_address, robots_decision, source_certificates, source_archive, source_crawl_index, source_search, discover_plan, export_grades, name_fits_domain, legal_page_score, public_sector, german_address, crawl_status, persist_gate, saved_names, notice_urls)
QUERIES = {name: _scalar(f, pairs) for name, (f, pairs) in SCALARS.items()} | {f"extract_{c}": _legal(c) for c in TEXTS} | {f.__name__: f for f in _OTHER}
SQL = {name: answer("x y", *pairs) for name, (_, pairs) in SCALARS.items()} | {f"extract_{c}": answer(" ".join(_LEGAL_COLUMNS), tuple(LEGAL[c].get(f) for f in _LEGAL_COLUMNS)) for c in TEXTS} | {
    "extract_routed": answer("context found", ("german", '{"n":"HRB 12345 B","c":"Berlin"}'), ("austrian", '{"n":"FN 123456a","c":"Wien"}'), ("uk", '{"n":"01234567"}')),
    "jsonld_organisation": answer("name legal_name vat_id email phone street postal_code city country same_as", ("Acme Corporation", "Acme Corp.", "DE123456789", "hello@acme.com", "+49 30 1234567", "Main 1", "10115", "Berlin", "DE", "https://linkedin.com/company/acme")),
    "open_graph": answer("site_name description social", ("Acme", "We make things", '{"twitter":"https://twitter.com/acme"}')),
    "dom_fixture": answer("kind text", ("heading", "Acme"), ("paragraph", "First paragraph of the page"), ("paragraph", "Second paragraph of it"), ("list", "one"), ("list", "two")),
    "rdap_parse": answer("registrar registrant_name registrant_org registrant_country created updated expires status", ("Registrar Inc", "Acme Owner", "Acme", "DE", "2010-01-02", None, "2030-01-02", "active; locked")),
    "registry_merge": answer("domain registrant_name registrant_country name_servers registry_status source whois_confidence", ("a.de", "Example GmbH", "DE", "ns1.x;ns2.x;ns3.x", "active;ok", "rdap+whois", 0.9), ("b.de", "Bee", "", "n.b", "ok", "rdap", 0.4), ("c.de", "Cee Ltd", "GB", "n.c", "held", "whois", 0.3)),
    "whois_confidence": answer("a confidence", ("Example GmbH", 0.9), ("", 0.0), ("Example", 0.7)),
    "legal_accumulate": answer("domain legal_name legal_form registration_number ceo_name vat_id", ("x.de", "B", "F", "R1", "C", "V"), ("y.de", None, "G", None, None, None)),
    "generic_accumulate": answer("domain emails title", ("x.de", "a;b;c;d", "T2")),
    "structured_over_section": answer("domain legal_name city", ("x.de", "Section GmbH", "Berlin"), ("y.de", "Why AG", "Bonn")),
    "validate_address": answer("street zip city country", ("Musterstraße 1", "12345", "Berlin", "Germany"), (None, None, None, "United Kingdom"), (None, None, None, "Norway")),
    "robots_decision": answer("domain robots_status robots_allowed", ("a.de", "ALLOWED", "true"), ("b.de", "DISALLOWED", "false"), ("c.de", "ALLOWED", "true"), ("d.de", "ERROR", "false")),
    "source_certificates": answer("domain source", ("acme.de", "crtsh"), ("a.acme.de", "crtsh"), ("b.acme.de", "crtsh")),
    "source_archive": answer("domain source", ("shop.acme.de", "wayback"), ("acme.de", "wayback")),
    "source_crawl_index": answer("domain source", ("acme.de", "common_crawl")),
    "source_search": answer("domain source", ("acme.de", "search"), ("beta.de", "search")),
    "discover_plan": answer("source n", ("targeted", 10), ("tranco", 10), ("majestic", 5), ("common_crawl", 5), ("search", 9)),
    "name_fits_domain": answer("name fits", ("Acme GmbH", True), ("Nice Agentur", False), ("Other GmbH", True), ("Other", False), (None, True)),
    "legal_page_score": answer("url score", ("https://a.de/impressum", 100), ("https://a.de/", 0), ("https://a.co.uk/x", 30)),
    "public_sector": answer("domain form", ("x.gv.at", ""), ("x.de", ""), ("x.de", "GmbH")),
    "german_address": answer("s z ok", ("Weg 1", "10115", True), ("7", "10115", False), ("Anschrift:", "10115", False), ("Weg 1", "1011", False), (None, "10115", False)),
    "crawl_status": answer("k status", (1, None), (2, "PARTIAL_DNS"), (3, "PARTIAL_HTTP"), (4, "PARTIAL_FETCH"), (5, "PARTIAL_TIMEOUT")),
    "persist_gate": answer("k", ("a",), ("b",), ("c",)),
    "saved_names": answer("domain name", ("acme.de", "Acme"), ("acme.de", "Acme GmbH"), ("beta-x.de", "Beta-x"), ("gamma.de", "Gamma")),
    "notice_urls": answer("base urls", ("https://a.de", "https://a.de/impressum https://a.de/kontakt"), ("https://b.de", "https://b.de/impressum https://b.de/impressum.html https://b.de/impressum.php https://b.de/legal https://b.de/legal-notice")),
    "export_grades": answer("score grade", (100.0, "A"), (65.5, "B"), (40.0, "C"), (21.0, "D"), (0.0, "F")),
}
