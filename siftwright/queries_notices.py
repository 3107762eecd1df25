"""Queries over fixed notices with known answers: addresses, registers, representatives, names, records, legacy fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import classify, countries
from .functions import notices as N
from .operators import store
from .queries_fixtures import TEXTS, answer, rows
from .queries_store import table


def _parts(c: Column) -> Column:
    """A struct as one text, its fields by '|', '-' for null."""
    return F.when(c.isNotNull(), F.concat_ws("|", F.transform(F.map_values(F.from_json(F.to_json(c, {"ignoreNullFields": "false"}), "map<string,string>")), lambda x: F.coalesce(x, F.lit("-")))))


_list = lambda c: F.array_join(c, "; ")
NOTICE = "Beispiel GmbH\nAnschrift: Musterstraße 12, 10115 Berlin\nPostanschrift: Postweg 3, 10117 Berlin\nGeschäftsführer: Max Mustermann, Dr. Eva Muster\nAmtsgericht Charlottenburg, HRB 12345\nTelefax: +49 30 7654321\nE-Mail: impressum@beispiel.de"

#: name: (input columns, function, inputs)
CASES = {
    "address_parse": ("x y", lambda: _parts(N.parse_address(F.col("x"), F.col("y"))), [("Musterstraße 12, 10115 Berlin, Deutschland", "DE"), ("10 High Street, London SW1A 2AA, UK", "GB"), ("Ringstraße 1, 1010 Wien, Österreich", "AT"), ("Bahnhofstrasse 5, CH-8001 Zürich", "CH"), ("12 rue de la Paix, 75002 Paris, France", "FR"), ("1 Main St, Springfield, IL 62701", "US"), ("Via Roma 1, 00184 Roma Italia", None), ("Hof, Weg 3\n80331 München", None), ("no code here", "DE"), ("", "DE"), (None, "DE"), ("10115 Berlin", "DE"), ("Allee 7, 20095 Freie und Hansestadt Hamburg", "DE"), ("Am Markt 1, 50667 Köln, Tel 0221", "DE"), ("Calle Mayor 3, 28013 Madrid, Spain", "ES"), ("Flat 2, 5 Mill Lane, Leeds LS1 4AP", None), ("Postfach 100, 1000 Bruxelles", "BE"), ("Weg 3, 123456 Ort", "DE"), ("Str. 1, D-10115 Berlin", "DE"), ("Platz 9, 8010 Graz, Austria", None)]),
    "address_country_hint": ("x", lambda: N.country_hint(F.col("x")), [("acme.de",), ("acme.at",), ("acme.co.uk",), ("acme.design",), ("acme.com",), ("a.ch",), ("www.foo.fr",), ("b.it",), ("",), (None,)]),
    "address_of_page": ("x y", lambda: N.address_text(F.col("x"), F.col("y")), [("<address>Acme GmbH<br>Weg 1<br/>10115 Berlin</address>", ""), ("<p>x</p>", "Kommen Sie: Musterstraße 12, 10115 Berlin gern"), ("<p>x</p>", "nothing"), ("<ADDRESS><p>Line 1</p><p>Line 2</p></ADDRESS>", "Musterstraße 12, 10115 Berlin"), ("<address> </address>", "Am Kurfürstenplatz 3 80796 München heute"), (None, None), ("", "Hauptstr. 5a, 50667 Köln"), ("<address>A&amp;B</address>", "")]),
    "address_registered": ("x", lambda: _parts(N.registered_address(F.col("x"), F.lit("DE"))), [(NOTICE,), ("Sitz: Weg 1, 80331 München",), ("Registered Office: 10 High Street, London SW1A 2AA",), ("Siège social: 12 rue de la Paix, 75002 Paris",), ("Firmensitz:\nAllee 2\n20095 Hamburg",), ("Sitzung um 10115",), ("",), (None,)]),
    "address_postal": ("x", lambda: _parts(N.postal_address(F.col("x"), F.lit("DE"))), [(NOTICE,), ("Postal Address: Box 1, 10115 Berlin",), ("Anschrift: Weg 1, 80331 München",), ("",), (None,)]),
    "address_zip_country": ("x", lambda: N.zip_country(F.col("x")), [("8001",), ("10115",), ("SW1A 2AA",), ("1012 LG",), ("123456",), ("",), (None,)]),
    "address_street_ok": ("x", lambda: N.street_ok(F.col("x")), [("Musterstraße 1",), ("Weg",), ("12345",), ("Weg 1\nOrt",), ("mail@x.de 12",), ("Acme GmbH Weg 1",), ("10 High Street",), ("Telefon 12345",), ("https://a.de",), ("",), (None,)]),
    "address_city_ok": ("x", lambda: N.city_ok(F.col("x")), [("Berlin",), ("berlin",), ("Bad Homburg vor der",), ("Bad Homburg vor der Höhe",), ("B",), ("Berlin 12",), ("Kontakt",), ("Sankt Gallen",), ("",), (None,)]),
    "notice_registration": ("x", lambda: _parts(N.registration(F.col("x"))), [(NOTICE,), ("HRB 99 München",), ("Registergericht: Köln, HRA Nr. 77",), ("Company Number: 01234567",), ("Companies House SC123456",), ("EIN 12-3456789",), ("Amtsgericht Bonn",), ("HR 5",), ("",), (None,), ("hrb: 4711, amtsgericht Ulm",)]),
    "notice_representatives": ("x", lambda: _list(N.representatives(F.col("x"))), [(NOTICE,), ("Vorstand: Anna Huber und Karl Klein",), ("Directors: John Smith, Jane Doe and Max Roe",), ("Gérant: Marie Curie",), ("Legale rappresentante: Mario Rossi",), ("Inhaber: Hauptstraße 1",), ("Geschäftsführer: Herr Prof. Hans Meier",), ("CEO: Team",), ("Vertreten durch:\nAnna Huber",), ("",), (None,), ("Geschäftsführer: Max Mustermann; Max Mustermann",)]),
    "notice_fax": ("x", lambda: N.fax(F.col("x")), [(NOTICE,), ("Fax: 030 / 123 456",), ("Fax (030) 123456-7",), ("Telefon: 030 123456",), ("Fax: keine",), ("",), (None,)]),
    "notice_legal_mail": ("x", lambda: N.legal_mail(F.col("x")), [(NOTICE,), ("info@a.de legal@a.de",), ("Datenschutz@A.de",), ("info@a.de",), ("",), (None,)]),
    "notice_legal_name": ("x", lambda: N.legal_name(F.col("x")), [(NOTICE,), ("Firma: Beispiel Werke GmbH & Co. KG",), ("Wir sind die Nord Süd AG in Kiel",), ("Acme Holdings Ltd, London",), ("Raison sociale: Exemple SARL",), ("Company Name: Wicker Works",), ("GmbH",), ("kein name hier",), ("",), (None,), ("Impressum\nMüller & Söhne OHG",)]),
    "notice_clean_name": ("x", lambda: N.clean_name(F.col("x")), [("Impressum: Acme GmbH",), ("Acme GmbH, Amtsgericht Berlin",), ("Firma Acme GmbH",), ("GmbH",), ("Acme  GmbH |",), ("Kontakt - Impressum - Beta AG",), ("Acme GmbH HRB 123",), ("12 34",), ("A",), ("",), (None,), ("Acme GmbH vertreten durch Max",)]),
    "notice_form_of": ("x", lambda: N.form_of(F.col("x")), [("Acme GmbH",), ("Acme GmbH & Co. KG",), ("Acme gmbh",), ("Agentur",), ("Beta AG",), ("Gamma Ltd",), ("Delta S.r.l.",), ("Epsilon e.K.",), ("UG (haftungsbeschränkt) Zeta",), ("",), (None,)]),
    "notice_german": ("x", lambda: N.is_content_of(F.col("x"), "german"), [(NOTICE,), ("Impressum",), ("GmbH im Handelsregister",), ("hello",), ("",), (None,)]),
    "notice_austrian": ("x", lambda: N.is_content_of(F.col("x"), "austrian"), [("Firmenbuch FN 1, UID ATU1",), ("Kammer",), ("hello",), ("",), (None,)]),
    "notice_uk": ("x", lambda: N.is_content_of(F.col("x"), "uk"), [("Registered in England and Wales",), ("Acme plc",), ("hello",), ("",), (None,)]),
    "record_directors": ("x", lambda: _list(N.directors_list(F.col("x"))), [("A; B",), (" A ;; B ; ",), ("A",), ("",), (None,)]),
    "record_joined": ("x", lambda: N.joined(F.split(F.col("x"), ";")), [("a;b",), (" a ; ;b",), (";",), ("",), (None,)]),
    "record_http_status": ("x", lambda: N.http_status(F.col("x").cast("int")), [("404",), ("200",), ("500",), ("399",), ("400",), (None,)]),
    "record_language_group": ("x", lambda: N.language_group(F.col("x")), [("a.de",), ("a.at",), ("a.co.uk",), ("a.fr",), ("a.xyz",), ("a.CH",), ("",)]),
    "record_critical_paths": ("x", lambda: _list(N.critical_paths(F.split(F.col("x"), " "))), [("/impressum /kontakt",), ("https://a.de/Impressum",), ("/x",), ("/about-us",), ("",)]),
    "record_first_filled": ("x y", lambda: _parts(N.first_filled([F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.lit("fall").alias("a"), F.lit("back").alias("b"))], ["a", "b"])), [("1", "2"), ("", "2"), (None, None), ("1", "")]),
    "record_candidate_short": ("x y", lambda: N.best_candidate(F.array(F.struct(F.col("x").alias("name"), F.lit(10).alias("priority")), F.struct(F.col("y").alias("name"), F.lit(10).alias("priority")), F.struct(F.lit("low").alias("name"), F.lit(1).alias("priority")))), [("long name", "short"), ("a", "bb"), (None, "b"), (None, None)]),
    "record_candidate_first": ("x y", lambda: N.best_candidate(F.array(F.struct(F.col("x").alias("name"), F.lit(10).alias("priority")), F.struct(F.col("y").alias("name"), F.lit(20).alias("priority")), F.struct(F.lit("last").alias("name"), F.lit(20).alias("priority"))), shorter=False), [("a", "first"), ("a", None), (None, "b")]),
    "record_hours": ("x", lambda: N.business_hours(F.col("x"))["mo"], [('{"mo": "9-17"}',), ('{"tu": "9"}',), ("closed",), ("",), (None,)]),
    "record_quality": ("x y", lambda: sum((F.when(F.coalesce(F.array_contains(F.split(F.col("x"), " "), f), F.lit(False)), w).otherwise(0) for f, w in classify.QUALITY_WEIGHTS.items()), F.lit(0)).cast("string"), [("legal_name legal_form", ""), ("legal_name street_address postal_code city country registration_number vat_id ceo_name phone email legal_form", ""), ("", ""), (None, ""), ("vat_id phone", ""), ("email other", "")]),
    "legacy_personal_mail": ("x y", lambda: N.personal_mail(F.col("x"), F.col("y")), [("info@acme.de", "www.acme.de"), ("max.muster@acme.de", "acme.de"), ("joe@gmail.com", "acme.de"), ("sales@other.de", "acme.de"), ("joe@other.de", "acme.de"), ("a@mail.acme.de", "acme.de"), ("presse@acme.de", "acme.de")]),
    "legacy_best_mail": ("x y", lambda: N.best_mail(F.col("x"), F.col("y")), [("info@acme.de presse@acme.de", "acme.de"), ("max.muster@acme.de info@acme.de", "acme.de"), ("logo@2x.png", "acme.de"), ("joe@gmail.com", "acme.de"), ("", "acme.de"), (None, "acme.de")]),
    "legacy_phone": ("x", lambda: N.any_phone(F.col("x")), [("Tel: 030 123456",), ("call +49 30 1234567 now",), ("Phone (030) 123-456",), ("order 1234567",), ("0049 30 1234567",), ("",), (None,)]),
    "legacy_name": ("x y", lambda: N.plain_name(F.col("x"), F.lit(None).cast("string"), F.col("y"), F.lit("Head"), F.lit("my-shop.de")), [("Site", "T"), ("", "Acme | Home"), (None, "Welcome to the shop - Acme"), (None, "Acme - the best of all shops"), (None, "Plain"), (None, ""), (None, None)]),
    "legacy_parked": ("x y", lambda: N.legacy_parked(F.col("x"), F.col("y"), F.lit("")), [("Buy this domain", ""), ("Acme", "coming soon"), ("Acme", "We make things"), (None, None), ("Sedo", None), ("", "")]),
    "record_path": ("x y", lambda: N.stamped(F.lit("export"), F.col("x"), F.col("y")), [("0123456789ab", "2024-05-06 07:08:09"), ("", "2024-05-06 07:08:09"), (None, "1999-12-31 23:59:59"), ("ab", "2024-01-01")]),
    "record_normalised": ("x y", lambda: _parts(N.normalised({"legal_name": F.col("x"), "directors": F.col("y"), "street": F.lit("Weg 1"), "postal_code": F.lit("10115"), "city": F.lit("Berlin")})), [("Acme GmbH", "Max M; Eva N"), ("Acme GmbH", ""), ("", "Max M"), (None, None), ("Acme GmbH", " ; ")]),
    "record_registry": ("x y", lambda: _parts(N.registry_record(F.col("x"), F.col("y"), F.lit(""))), [("acme-shop.de", "Acme GmbH"), ("acme-shop.de", " "), ("a.de", None)]),
    "extract_best": ("x", lambda: countries.best_pack(F.col("x")), [(TEXTS["german"],), (TEXTS["austrian"],), (TEXTS["uk"],), ("nothing",), ("",), (None,)]),
}


def _case(name: str):
    columns, function, inputs = CASES[name]
    return lambda spark, d: rows(spark, columns, *inputs).select(*columns.split(), function().alias("found"))


#: what each input gives, in order
ANSWERS = {
    'address_parse': ['Musterstraße 12|10115|Berlin', '10 High Street|SW1A 2AA|London', 'Ringstraße 1|1010|Wien', 'Bahnhofstrasse 5|8001|Zürich', '12 rue de la Paix|75002|Paris', '1 Main St|IL 62701|Springfield', 'Via Roma 1|00184|Roma', 'Weg 3|80331|München', None, None, None, '-|10115|Berlin', 'Allee 7|20095|Freie und Hansestadt', 'Am Markt 1|50667|Köln', 'Calle Mayor 3|28013|Madrid', '5 Mill Lane|LS1 4AP|Leeds', 'Postfach 100|1000|Bruxelles', None, 'Str. 1|10115|Berlin', 'Platz 9|8010|Graz'],
    'address_country_hint': ['DE', 'AT', 'GB', 'DE', None, 'CH', 'FR', 'IT', None, None],
    'address_of_page': ['Acme GmbH, Weg 1, 10115 Berlin', 'Musterstraße 12, 10115 Berlin', None, 'Line 1, Line 2', 'Am Kurfürstenplatz 3 80796 München', None, 'Hauptstr. 5a, 50667 Köln', 'A&B'],
    'address_registered': ['Musterstraße 12|10115|Berlin', 'Weg 1|80331|München', '10 High Street|SW1A 2AA|London', '12 rue de la Paix|75002|Paris', 'Allee 2|20095|Hamburg', None, None, None],
    'address_postal': ['Postweg 3|10117|Berlin', 'Box 1|10115|Berlin', None, None, None],
    'address_zip_country': ['Switzerland', 'Germany', 'United Kingdom', 'Netherlands', None, None, None],
    'address_street_ok': [True, False, False, False, False, False, True, False, False, False, False],
    'address_city_ok': [True, False, True, False, False, False, False, True, False, False],
    'notice_registration': ['Amtsgericht Charlottenburg|HRB|HRB 12345', '-|HRB|HRB 99', 'Amtsgericht Köln|HRA|HRA 77', 'Companies House|CRN|01234567', 'Companies House|CRN|SC123456', '-|EIN|12-3456789', 'Amtsgericht Bonn|-|-', '-|-|-', '-|-|-', '-|-|-', 'Amtsgericht Ulm|HRB|HRB 4711'],
    'notice_representatives': ['Max Mustermann; Eva Muster', 'Anna Huber; Karl Klein', 'John Smith; Jane Doe; Max Roe', 'Marie Curie', 'Mario Rossi', '', 'Hans Meier', '', 'Anna Huber', '', '', 'Max Mustermann'],
    'notice_fax': ['+49 30 7654321', '030 / 123 456', '(030) 123456-7', None, None, None, None],
    'notice_legal_mail': ['impressum@beispiel.de', 'legal@a.de', 'datenschutz@a.de', None, None, None],
    'notice_legal_name': ['Beispiel GmbH', 'Beispiel Werke GmbH & Co. KG', 'Nord Süd AG', 'Acme Holdings Ltd', 'Exemple SARL', 'Wicker Works', None, None, None, None, 'Müller & Söhne OHG'],
    'notice_clean_name': ['Acme GmbH', 'Acme GmbH', 'Acme GmbH', None, 'Acme GmbH', 'Beta AG', 'Acme GmbH', None, None, None, None, 'Acme GmbH'],
    'notice_form_of': ['GmbH', 'GmbH & Co. KG', None, None, 'AG', 'Ltd', 'S.r.l.', 'e.K.', 'UG (haftungsbeschränkt)', None, None],
    'notice_german': [True, False, True, False, False, False],
    'notice_austrian': [True, False, False, False, False],
    'notice_uk': [True, False, False, False, False],
    'record_directors': ['A; B', 'A; B', 'A', '', None],
    'record_joined': ['a, b', 'a, b', '', '', None],
    'record_http_status': ['FAILED_HTTP_404', None, 'FAILED_HTTP_500', None, 'FAILED_HTTP_400', None],
    'record_language_group': ['de', 'de', 'en', 'fr', 'en', 'de', 'en'],
    'record_critical_paths': ['/impressum; /kontakt', '/impressum', '', '/about; /about-us', ''],
    'record_first_filled': ['1|2', 'fall|2', 'fall|back', '1|back'],
    'record_candidate_short': ['short', 'a', 'b', 'low'],
    'record_candidate_first': ['first', 'last', 'b'],
    'record_hours': ['9-17', None, None, None, None],
    'record_quality': ['30', '100', '0', '0', '13', '2'],
    'legacy_personal_mail': [False, True, True, False, True, False, False],
    'legacy_best_mail': ['presse@acme.de', 'info@acme.de', None, None, None, None],
    'legacy_phone': ['030 123456', '+49 30 1234567', '(030) 123-456', None, '0049 30 1234567', None, None],
    'legacy_name': ['Site', 'Acme', 'Acme', 'Acme', 'Plain', 'Head', 'Head'],
    'legacy_parked': [True, True, False, False, True, False],
    'record_path': ['export_20240506_070809_01234567', 'export_20240506_070809', 'export_19991231_235959', 'export_20240101_000000_ab'],
    'record_normalised': ['Acme GmbH|Weg 1|10115|Berlin|Max M|["Max M","Eva N"]|COMPLETE', 'Acme GmbH|Weg 1|10115|Berlin|-|[]|PARTIAL', '-|Weg 1|10115|Berlin|Max M|["Max M"]|EMPTY', '-|Weg 1|10115|Berlin|-|[]|EMPTY', 'Acme GmbH|Weg 1|10115|Berlin|-|[]|PARTIAL'],
    'record_registry': ['Acme GmbH|-|whois_fallback|20', 'Acme Shop|-|whois_fallback|0', 'A|-|whois_fallback|0'],
    'extract_best': ['german', 'austrian', 'uk', None, None, None],
}

def store_update(spark, d):
    """Segments of one nation's customers are replaced."""
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    changes = customers.where("c_nationkey = 3").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment"))
    return store.update_columns(customers, changes, "c_custkey", ["c_mktsegment"])


def store_wipe(spark, d):
    return store.wiped(table(spark, d, "region").select("r_regionkey", "r_name"))


def store_best_first(spark, d):
    return store.best_first(table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").cast("string").alias("o_orderdate")), "o_totalprice", "o_orderdate", "o_orderkey")


QUERIES = {name: _case(name) for name in CASES} | {f.__name__: f for f in (store_update, store_wipe, store_best_first)}
SQL = {name: answer(f"{CASES[name][0]} found", *((*x, y) for x, y in zip(CASES[name][2], ANSWERS[name], strict=True))) for name in CASES} | {
    "store_update": "SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 3 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "store_wipe": "SELECT r_regionkey, r_name FROM region WHERE false",
    "store_best_first": "SELECT o_orderkey, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey",
}
