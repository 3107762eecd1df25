"""What a company's notice says, beyond the country packs: register entries, representatives, addresses, names, legacy fields.

All are columns over clean text. Fields are found by their labels, which are data, and
checked by one rule each; a field that fails is null, never a guess.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from . import validate as V
from .countries import AUSTRIAN_FORM, GERMAN_FORM, MAIL, UK_FORM
from .legal import strict_person
from .text import any_of, found, has_any, hits, label, squeeze, strip
from .web import unescape

# fixed values: labels of fields by what they introduce
PEOPLE_LABELS = {
    "de": ["Geschäftsführer", "Geschäftsführerin", "Geschäftsführung", "Inhaber", "Inhaberin", "Vertreten durch", "Vertretungsberechtigt", "Vorstand"],
    "en": ["CEO", "Director", "Directors", "Managing Director", "Represented by"],
    "fr": ["Directeur", "Directeur de la publication", "Gérant", "Président", "Représentant légal"],
    "es": ["Administrador", "Representante legal"],
    "it": ["Amministratore", "Legale rappresentante"],
}
REGISTERED_LABELS = ["Anschrift", "Firmensitz", "Registered Address", "Registered Office", "Sede legale", "Siège social", "Sitz"]
POSTAL_LABELS = ["Mailing Address", "Postal Address", "Postanschrift"]
NAME_LABELS = ["Company Name", "Denominación social", "Dénomination sociale", "Diensteanbieter", "Firma", "Firmenname", "Legal Name", "Ragione sociale", "Raison sociale"]
LEGAL_MAILBOXES = ["compliance", "datenschutz", "impressum", "juridique", "legal", "privacy", "recht"]
# fixed values: forms of postal codes, in the order in which they are tried without a hint
POSTAL_FORMS = {"GB": r"[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}", "CH": r"\d{4}", "DE": r"\d{5}", "US": r"[A-Z]{2}\s\d{5}(?:-\d{4})?"}
POSTAL_OF = {"GB": "GB", "UK": "GB", "CH": "CH", "AT": "CH", "BE": "CH", "DK": "CH", "DE": "DE", "FR": "DE", "IT": "DE", "ES": "DE", "US": "US"}
COUNTRY_WORDS = ["Austria", "Deutschland", "England", "France", "Germany", "Italia", "Italy", "Österreich", "Schweiz", "Spain", "Suisse", "Switzerland", "UK", "United Kingdom", "USA"]
JUNK_WORDS = ["AGB", "Angaben gemäß § 5 TMG", "Anbieter", "Copyright", "Cookies", "Datenschutz", "Diensteanbieter", "Disclaimer", "Firma", "Herausgeber", "Home", "Imprint", "Impressum", "Inhalt", "Kontakt", "Legal Notice", "Menü", "Startseite", "Verantwortlich", "Willkommen bei"]
CUT_WORDS = ["Amtsgericht", "E-Mail", "Fax", "Geschäftsführer", "Handelsregister", "HRA", "HRB", "Registergericht", "Sitz", "Tel", "USt", "vertreten durch"]
INDICATORS = {
    "german": ["amtsgericht", "geschäftsführer", "gmbh", "handelsregister", "hra", "hrb", "impressum", "registergericht", "umsatzsteuer", "ust-idnr"],
    "austrian": ["atu", "firmenbuch", "firmenbuchgericht", "gesmbh", "handelsgericht", "kammer", "landesgericht", "österreich", "uid", "wko"],
    "uk": ["companies house", "company number", "england and wales", "limited", "llp", "ltd", "plc", "registered in", "registered office", "vat number"],
}
LEGACY_PARKED = ["buy this domain", "coming soon", "default web page", "domain for sale", "domain is for sale", "domain parking", "parked domain", "parking", "sedo", "this domain", "under construction"]
GENERIC_MAILBOXES = ["contact", "hello", "info", "kontakt", "mail", "office", "sales", "service", "support"]
IMAGE_ENDINGS = ["gif", "jpeg", "jpg", "png", "svg", "webp"]
CRITICAL_PATHS = ["/about", "/about-us", "/agb", "/aviso-legal", "/contact", "/contacto", "/datenschutz", "/impressum", "/imprint", "/kontakt", "/legal", "/legal-notice", "/mentions-legales", "/note-legali", "/privacy", "/team", "/terms", "/ueber-uns"]
LANGUAGES = {"at": "de", "be": "fr", "ch": "de", "co": "en", "com": "en", "de": "de", "es": "es", "fr": "fr", "it": "it", "li": "de", "uk": "en"}
NO_CITY = ["anschrift", "e-mail", "fax", "gmbh", "handelsregister", "impressum", "kontakt", "straße", "tel", "www"]
NO_STREET_WORDS = ["@", "copyright", "datenschutz", "e-mail", "gmbh", "handelsregister", "http", "impressum", "telefon", "www."]
FORM_ORDER = ["GmbH & Co. KG", "GmbH & Co KG", "gGmbH", "GmbH", "UG (haftungsbeschränkt)", "UG", "KGaA", "AG", "SE", "OHG", "KG", "e.K.", "e.V.", "GbR", "PLC", "LLP", "Limited", "Ltd", "LLC", "Inc", "Corp", "SASU", "SARL", "SAS", "EURL", "S.r.l.", "S.p.A.", "S.L.", "B.V.", "N.V.", "ApS", "A/S", "AB", "Oy"]


def _behind(t: Column, words: list[str], value: str) -> Column:
    """The value behind the first of the labels that has one."""
    labels = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return strip(found(t, rf"(?iu)(?<!\p{{L}})(?:{labels})(?!\p{{L}})[ \t]*[:|]?[ \t]*\n?[ \t]*{value}", 1))


# ---------------------------------------------------------------- addresses
def country_hint(domain: Column) -> Column:
    """The country whose ending a domain has anywhere; null for others."""
    d = F.lower(domain)
    return F.coalesce(*(F.when(F.contains(d, F.lit(f".{end}")), F.lit(code)) for end, code in (("de", "DE"), ("at", "AT"), ("ch", "CH"), ("uk", "GB"), ("fr", "FR"), ("it", "IT"), ("es", "ES"), ("us", "US"))))


def parse_address(text: Column, hint: Column) -> Column:
    """struct(street, zip, city) of an address in one string: around the postal code of the hinted country, or else of the first form that occurs."""
    t = F.regexp_replace(squeeze(F.regexp_replace(text, r"\n", ", ")), r"(?<![\p{L}\p{N}])[A-Z]{1,3}-(?=\d{4,5}(?!\d))", "")
    for word in COUNTRY_WORDS:
        t = F.regexp_replace(t, rf"(?iu)[ ,]*(?<!\p{{L}}){word}[. ]*$", "")
    hit = lambda form: found(t, rf"(?<![\p{{L}}\p{{N}}-])({POSTAL_FORMS[form]})(?![\p{{L}}\p{{N}}])", 1)
    hinted = F.coalesce(*(F.when(hint == code, hit(form)) for code, form in POSTAL_OF.items()))
    code = F.coalesce(hinted, *map(hit, POSTAL_FORMS))
    before, after = F.call_function("substring_index", t, code, F.lit(1)), F.regexp_replace(F.call_function("substring_index", t, code, F.lit(-1)), r"^[ ,]+", "")
    parts = F.split(strip(F.regexp_replace(before, "[ ,]+$", "")), r"[ ]*,[ ]*")
    behind = F.array_join(F.slice(F.split(F.substring_index(after, ",", 1), " "), 1, 3), " ")
    # where nothing follows the code, the town stands before it
    town_first = (after == "") & (F.size(parts) > 1)
    street = F.when(town_first, F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))
    city = F.when(town_first, F.element_at(parts, -1)).otherwise(strip(behind))
    return F.when(code.isNotNull(), F.struct(F.nullif(street, F.lit("")).alias("street"), code.alias("zip"), F.nullif(city, F.lit("")).alias("city")))


def zip_country(code: Column) -> Column:
    """The country that a postal code's form suggests: four digits are Swiss before Austrian."""
    return F.when(code.rlike(r"^\d{4}$"), "Switzerland").when(code.rlike(r"^\d{5}$"), "Germany").when(code.rlike(rf"^(?:{POSTAL_FORMS['GB']})$"), "United Kingdom").when(code.rlike(r"^\d{4}\s?[A-Z]{2}$"), "Netherlands")


def address_text(html: Column, text: Column) -> Column:
    """The address element of a page, or else a German street and town in the text."""
    element = squeeze(F.regexp_replace(found(html, r"(?is)<address\b[^>]*>(.*?)</address>", 1), r"(?i)<br\s*/?>|</(?:p|div|span)>", ", "))
    german = found(text, r"(?u)(\p{Lu}[\p{L} .-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring)[ ]?\d+[a-z]?[ ,]+\d{5}[ ]+\p{Lu}\p{L}+(?:[ -]\p{Lu}\p{L}+)?)", 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(element, "<[^>]*>", " "), r"(?:\s*,)+\s*", ", "), r"^[\s,]+|[\s,]+$", "")
    return F.coalesce(unescape(F.nullif(squeeze(plain), F.lit(""))), german)


def registered_address(text: Column, hint: Column) -> Column:
    return parse_address(_behind(text, REGISTERED_LABELS, r"([^\n]+(?:\n[^\n:]*\d{4,5}[^\n:]*)?)"), hint)


def postal_address(text: Column, hint: Column) -> Column:
    return parse_address(_behind(text, POSTAL_LABELS, r"([^\n]+(?:\n[^\n:]*\d{4,5}[^\n:]*)?)"), hint)


def street_ok(c: Column) -> Column:
    """Whether a street may be one: 5 to 100 characters with a letter, one line, no word of other fields."""
    return F.coalesce(F.length(strip(c)).between(5, 100) & c.rlike(r"\p{L}") & ~c.rlike(r"\n") & ~has_any(F.lower(c), NO_STREET_WORDS), F.lit(False))


def city_ok(c: Column) -> Column:
    """Whether a city may be one: a capital, no digit, up to four words, no word of other fields."""
    return F.coalesce(F.length(strip(c)).between(2, 50) & c.rlike(r"^\s*\p{Lu}") & ~c.rlike(r"\d") & (F.size(F.split(strip(c), r"\s+")) <= 4) & ~has_any(F.lower(c), NO_CITY), F.lit(False))


# ---------------------------------------------------------------- register, people, names
def registration(t: Column) -> Column:
    """struct(court, kind, number) of the register entry: a German court and number, else a British or American number."""
    court = strip(found(t, r"(?iu)(?:Amtsgericht|Registergericht)[ \t:]+(\p{Lu}[\p{L} -]*?)(?=[ \t]*(?:,|\n|HR[AB]|$))", 1))
    kind, number = F.upper(found(t, r"(?iu)\b(HR[AB])[ \t:]*(?:Nr\.?)?[ \t]*(\d+)", 1)), found(t, r"(?iu)\b(HR[AB])[ \t:]*(?:Nr\.?)?[ \t]*(\d+)", 2)
    house = found(t, r"(?iu)(?:Companies House|Company (?:Registration )?(?:Number|No\.?))[ \t:]*([A-Z]{0,2}\d{6,8})\b", 1)
    ein = found(t, r"(?iu)\bEIN[ \t:]*(\d{2}-\d{7})\b", 1)
    return F.struct(
        F.when(kind.isNotNull() | court.isNotNull(), F.concat(F.lit("Amtsgericht "), court)).when(house.isNotNull(), "Companies House").alias("court"),
        F.coalesce(kind, F.when(house.isNotNull(), "CRN"), F.when(ein.isNotNull(), "EIN")).alias("kind"),
        F.coalesce(F.when(kind.isNotNull(), F.concat_ws(" ", kind, number)), house, ein).alias("number"),
    )


def representatives(t: Column) -> Column:
    """All valid names behind the labels of any language, in order, each once."""
    lists = [_behind(t, words, r"([^\n:]+)") for words in PEOPLE_LABELS.values()]
    parts = F.flatten(F.filter(F.array(*(F.split(x, r"(?iu)[,;&/]|\s(?:und|and|et|y|e)\s") for x in lists)), lambda x: x.isNotNull()))
    bare = F.transform(parts, lambda x: strip(F.regexp_replace(strip(x), r"(?iu)^(?:(?:herr|frau|mr|mrs|ms|dr|prof|ing|mag|dipl\.-\p{L}+)\b\.?\s*)+", "")))
    return F.array_distinct(F.filter(F.transform(bare, lambda x: strict_person(V.person_name(x))), lambda x: x.isNotNull()))


def fax(t: Column) -> Column:
    return strip(_behind(t, ["Fax", "Faxnummer", "Telefax"], r"([+(]?\d[\d \-/().]{5,20}\d)"))


def legal_mail(t: Column) -> Column:
    """The first address whose mailbox is a legal department's."""
    all_ = F.transform(F.regexp_extract_all(t, F.lit(MAIL), F.lit(1)), F.lower)
    return F.try_element_at(F.filter(all_, lambda x: has_any(F.substring_index(x, "@", 1), LEGAL_MAILBOXES)), F.lit(1))


def clean_name(c: Column) -> Column:
    """A legal name without labels before it and other fields behind it; null for a bare form, or over 100 characters."""
    s = squeeze(c)
    junk = rf"(?iu)^(?:(?:{any_of(sorted(JUNK_WORDS, key=len, reverse=True))})(?:[ :|,.-]+|$))+"
    s = F.regexp_replace(s, junk, "")
    s = F.regexp_replace(s, rf"(?iu)[ ,|-]+(?:{any_of(CUT_WORDS)})\b.*$", "")
    s = strip(F.regexp_replace(s, r"^[ ,:|.-]+|[ ,:|-]+$", ""))
    bare = s.rlike(rf"(?iu)^(?:{GERMAN_FORM}|{AUSTRIAN_FORM}|{UK_FORM})$")
    return F.when(F.length(s).between(2, 100) & ~bare & s.rlike(r"\p{L}"), s)


def legal_name(t: Column) -> Column:
    """The name that ends in a legal form; else one behind a label."""
    forms = "|".join(re.escape(f) for f in sorted(FORM_ORDER, key=len, reverse=True))
    formed = found(t, rf"(?mu)(?<!\p{{L}})((?:\p{{Lu}}|\d)[\p{{L}}\p{{N}}&.\-]*(?:[ \t](?:&|und|and|et|of|(?:\p{{Lu}}|\d)[\p{{L}}\p{{N}}&.\-]*)){{0,6}}?[ \t](?:{forms}))(?![\p{{L}}\p{{N}}])", 1)
    return F.coalesce(clean_name(formed), clean_name(_behind(t, NAME_LABELS, r"([^\n]{2,100})")))


def form_of(name: Column) -> Column:
    """The first of the forms that a name holds as it is written."""
    return F.coalesce(*(F.when(name.rlike(rf"(?<![\p{{L}}\p{{N}}]){re.escape(f)}(?![\p{{L}}\p{{N}}])"), F.lit(f)) for f in FORM_ORDER))


def is_content_of(t: Column, country: str) -> Column:
    """Whether at least two of a country's words occur."""
    return F.coalesce(hits(F.lower(t), INDICATORS[country]) >= 2, F.lit(False))


# ---------------------------------------------------------------- records
def directors_list(c: Column) -> Column:
    """'A; B' as a list without blanks."""
    return F.filter(F.transform(F.split(c, ";"), strip), lambda x: x != "")


def joined(values: Column) -> Column:
    """The values that aren't blank, with commas."""
    return F.array_join(F.filter(F.transform(values, strip), lambda x: x.isNotNull() & (x != "")), ", ")


def http_status(code: Column) -> Column:
    return F.when(code >= 400, F.concat(F.lit("FAILED_HTTP_"), code.cast("int")))


def language_group(domain: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), F.lower(F.substring_index(domain, ".", -1))), F.lit("en"))


def critical_paths(links: Column) -> Column:
    """The paths of notices that any of the links has."""
    return F.filter(F.array(*map(F.lit, CRITICAL_PATHS)), lambda p: F.exists(links, lambda x: F.contains(F.lower(x), p)))


def first_filled(records: list[Column], fields: list[str]) -> Column:
    """A struct whose fields come from the first record that has them: fill what is missing, overwrite nothing."""
    return F.struct(*(reduce(lambda out, r: F.coalesce(out, F.nullif(r[f], F.lit(""))), records, F.lit(None).cast("string")).alias(f) for f in fields))


def best_candidate(candidates: Column, shorter: bool = True) -> Column:
    """Of candidates (name, priority) the one of highest priority: the shorter name of equal ones, or the first."""
    ranked = F.transform(candidates, lambda x, i: F.struct(x["priority"].alias("p"), (-F.length(x["name"]) if shorter else -i).alias("o"), x["name"].alias("name")))
    return F.array_max(F.filter(ranked, lambda x: x["name"].isNotNull()))["name"]


def business_hours(c: Column) -> Column:
    """Opening hours as a map, null for anything that isn't a JSON object."""
    return F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})


# ---------------------------------------------------------------- legacy fields
def personal_mail(mail: Column, domain: Column) -> Column:
    """Whether an address looks like a person's: a free provider, another domain than the company's, or first.last."""
    e, own = F.lower(mail), F.regexp_replace(F.lower(domain), r"^www\.", "")
    local, host = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    return host.isin(*L.FREE_MAIL) | (local.rlike(r"^[a-z]+\.[a-z]+$") & ~local.isin(*GENERIC_MAILBOXES)) | ((host != own) & ~host.endswith(F.concat(F.lit("."), own)) & ~local.isin(*GENERIC_MAILBOXES))


def best_mail(text: Column, domain: Column) -> Column:
    """The first address of a company, a named department before a general mailbox."""
    all_ = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MAIL), F.lit(1)), F.lower))
    good = F.filter(all_, lambda e: ~F.substring_index(e, ".", -1).isin(*IMAGE_ENDINGS) & ~personal_mail(e, domain))
    ranked = F.transform(good, lambda e, i: F.struct(F.substring_index(e, "@", 1).isin(*GENERIC_MAILBOXES).alias("g"), i.alias("i"), e.alias("e")))
    return F.array_min(ranked)["e"]


def any_phone(text: Column) -> Column:
    """The number behind a phone word, or else any number that looks like one."""
    return strip(F.coalesce(found(text, r"(?iu)(?:Telefon|Tel\.?|Phone|Fon)[ \t:]*([+(]?\d[\d \-/().]{5,18}\d)", 1), found(text, r"(?<![\d.])((?:\+|00)\d{2}[\d \-/()]{6,16}\d)", 1)))


def plain_name(site: Column, application: Column, title: Column, h1: Column, domain: Column) -> Column:
    """A page's name: of the site, the application, the first part of the title (the shorter end of one with a dash), the headline, the domain."""
    dashed = F.split(title, r"\s+-\s+")
    ends = F.when(F.length(F.element_at(dashed, 1)) <= F.length(F.element_at(dashed, -1)), F.element_at(dashed, 1)).otherwise(F.element_at(dashed, -1))
    part = F.when(F.contains(title, F.lit("|")), F.substring_index(title, "|", 1)).when(F.size(dashed) > 1, ends).otherwise(title)
    given = lambda c: F.nullif(strip(c), F.lit(""))
    return F.coalesce(given(site), given(application), given(part), given(h1), label(domain))


def legacy_parked(title: Column, description: Column, h1: Column) -> Column:
    return has_any(F.lower(F.concat_ws(" ", title, description, h1)), LEGACY_PARKED)


# ---------------------------------------------------------------- projections
def stamped(name: Column, run: Column, at: Column) -> Column:
    """A path with the time and the start of the run's id: name_yyyyMMdd_HHmmss_run."""
    return F.concat_ws("_", name, F.date_format(at.cast("timestamp_ntz"), "yyyyMMdd_HHmmss"), F.nullif(F.left(run, F.lit(8)), F.lit("")))


def normalised(record: dict[str, Column]) -> Column:
    """A legal record under its stored names: registered address, chief, directors as a list, and whether it is complete."""
    get = lambda *names: F.coalesce(*(F.nullif(record[n], F.lit("")) for n in names if n in record), F.lit(None).cast("string"))
    people = directors_list(get("directors"))
    chief = F.coalesce(get("ceo_name", "ceo"), F.try_element_at(people, F.lit(1)))
    parts = {"legal_name": get("legal_name"), "registered_street": get("registered_street", "street_address", "street"), "registered_zip": get("registered_zip", "postal_code"), "registered_city": get("registered_city", "city"), "ceo_name": chief}
    complete = reduce(lambda a, b: a & b, (x.isNotNull() for x in parts.values()))
    status = F.when(complete, "COMPLETE").when(parts["legal_name"].isNotNull(), "PARTIAL").otherwise("EMPTY")
    return F.struct(*(v.alias(k) for k, v in parts.items()), F.to_json(F.coalesce(people, F.array().cast("array<string>"))).alias("directors"), status.alias("status"))


def registry_record(domain: Column, registrant: Column, country: Column) -> Column:
    """The record of a domain whose pages could not be read: what the registry knows, or the domain's label as a name."""
    own = F.coalesce(F.nullif(strip(registrant), F.lit("")), label(domain))
    return F.struct(own.alias("company_name"), F.coalesce(F.nullif(country, F.lit("")), F.lit("-")).alias("country"), F.lit("whois_fallback").alias("method"), F.when(F.nullif(strip(registrant), F.lit("")).isNotNull(), "20").otherwise("0").alias("confidence"))
