"""Classifiers and scores as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import best_class, filled, has_any, strip


def weighted(fields: Mapping[str, int], most: int = 100) -> Column:
    """The sum of the weights of the fields that have a value, at most `most`."""
    return F.least(F.lit(float(most)), sum((F.when(filled(F.col(f).cast("string")), float(w)).otherwise(0.0) for f, w in fields.items()), F.lit(0.0)))


# fixed values: weights of the scores
WEB_WEIGHTS = {"company_name": 25, "emails": 20, "phones": 20, "address": 15, "description": 10, "social": 5, "industry": 5}
QUALITY_WEIGHTS = {"legal_name": 20, "legal_form": 10, "street_address": 15, "postal_code": 5, "city": 10, "country": 5, "registration_number": 15, "vat_id": 10, "ceo_name": 5, "phone": 3, "email": 2}
COUNTRY_WEIGHTS = {
    "german": {"legal_name": 20, "registration_number": 30, "directors": 25, "legal_form": 15, "vat_id": 10, "street": 8, "postal_code": 5, "city": 5, "register_court": 2},
    "austrian": {"registration_number": 30, "directors": 25, "legal_form": 15, "vat_id": 10, "street": 8, "postal_code": 5, "city": 5, "register_court": 2},
    "uk": {"registration_number": 35, "directors": 25, "legal_form": 15, "vat_id": 8, "street": 7, "postal_code": 5, "city": 3, "register_court": 2},
}


def industry(text: Column, description: Column | None = None) -> Column:
    whole = F.lower(F.concat(F.substring(F.coalesce(text, F.lit("")), 1, 2000), F.lit(" "), F.coalesce(description, F.lit("")) if description is not None else F.lit("")))
    return F.coalesce(best_class(whole, L.INDUSTRIES), F.lit(""))


def enterprise(domain: Column) -> Column:
    """Whether the domain holds the name of a large company anywhere."""
    return F.coalesce(has_any(F.lower(domain), L.ENTERPRISES), F.lit(False))


def company_size(form: Column, domain: Column, employees: Column | None = None) -> Column:
    f, d = F.lower(F.coalesce(form, F.lit(""))), F.lower(F.coalesce(domain, F.lit("")))
    n = F.coalesce(employees, F.lit(0)) if employees is not None else F.lit(0)
    return (
        F.when(has_any(d, L.GOVERNMENT), "government")
        .when(has_any(d, L.ENTERPRISES), "enterprise")
        .when(n > 250, "enterprise")
        .when(n > 10, "sme")
        .when(has_any(f, L.GOVERNMENT_FORMS), "government")
        .when(has_any(f, L.ENTERPRISE_FORMS), "enterprise")
        .when(has_any(f, L.SME_FORMS), "sme")
        .when(has_any(f, L.SOLO_FORMS), "solo")
        .otherwise("unknown")
    )


def parked(title: Column, text: Column, metas: Column | None = None) -> Column:
    out = has_any(F.lower(F.coalesce(title, F.lit(""))), L.PARKED) | has_any(F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, 3000), L.PARKED)
    if metas is not None:
        out = out | has_any(F.lower(F.coalesce(metas, F.lit(""))), L.PARKED)
    return out | (F.length(strip(F.coalesce(text, F.lit("")))) < 100)


def country(url: Column, text: Column) -> Column:
    """By parts of the URL, then by words of the text."""
    u, t = F.lower(url), F.lower(F.coalesce(text, F.lit("")))
    rules = [(F.contains(u, F.lit(part)), code) for part, code in L.URL_COUNTRIES] + [(has_any(t, words), code) for code, words in L.TEXT_COUNTRIES]
    return F.coalesce(*(F.when(rule, F.lit(code)) for rule, code in rules), F.lit("UNKNOWN"))


def country_context(domain: Column, text: Column) -> Column:
    """Which country's patterns to use: by top-level domain, then by words, then by neighbouring top-level domains."""
    d, t = F.lower(F.coalesce(domain, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(d.endswith(".at"), "austrian")
        .when(d.endswith(".de"), "german")
        .when(d.endswith(".uk"), "uk")
        .otherwise(F.coalesce(best_class(t, L.CONTEXT), F.when(d.rlike(r"\.(?:fr|ch)$"), "german"), F.lit("uk")))
    )


def whois_confidence(rdap_name: Column, whois_name: Column, has_country: Column, has_address: Column) -> Column:
    a, b = F.lower(strip(F.coalesce(rdap_name, F.lit("")))), F.lower(strip(F.coalesce(whois_name, F.lit(""))))
    agree = F.when((a == "") | (b == ""), 0.0).when(a == b, 0.2).when(F.contains(a, b) | F.contains(b, a), 0.1).otherwise(0.0)
    return F.round(F.when(a != "", 0.4).otherwise(0.0) + F.when(b != "", 0.2).otherwise(0.0) + agree + F.when(has_country, 0.1).otherwise(0.0) + F.when(has_address, 0.1).otherwise(0.0), 2)


def grade(score: Column, names: str = "ABCDF") -> Column:
    out = F.when(score >= 80, names[0])
    for i, least in enumerate((60, 40, 20), 1):
        if i < len(names) - 1:
            out = out.when(score >= least, names[i])
    return out.otherwise(names[-1])
