"""Structured data: JSON-LD, OpenGraph, registry documents and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import found
from ..functions.web import json_ld, meta

ORGANISATIONS = ["Organization", "Corporation", "LocalBusiness", "Company"]  # fixed value


def items(html: Column) -> Column:
    """All JSON-LD objects of a page, as text: single ones, arrays and @graph members, in order."""
    parts = lambda doc: F.coalesce(
        F.from_json(F.get_json_object(doc, "$['@graph']"), "array<string>"),
        F.when(F.ltrim(doc).startswith("["), F.from_json(doc, "array<string>")),
        F.when(F.get_json_object(doc, "$").isNotNull(), F.array(doc)),
        F.array().cast("array<string>"),
    )
    return F.flatten(F.transform(json_ld(html), parts))


def organisation(html: Column) -> Column:
    """struct(name, legal_name, description, email, phone, vat_id, street, postal_code, city, country, same_as) of the first organisation; null without one."""
    typed = F.filter(items(html), lambda x: F.get_json_object(x, "$['@type']").rlike("|".join(ORGANISATIONS)))
    it = F.try_element_at(typed, F.lit(1))
    get = lambda p: F.get_json_object(it, p)
    same = get("$.sameAs")
    return F.when(
        it.isNotNull(),
        F.struct(
            get("$.name").alias("name"), F.coalesce(get("$.legalName"), get("$.name")).alias("legal_name"), get("$.description").alias("description"),
            F.coalesce(get("$.email"), get("$.contactPoint.email"), get("$.contactPoint[0].email")).alias("email"),
            F.coalesce(get("$.telephone"), get("$.contactPoint.telephone"), get("$.contactPoint[0].telephone")).alias("phone"),
            F.coalesce(get("$.vatID"), get("$.taxID")).alias("vat_id"),
            get("$.address.streetAddress").alias("street"), get("$.address.postalCode").alias("postal_code"), get("$.address.addressLocality").alias("city"), get("$.address.addressCountry").alias("country"),
            F.coalesce(F.from_json(same, "array<string>"), F.when(same.isNotNull(), F.array(same)), F.array().cast("array<string>")).alias("same_as"),
        ),
    )


def open_graph(html: Column) -> Column:
    return F.struct(meta(html, "og:site_name").alias("site_name"), meta(html, "og:description").alias("description"), meta(html, "og:image").alias("image"))


def social(links: Column) -> Column:
    """Map of platform to the last profile link on it."""
    # fixed values: what a profile link looks like
    forms = {"linkedin": r"linkedin\.com/company/[^/\s]+", "facebook": r"facebook\.com/[^/\s]+", "twitter": r"(?:twitter|x)\.com/[^/\s]+", "instagram": r"instagram\.com/[^/\s]+", "youtube": r"youtube\.com/(?:c/|channel/|user/)[^/\s]+"}
    last = lambda form: F.try_element_at(F.filter(links, lambda x: x.rlike(form)), F.lit(-1))
    entries = [F.struct(F.lit(name).alias("k"), last(form).alias("v")) for name, form in forms.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))


RDAP = "struct<entities:array<struct<handle:string,roles:array<string>,vcardArray:string>>,events:array<struct<eventAction:string,eventDate:string>>,status:array<string>>"


def rdap(document: Column) -> Column:
    """struct(registrar, registrant_name, registrant_org, registrant_country, created, updated, expires, status) of a registry answer."""
    d = F.from_json(document, RDAP)
    role = lambda r: F.try_element_at(F.filter(d["entities"], lambda e: F.array_contains(e["roles"], r)), F.lit(1))
    card = lambda e, name: F.try_element_at(F.filter(F.from_json(F.get_json_object(e["vcardArray"], "$[1]"), "array<array<string>>"), lambda x: x[0] == name), F.lit(1))
    day = lambda action: date(F.try_element_at(F.filter(d["events"], lambda e: e["eventAction"] == action), F.lit(1))["eventDate"])
    country = F.element_at(F.from_json(F.try_element_at(card(role("registrant"), "adr"), F.lit(4)), "array<string>"), -1)
    return F.struct(
        F.coalesce(F.try_element_at(card(role("registrar"), "fn"), F.lit(4)), role("registrar")["handle"]).alias("registrar"),
        F.try_element_at(card(role("registrant"), "fn"), F.lit(4)).alias("registrant_name"),
        F.try_element_at(card(role("registrant"), "org"), F.lit(4)).alias("registrant_org"),
        country.alias("registrant_country"),
        day("registration").alias("created"), day("last changed").alias("updated"), day("expiration").alias("expires"),
        F.array_join(d["status"], "; ").alias("status"),
    )


def date(c: Column) -> Column:
    """YYYY-MM-DD of an ISO time, else the first ten characters."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd"), F.substring(c, 1, 10))


def answer(text: Column) -> Column:
    """The JSON object of a model's answer: in a code fence, else from the first brace to the last; null if it isn't JSON."""
    fenced = found(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    raw = F.coalesce(fenced, found(text, r"(?s)(\{.*\})", 1))
    return F.when(F.get_json_object(raw, "$").isNotNull(), raw)
