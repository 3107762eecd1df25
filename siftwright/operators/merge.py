"""Merging evidence: several pages of a domain, registry and lookup data, structured and section data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import whois_confidence
from ..functions.text import blank, filled

# fixed values: the fields that are counted when two pages compete
KEY_FIELDS = ["legal_name", "legal_form", "registration_number", "ceo_name", "directors", "registered_street", "registered_city", "registered_zip", "phone", "email", "vat_id"]
REGISTRY_FIELDS = ["registrant_name", "registrant_address", "registrant_city", "registrant_zip", "registrant_country", "registrant_email", "registrant_phone", "registrar", "created_date", "expiry_date", "updated_date"]


def _filled_count(row: Column, fields: list[str]) -> Column:
    return sum((filled(row[f]).cast("int") for f in fields), F.lit(0))


def _over(first: Column, second: Column, fields: list[str]) -> Column:
    """first, with its gaps filled from second."""
    return F.struct(*(F.when(blank(first[f]), second[f]).otherwise(first[f]).alias(f) for f in fields))


def accumulate_legal(pages: DataFrame, key: str = "domain", order: str = "page_ord", fields: list[str] | None = None) -> DataFrame:
    """One row per domain: pages in order; a page with more filled fields wins and is completed by what was there, else what was there is completed by the page.

    Pages of a domain are few (the crawl plan bounds them), so they are folded in one array.
    """
    fields = fields or [f for f in KEY_FIELDS if f in pages.columns]
    rows = pages.select(key, F.struct(F.col(order).alias("_o"), *(F.col(f).cast("string").alias(f) for f in fields)).alias("r")).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    start = F.struct(*(F.lit(None).cast("string").alias(f) for f in fields))
    fold = F.aggregate("rs", start, lambda a, x: F.when(_filled_count(x, fields) > _filled_count(a, fields), _over(x, a, fields)).otherwise(_over(a, x, fields)))
    return rows.select(key, fold.alias("m")).select(key, "m.*")


def accumulate_pages(pages: DataFrame, key: str, order: str, lists: list[str], scalars: list[str]) -> DataFrame:
    """One row per domain: lists united and sorted, scalars from the first page that has a value."""
    return pages.groupBy(key).agg(
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists),
        *(F.min_by(F.when(filled(F.col(c)), F.col(c)), F.when(filled(F.col(c)), F.col(order))).alias(c) for c in scalars),
    )


def registry(rdap: DataFrame, whois: DataFrame) -> DataFrame:
    """Registry data over lookup data by field, united lists, source and confidence; a domain of either is in the result."""
    lists = ["name_servers", "status"]
    side = lambda df, p: df.select("domain", *(F.col(c).alias(p + c) for c in [*REGISTRY_FIELDS, *lists]), F.lit(True).alias(p + "has"))
    both = side(rdap, "r_").join(side(whois, "w_"), "domain", "full_outer")
    pick = [F.when(blank(F.col("r_" + c)), F.coalesce("w_" + c, F.lit(""))).otherwise(F.col("r_" + c)).alias(c) for c in REGISTRY_FIELDS]
    none = F.array().cast("array<string>")
    united = lambda c, f: F.array_sort(F.array_distinct(F.transform(F.concat(F.coalesce("r_" + c, none), F.coalesce("w_" + c, none)), f)))
    any_ = lambda c: filled(F.col("r_" + c)) | filled(F.col("w_" + c))
    return both.select(
        "domain",
        *pick,
        united("name_servers", F.lower).alias("name_servers"),
        united("status", lambda x: x).alias("registry_status"),
        F.when(F.col("r_has") & F.col("w_has"), "rdap+whois").when(F.col("r_has"), "rdap").when(F.col("w_has"), "whois").otherwise("none").alias("source"),
        whois_confidence(F.col("r_registrant_name"), F.col("w_registrant_name"), F.coalesce(any_("registrant_country"), F.lit(False)), F.coalesce(any_("registrant_address"), F.lit(False))).alias("whois_confidence"),
    )


def prefer(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per field the first table's value, or else the second's (section over structured, model answer over pattern, page over registry)."""
    b = second.select(key, *(F.col(f).alias("_" + f) for f in fields))
    return first.join(b, key, "left").select(*(F.when(blank(F.col(c)), F.col("_" + c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in first.columns))


def address_line(*parts: Column) -> Column:
    """'street, zip, city, country' of the parts that have a value."""
    return F.concat_ws(", ", *(F.nullif(p, F.lit("")) for p in parts))
