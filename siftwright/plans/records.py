"""Legal records of domains from their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, countries, legal, notices, web
from ..functions.text import filled, found

#: the export's names of the packs' fields
NAMES = {"street": "street_address"}
FIELDS = [NAMES.get(f, f) for f in countries.FIELDS]
PLAIN = ["legal_name", "legal_form", "register_court", "registration_number", "directors", "ceo_name", "vat_id", "street", "postal_code", "city", "fax"]
LEAST = 40  # fixed value: the score from which a page counts as a notice


def plain(t: Column, domain: Column) -> Column:
    """struct(PLAIN) by the labels of any country: one set of patterns instead of a pack per country."""
    entry, people, name = notices.registration(t), notices.representatives(t), notices.legal_name(t)
    address = notices.parse_address(notices.address_text(F.lit(""), t), notices.country_hint(domain))
    return F.struct(
        name.alias("legal_name"), notices.form_of(name).alias("legal_form"), entry["court"].alias("register_court"), entry["number"].alias("registration_number"),
        F.nullif(F.array_join(people, "; "), F.lit("")).alias("directors"), F.try_element_at(people, F.lit(1)).alias("ceo_name"), found(t, r"\b((?:DE|GB)\d{9}|ATU\d{8}|FR\w{2}\d{9})\b", 1).alias("vat_id"),
        address["street"].alias("street"), address["zip"].alias("postal_code"), address["city"].alias("city"), notices.fax(t).alias("fax"),
    )


def legal_records(pages: DataFrame, by_country: bool = True) -> DataFrame:
    """(domain, FIELDS or those of PLAIN) of pages (page_id, url, domain, page_title, html, text): what the fullest notice of each domain says.

    Only pages that look like notices are read, by a country's pack or by plain. The fullest one is kept by a
    maximum, so a domain may have any number of pages; of equally full ones the smallest id counts.
    """
    notice = pages.where(F.col("domain").isNotNull() & (legal.page_score(F.col("url"), F.coalesce("page_title", F.lit("")), F.col("text")) >= LEAST))
    # what the packs refer to many times is a column of its own, and so is their result
    parts = notice.select("domain", "page_id", classify.country_context(F.col("domain"), F.col("text")).alias("context"), legal.primary_block(web.lined(F.col("html"))).alias("t"))
    read = parts.select("domain", "page_id", F.inline(F.array(countries.by_country(F.col("context"), F.col("t")) if by_country else plain(F.col("t"), F.col("domain")))))
    own = countries.FIELDS if by_country else PLAIN
    n = sum((F.coalesce(filled(F.col(f)), F.lit(False)).cast("int") for f in own), F.lit(0))
    fields = [(F.to_json(notices.directors_list(F.col(f))) if f == "directors" else F.col(f)).alias(NAMES.get(f, f)) for f in own]
    best = read.select("domain", F.struct(n.alias("n"), (-F.col("page_id")).alias("o"), *fields).alias("r")).groupBy("domain").agg(F.max("r").alias("r"))
    return best.where("r.n > 0").select("domain", *(F.col(f"r.{NAMES.get(f, f)}") for f in own))
