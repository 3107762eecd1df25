"""Exports, statistics and reports over the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, validate
from ..functions.text import blank, filled, strip
from ..sources.readers import in_tld

UNIFIED = ["company_name", "legal_form", "registration_number", "ceo_names", "owner_organization", "industry", "company_size", "emails", "phone_numbers", "fax_numbers", "street", "postal_code", "city", "country", "service_product_description", "social_links", "website_created_at", "website_last_updated_at", "domain", "crawled_at", "run_id", "robots_allowed", "robots_reason"]


def text(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def first_of(*columns: Column) -> Column:
    """The first that isn't null, '' without one; '' counts as a value."""
    return F.coalesce(*columns, F.lit(""))


def run_filter(web: DataFrame, run_id: str | None) -> DataFrame:
    """Rows of a run; 'latest' is the run of the newest row."""
    if run_id == "latest":
        newest = web.agg(F.max_by("run_id", F.struct("crawled_at", "domain")).alias("run_id"))
        return web.join(F.broadcast(newest), "run_id", "left_semi")  # one row
    return web.where(F.col("run_id") == run_id) if run_id else web


def ceo_names(ceo: Column, directors: Column) -> Column:
    """Valid names of the chief and the directors (a JSON array), each once, sorted."""
    listed = F.coalesce(F.from_json(directors, "array<string>"), F.array().cast("array<string>"))
    names = F.filter(F.transform(F.concat(F.array(F.coalesce(ceo, F.lit(""))), listed), validate.ceo_name), filled)
    return F.array_join(F.array_sort(F.array_distinct(names)), "; ")


def unified(web: DataFrame, legal: DataFrame, queue: DataFrame, tld: str | None = None, run_id: str | None = None, complete_only: bool = False) -> DataFrame:
    """One cleaned row per crawled domain in the 23 published columns; the order column is confidence_score.

    Two left joins on the domain: co-located if the tables are clustered by it.
    """
    r = run_filter(web, run_id).where(in_tld(F.col("domain"), tld, any_case=True)).alias("r")
    l, q = legal.alias("l"), queue.alias("q")  # noqa: E741
    rows = r.join(l, F.col("r.domain") == F.col("l.domain"), "left").join(q, F.col("r.domain") == F.col("q.domain"), "left")
    name = F.substring(strip(F.when(filled(F.col("l.legal_name")), F.col("l.legal_name")).otherwise(F.col("r.company_name"))), 1, 100)
    socials = F.map_filter(F.create_map(*(x for k in ("linkedin", "facebook", "instagram", "twitter", "youtube") for x in (F.lit(k), F.col(f"r.social_{k}")))), lambda _, v: filled(v))
    allowed = F.coalesce(F.col("q.robots_status") == "ALLOWED", F.lit(False))
    semicolons = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit("; "))
    out = rows.select(
        F.coalesce(name, F.lit("")).alias("company_name"), text(F.col("l.legal_form")).alias("legal_form"), text(F.col("l.registration_number")).alias("registration_number"),
        ceo_names(F.col("l.ceo_name"), F.col("l.directors")).alias("ceo_names"), F.lit("").alias("owner_organization"), text(F.col("r.industry")).alias("industry"),
        classify.company_size(F.col("l.legal_form"), F.col("r.domain")).alias("company_size"), semicolons(F.col("r.emails")).alias("emails"), semicolons(F.col("r.phones")).alias("phone_numbers"),
        text(first_of(F.col("l.fax"), F.col("l.fax_number"))).alias("fax_numbers"), validate.street(first_of(F.col("l.street_address"), F.col("l.registered_street"))).alias("street"),
        validate.postal_code(first_of(F.col("l.postal_code"), F.col("l.registered_zip"))).alias("postal_code"), validate.city(first_of(F.col("l.city"), F.col("l.registered_city"))).alias("city"),
        text(first_of(F.col("l.country"), F.col("l.registered_country"))).alias("country"), F.substring(F.coalesce("r.description", F.lit("")), 1, 500).alias("service_product_description"),
        F.when(F.size(socials) > 0, F.to_json(socials)).otherwise("").alias("social_links"), F.lit("").alias("website_created_at"), F.lit("").alias("website_last_updated_at"),
        F.col("r.domain").alias("domain"), F.col("r.crawled_at").alias("crawled_at"), F.col("r.run_id").alias("run_id"), F.when(allowed, "true").otherwise("false").alias("robots_allowed"),
        F.when(filled(F.col("q.robots_reason")), F.col("q.robots_reason")).when(allowed, "allowed").otherwise("unknown").alias("robots_reason"), F.col("r.confidence_score").alias("confidence_score"),
    )
    if complete_only:
        out = out.where((F.length("company_name") > 2) & (filled(F.col("street")) | filled(F.col("postal_code")) | filled(F.col("city"))))
    return out


def client_spec(legal: DataFrame, web: DataFrame, tld: str | None = None) -> DataFrame:
    """The 14-column export from the legal side, with `complete` for rows that have all six required fields."""
    l, r = legal.where(in_tld(F.col("domain"), tld, any_case=True)).alias("l"), web.alias("r")  # noqa: E741
    rows = l.join(r, F.col("l.domain") == F.col("r.domain"), "left")
    listed = F.coalesce(F.array_join(F.filter(F.from_json("l.directors", "array<string>"), filled), "; "), F.col("l.directors"), F.lit(""))
    out = rows.select(
        F.col("l.domain").alias("domain"), text(F.coalesce("l.legal_name", "r.company_name")).alias("company_name"), text(F.col("l.legal_form")).alias("legal_form"),
        text(F.coalesce("l.street_address", "l.registered_street")).alias("street"), text(F.coalesce("l.postal_code", "l.registered_zip")).alias("postal_code"), text(F.coalesce("l.city", "l.registered_city")).alias("city"),
        text(F.coalesce("l.country", "l.registered_country", F.lit("Germany"))).alias("country"), text(F.col("l.ceo_name")).alias("ceo_name"), listed.alias("directors"),
        text(F.coalesce(F.col("l.email"), F.substring_index("r.emails", ",", 1))).alias("email"), text(F.coalesce(F.col("l.phone"), F.substring_index("r.phones", ",", 1))).alias("phone"),
        text(F.col("l.register_type")).alias("register_type"), text(F.col("l.register_court")).alias("register_court"), text(F.col("l.registration_number")).alias("registration_number"),
    )
    f = lambda c: filled(F.col(c))
    return out.withColumn("complete", f("company_name") & f("legal_form") & f("street") & f("postal_code") & f("city") & (f("ceo_name") | f("directors")) & (f("email") | f("phone")) & f("registration_number"))


def full_metadata() -> Column:
    """Name, an address (current or registered) and any contact."""
    f = lambda c: filled(F.col(c))
    return f("legal_name") & ((f("street_address") & f("city")) | (f("registered_street") & f("registered_city"))) & (f("phone") | f("email") | f("fax") | f("ceo_name"))


def enhanced(web: DataFrame, legal: DataFrame) -> DataFrame:
    """All web columns with the legal ones, and the directors' JSON as a list with semicolons (kept as it is where it isn't JSON)."""
    own = [c for c in legal.columns if c != "domain"]
    renamed = legal.select("domain", *(F.col(c).alias({"vat_id": "legal_vat_id", "extraction_confidence": "legal_confidence"}.get(c, c)) for c in own if c not in web.columns or c == "vat_id"))
    out = web.join(renamed, "domain", "left")
    return out.withColumn("directors", F.coalesce(F.array_join(F.filter(F.from_json("directors", "array<string>"), filled), "; "), "directors"))


ROBUST = ["domain", "legal_name", "registrant_name", "legal_form", "street_address", "postal_code", "city", "country", "registrant_address", "registrant_city", "registrant_country", "register_type", "register_court", "registration_number", "vat_id", "ceo_name", "directors", "phone", "email", "fax", "legal_notice_url", "extraction_confidence", "extraction_date"]  # fixed value: the published columns
#: later names of a field, in order of preference
FALLBACKS = {"street_address": ["registered_street"], "postal_code": ["registered_zip"], "city": ["registered_city"], "country": ["registered_country"], "phone": ["legal_phone"], "email": ["legal_email"], "fax": ["fax_number"]}


def robust_legal(legal: DataFrame, tld: str | None = None) -> DataFrame:
    """The named legal entities in the 23 published columns; columns that the table lacks are null."""
    have = lambda c: F.col(c) if c in legal.columns else F.lit(None).cast("string")
    pick = lambda c: F.coalesce(have(c), *(have(x) for x in FALLBACKS[c]), F.lit("")) if c in FALLBACKS else have(c)
    return legal.where(filled(F.col("legal_name")) & in_tld(F.col("domain"), tld, any_case=True)).select(*(pick(c).alias(c) for c in ROBUST))


def json_rows(web: DataFrame, lists: tuple[str, ...] = ("emails", "phones")) -> DataFrame:
    """(domain, json) of all columns: comma lists as arrays, opening hours as an object where they are one."""
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")
    rows = web.withColumns({c: parts(F.col(c)) for c in lists if c in web.columns})
    if "business_hours" in web.columns:
        rows = rows.withColumn("business_hours", F.from_json("business_hours", "map<string,string>"))
    return rows.select("domain", F.to_json(F.struct(*(F.col(c) for c in rows.columns))).alias("json"))


def save_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per partition."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("quoteAll", False).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, total, share) of the rows that have a value, in one pass over the table."""
    one = df.agg(F.count("*").alias("total"), *(F.count_if(filled(F.col(f).cast("string"))).alias(f) for f in fields))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields))
    return one.select("total", F.inline(pairs)).where("total > 0").select("field", "n", "total", F.format_string("%.1f%%", F.col("n").cast("double") * 100 / F.col("total").cast("double")).alias("share"))


def statistics(web: DataFrame, legal: DataFrame, queue: DataFrame) -> DataFrame:
    """(name, value): totals, mean positive confidence, high-confidence and registered counts; one pass per table."""
    w = web.agg(F.count("*").alias("web_results"), F.round(F.coalesce(F.avg(F.when(F.col("confidence_score") > 0, F.col("confidence_score"))), F.lit(0.0)), 6).alias("mean_confidence"), F.count_if(F.col("confidence_score") > 70).alias("high_confidence"))
    l = legal.agg(F.count("*").alias("legal_entities"), F.count_if(~blank(F.col("registration_number"))).alias("with_registration"), F.count_if(~blank(F.col("vat_id"))).alias("with_vat"))  # noqa: E741
    q = queue.agg(F.count("*").alias("queued"), F.count_if(F.col("status") == "PENDING").alias("pending"))
    long = lambda df: df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns))))
    return long(w).unionByName(long(l)).unionByName(long(q))
