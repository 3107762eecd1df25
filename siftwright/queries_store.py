"""Queries over the queue and the result tables, which are derived from the driver's tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify
from .functions.text import filled
from .operators import merge, store
from .plans import export
from .streaming import status

TLDS = ["de", "at", "co.uk", "fr", "com"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(web results, legal entities, queue) with one domain per customer; two of three customers have a legal entity, three of four are queued."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    domain = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit("."), F.element_at(F.array(*map(F.lit, TLDS)), (k % 5 + 1).cast("int")))
    every = lambda n, value, other=None: F.when(k % n == 0, other).otherwise(value)
    web = c.select(
        domain.alias("domain"), every(7, F.col("c_name")).alias("company_name"), F.concat(F.lit("Maker of "), F.lower("c_mktsegment")).alias("description"),
        every(3, F.concat(F.lit("info@c"), k, F.lit(".example,sales@c"), k, F.lit(".example")), F.lit("")).alias("emails"), every(2, F.concat(F.lit("+49 30 "), k + 1000000)).alias("phones"),
        F.initcap("c_mktsegment").alias("industry"), F.round(F.greatest(F.lit(0.0), F.col("c_acctbal") / 100), 2).alias("confidence_score"), every(5, F.concat(F.lit("https://linkedin.com/company/c"), k)).alias("social_linkedin"),
        every(4, F.concat(F.lit("https://x.com/c"), k), F.lit("")).alias("social_twitter"), F.lit(None).cast("string").alias("social_facebook"), F.lit(None).cast("string").alias("social_instagram"), F.lit(None).cast("string").alias("social_youtube"),
        F.timestamp_seconds(F.lit(1_700_000_000) + k * 60).alias("crawled_at"), F.concat(F.lit("run"), (k % 3).cast("string")).alias("run_id"),
    )
    forms = F.element_at(F.array(*map(F.lit, ["GmbH", "AG", "e.K.", "Ltd", "UG", "SARL"])), (k % 6 + 1).cast("int"))
    legal = c.where(k % 3 != 0).select(
        domain.alias("domain"), every(4, F.concat(F.col("c_name"), F.lit(" "), forms)).alias("legal_name"), forms.alias("legal_form"), every(5, F.concat(F.lit("HRB "), k), F.lit("")).alias("registration_number"),
        F.lit("HRB").alias("register_type"), F.lit("Amtsgericht Berlin").alias("register_court"), every(2, F.lit("Max Mustermann"), F.lit("Team")).alias("ceo_name"),
        F.when(k % 4 == 0, '["Erika Muster","Max Mustermann","info"]').when(k % 4 == 1, "not json").when(k % 4 == 2, "[]").alias("directors"), F.concat(F.lit("DE"), F.lpad(k.cast("string"), 9, "0")).alias("vat_id"),
        every(3, F.concat(F.lit("Musterstraße "), k % 90 + 1)).alias("street_address"), F.concat(F.lit("Ringweg "), k % 9 + 1).alias("registered_street"), every(6, F.lpad((k % 99999).cast("string"), 5, "1"), F.lit("")).alias("postal_code"),
        F.lit("10115").alias("registered_zip"), F.when(k % 2 == 0, "Berlin").alias("city"), F.lit("Hamburg").alias("registered_city"), F.lit(None).cast("string").alias("country"), every(5, F.lit("Austria")).alias("registered_country"),
        every(2, F.lit("office@legal.example")).alias("email"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("fax"), every(8, F.lit("+49 30 99")).alias("fax_number"), F.round(F.abs("c_acctbal") / 100, 2).alias("extraction_confidence"),
    )
    queue = c.where(k % 4 != 0).select(
        k.alias("id"), domain.alias("domain"), F.lit("customer").alias("source"), F.element_at(F.array(*map(F.lit, ["PENDING", "COMPLETED", "FAILED_DNS", "PROCESSING", "PARTIAL_HTTP"])), (k % 5 + 1).cast("int")).alias("status"),
        F.timestamp_seconds(F.lit(1_690_000_000) + k * 60).alias("updated_at"), F.element_at(F.array(*map(F.lit, ["ALLOWED", "DISALLOWED", "ERROR"])), (k % 3 + 1).cast("int")).alias("robots_status"), F.when(k % 9 == 0, "by rule").alias("robots_reason"),
    )
    return web, legal, queue


_DOMAIN = "lower(replace(c_name, '#', '-')) || '.' || ['de', 'at', 'co.uk', 'fr', 'com'][c_custkey % 5 + 1]"
TABLES = f"""
  c AS (SELECT *, c_custkey AS k, {_DOMAIN} AS domain, ['GmbH', 'AG', 'e.K.', 'Ltd', 'UG', 'SARL'][c_custkey % 6 + 1] AS form FROM customer),
  web AS (SELECT domain, CASE WHEN k % 7 <> 0 THEN c_name END AS company_name, 'Maker of ' || lower(c_mktsegment) AS description,
    CASE WHEN k % 3 = 0 THEN '' ELSE 'info@c' || k || '.example,sales@c' || k || '.example' END AS emails, CASE WHEN k % 2 <> 0 THEN '+49 30 ' || (k + 1000000) END AS phones,
    upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS industry, round(greatest(0.0, c_acctbal / 100), 2) AS confidence_score,
    CASE WHEN k % 5 <> 0 THEN 'https://linkedin.com/company/c' || k END AS social_linkedin, CASE WHEN k % 4 = 0 THEN '' ELSE 'https://x.com/c' || k END AS social_twitter,
    make_timestamp((1700000000 + k * 60) * 1000000) AS crawled_at, 'run' || (k % 3) AS run_id FROM c),
  legal AS (SELECT domain, CASE WHEN k % 4 <> 0 THEN c_name || ' ' || form END AS legal_name, form AS legal_form, CASE WHEN k % 5 = 0 THEN '' ELSE 'HRB ' || k END AS registration_number,
    'HRB' AS register_type, 'Amtsgericht Berlin' AS register_court, CASE WHEN k % 2 = 0 THEN 'Team' ELSE 'Max Mustermann' END AS ceo_name,
    CASE k % 4 WHEN 0 THEN '["Erika Muster","Max Mustermann","info"]' WHEN 1 THEN 'not json' WHEN 2 THEN '[]' END AS directors, 'DE' || lpad(CAST(k AS VARCHAR), 9, '0') AS vat_id,
    CASE WHEN k % 3 <> 0 THEN 'Musterstraße ' || (k % 90 + 1) END AS street_address, 'Ringweg ' || (k % 9 + 1) AS registered_street, CASE WHEN k % 6 = 0 THEN '' ELSE lpad(CAST(k % 99999 AS VARCHAR), 5, '1') END AS postal_code,
    '10115' AS registered_zip, CASE WHEN k % 2 = 0 THEN 'Berlin' END AS city, 'Hamburg' AS registered_city, CAST(NULL AS VARCHAR) AS country, CASE WHEN k % 5 <> 0 THEN 'Austria' END AS registered_country,
    CASE WHEN k % 2 <> 0 THEN 'office@legal.example' END AS email, CAST(NULL AS VARCHAR) AS phone, CASE WHEN k % 8 <> 0 THEN '+49 30 99' END AS fax_number, round(abs(c_acctbal) / 100, 2) AS extraction_confidence FROM c WHERE k % 3 <> 0),
  queue AS (SELECT k AS id, domain, 'customer' AS source, ['PENDING', 'COMPLETED', 'FAILED_DNS', 'PROCESSING', 'PARTIAL_HTTP'][k % 5 + 1] AS status, make_timestamp((1690000000 + k * 60) * 1000000) AS updated_at,
    ['ALLOWED', 'DISALLOWED', 'ERROR'][k % 3 + 1] AS robots_status, CASE WHEN k % 9 = 0 THEN 'by rule' END AS robots_reason FROM c WHERE k % 4 <> 0)
"""
# what the export's checks come to on these tables: street and city are clean, a postal code has five digits
_NAME = "substr(trim(coalesce(nullif(legal_name, ''), company_name)), 1, 100)"
_SOCIAL = """CASE WHEN coalesce(social_linkedin, '') = '' AND coalesce(social_twitter, '') = '' THEN '' ELSE '{' || array_to_string(list_filter([
    CASE WHEN coalesce(social_linkedin, '') <> '' THEN '"linkedin":"' || social_linkedin || '"' END, CASE WHEN coalesce(social_twitter, '') <> '' THEN '"twitter":"' || social_twitter || '"' END], lambda x: x IS NOT NULL), ',') || '}' END"""
_UNIFIED = f"""
  joined AS (SELECT r.*, l.* EXCLUDE (domain), q.robots_status, q.robots_reason FROM web r LEFT JOIN legal l ON r.domain = l.domain LEFT JOIN queue q ON r.domain = q.domain),
  unified AS (SELECT coalesce({_NAME}, '') AS company_name, coalesce(legal_form, '') AS legal_form, coalesce(registration_number, '') AS registration_number,
    array_to_string(list_sort(list_distinct(list_filter([CASE WHEN ceo_name = 'Max Mustermann' THEN ceo_name END, CASE WHEN directors LIKE '["Erika%' THEN 'Erika Muster' END, CASE WHEN directors LIKE '["Erika%' THEN 'Max Mustermann' END], lambda x: x IS NOT NULL))), '; ') AS ceo_names,
    '' AS owner_organization, industry,
    CASE WHEN legal_form = 'AG' THEN 'enterprise' WHEN legal_form IN ('GmbH', 'Ltd', 'SARL') THEN 'sme' WHEN legal_form IN ('UG', 'e.K.') THEN 'solo' ELSE 'unknown' END AS company_size,
    replace(coalesce(emails, ''), ',', '; ') AS emails, replace(coalesce(phones, ''), ',', '; ') AS phone_numbers, coalesce(fax_number, '') AS fax_numbers, coalesce(street_address, registered_street, '') AS street,
    coalesce(postal_code, registered_zip, '') AS postal_code, coalesce(city, registered_city, '') AS city, coalesce(country, registered_country, '') AS country, substr(coalesce(description, ''), 1, 500) AS service_product_description,
    {_SOCIAL} AS social_links, '' AS website_created_at, '' AS website_last_updated_at, domain, CAST(epoch(crawled_at) AS BIGINT) AS crawled_at, run_id,
    CASE WHEN robots_status = 'ALLOWED' THEN 'true' ELSE 'false' END AS robots_allowed, coalesce(nullif(robots_reason, ''), CASE WHEN robots_status = 'ALLOWED' THEN 'allowed' ELSE 'unknown' END) AS robots_reason, confidence_score FROM joined)
"""


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("crawled_at", F.unix_timestamp("crawled_at")) if "crawled_at" in df.columns else df


def export_unified(spark, d):
    return _plain(export.unified(*tables(spark, d)))


def export_unified_complete_de(spark, d):
    return _plain(export.unified(*tables(spark, d), tld="DE", complete_only=True))


def export_unified_latest(spark, d):
    return _plain(export.unified(*tables(spark, d), run_id="latest")).select("domain", "run_id", "company_size")


def export_client_spec(spark, d):
    web, legal, _ = tables(spark, d)
    return export.client_spec(legal, web)


def export_client_completeness(spark, d):
    web, legal, _ = tables(spark, d)
    return export.client_spec(legal, web).agg(F.count("*").alias("exported"), F.count_if("complete").alias("complete"), F.round(F.avg(F.col("complete").cast("double")), 6).alias("rate"))


def export_legal_strict(spark, d):
    _, legal, _ = tables(spark, d)
    return legal.where(export.full_metadata()).select("domain", "legal_name", "street_address", "city", "extraction_confidence")


def export_enhanced(spark, d):
    web, legal, _ = tables(spark, d)
    return export.enhanced(web, legal).select("domain", "company_name", "legal_name", "legal_vat_id", "legal_confidence", "directors")


def join_reverse(spark, d):
    web, legal, _ = tables(spark, d)
    return legal.join(web.select("domain", "emails", "phones"), "domain", "left").select("domain", "legal_name", "emails", "phones")


def completed_without_legal(spark, d):
    _, legal, queue = tables(spark, d)
    return queue.where("status = 'COMPLETED'").join(legal, "domain", "left_anti").select("id", "domain")


def blacklist_anti(spark, d):
    web, _, _ = tables(spark, d)
    return store.without_blacklisted(web.select("domain"), ["00001", "9.com", "77"])


def tld_filter_ci(spark, d):
    web, _, _ = tables(spark, d)
    return web.where(export.in_tld(F.col("domain"), "CO.UK", any_case=True)).select("domain")


def insert_or_ignore(spark, d):
    web, _, queue = tables(spark, d)
    new = web.select("domain", F.lit("web").alias("source"), F.lit(1).alias("ord")).unionByName(web.where("domain like '%1.at'").select("domain", F.lit("list").alias("source"), F.lit(0).alias("ord")))
    return store.insert_or_ignore(queue.select("domain", "source"), new, "domain", ["ord", "source"])


def insert_or_replace(spark, d):
    web, _, queue = tables(spark, d)
    new = web.where("run_id = 'run1'").select("domain", F.lit("PARKED").alias("status"))
    return store.insert_or_replace(queue.select("domain", "status", "source"), new, "domain")


def upsert_subset(spark, d):
    web, legal, _ = tables(spark, d)
    new = web.where("run_id <> 'run2'").select("domain", F.lit("9.9").alias("vat_id"), F.col("company_name").alias("legal_name"))
    return store.upsert(legal.select("domain", "legal_name", "vat_id", "city"), new, "domain", ["vat_id", "legal_name"])


def reset_failed(spark, d):
    return store.reset_failed(tables(spark, d)[2]).groupBy("status").agg(F.count("*").alias("n"))


def reset_listed(spark, d):
    q = tables(spark, d)[2]
    return q.select("id", F.when(F.col("status").isin("PARTIAL_HTTP", "FAILED_DNS"), "PENDING").otherwise(F.col("status")).alias("status"))


def status_update(spark, d):
    q = tables(spark, d)[2]
    changes = q.where("id % 2 = 1").select("domain", F.lit("PROCESSING").alias("status"), F.col("updated_at")).unionByName(q.where("id % 6 = 1").select("domain", F.lit("COMPLETED").alias("status"), (F.col("updated_at") + F.expr("interval 1 hour")).alias("updated_at")))
    return store.set_status(q, changes).select("id", "status", F.unix_timestamp("updated_at").alias("updated_at"))


def pending_batch(spark, d):
    return store.pending(tables(spark, d)[2], 50).select("id", "domain")


def sample_newest(spark, d):
    return tables(spark, d)[2].orderBy(F.desc("updated_at"), "domain").limit(20).select("domain", F.unix_timestamp("updated_at").alias("updated_at"))


def topk_confidence(spark, d):
    return tables(spark, d)[1].where(filled(F.col("legal_name"))).orderBy(F.desc("extraction_confidence"), "domain").limit(10).select("domain", "legal_name", "extraction_confidence")


def latest_run(spark, d):
    return tables(spark, d)[0].agg(F.max_by("run_id", "crawled_at").alias("run_id"))


def status_breakdown(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


def status_in_list(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def progress_rollup(spark, d):
    e = table(spark, d, "events")
    done = F.count_if(F.col("event_type").isin("click", "purchase"))
    minutes = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 60e6
    return e.agg(F.count("*").alias("total"), done.alias("done"), F.round(done / minutes, 4).alias("per_minute"))


def avg_positive(spark, d):
    return table(spark, d, "customer").agg(F.round(F.coalesce(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), F.lit(0.0)), 4).alias("mean_positive"))


def field_coverage(spark, d):
    return export.coverage(tables(spark, d)[1], ["legal_name", "registration_number", "vat_id", "street_address", "city"])


def statistics(spark, d):
    return export.statistics(*tables(spark, d))


def table_counts(spark, d):
    web, legal, queue = tables(spark, d)
    one = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one(web, "web").unionByName(one(legal, "legal")).unionByName(one(queue, "queue"))


def status_latest(spark, d):
    return status.current(table(spark, d, "events"), "user_id", "event_type", "ts").select("user_id", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"))


def quality_grades(spark, d):
    web, legal, _ = tables(spark, d)
    weights = {"legal_name": 20, "legal_form": 10, "street_address": 15, "postal_code": 5, "city": 10, "registration_number": 15, "vat_id": 10, "email": 5, "phone": 5, "ceo_name": 5}
    graded = legal.select("domain", classify.grade(classify.weighted(weights)).alias("grade"))
    return graded.groupBy("grade").agg(F.count("*").alias("n"))


def issue_histogram(spark, d):
    legal = tables(spark, d)[1]
    fields = ["legal_name", "registration_number", "street_address", "postal_code", "city", "email"]
    issues = F.array_compact(F.array(*(F.when(~filled(F.col(f)) | F.col(f).isNull(), F.lit(f"no {f}")) for f in fields)))
    return legal.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(10)


def smart_fill(spark, d):
    web, legal, _ = tables(spark, d)
    other = web.select("domain", F.col("company_name").alias("legal_name"), F.lit("Köln").alias("city"))
    return merge.prefer(legal.select("domain", "legal_name", "city", "vat_id"), other, "domain", ["legal_name", "city"])


def address_lines(spark, d):
    legal = tables(spark, d)[1]
    return legal.select("domain", merge.address_line(F.col("street_address"), F.col("postal_code"), F.col("city"), F.col("country")).alias("address"))


def conversation_fold(spark, d):
    """Ordered accumulation over turns: the union of roles, and the first text."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.array("role").alias("roles"), "text")
    return merge.accumulate_pages(c, "conv_id", "turn", ["roles"], ["text"]).select("conv_id", F.array_join("roles", ";").alias("roles"), F.length("text").cast("long").alias("first_length"))


QUERIES = {
    f.__name__: f
    for f in (
        export_unified, export_unified_complete_de, export_unified_latest, export_client_spec, export_client_completeness, export_legal_strict, export_enhanced, join_reverse, completed_without_legal, blacklist_anti,
        tld_filter_ci, insert_or_ignore, insert_or_replace, upsert_subset, reset_failed, reset_listed, status_update, pending_batch, sample_newest, topk_confidence, latest_run, status_breakdown, status_in_list, progress_rollup,
        avg_positive, field_coverage, statistics, table_counts, status_latest, quality_grades, issue_histogram, smart_fill, address_lines, conversation_fold,
    )
}

_FULL = "coalesce(legal_name, '') <> '' AND ((coalesce(street_address, '') <> '' AND coalesce(city, '') <> '') OR (registered_street <> '' AND registered_city <> '')) AND (coalesce(phone, '') <> '' OR coalesce(email, '') <> '' OR coalesce(ceo_name, '') <> '')"
_CLIENT = """client AS (SELECT l.domain, coalesce(l.legal_name, r.company_name, '') AS company_name, l.legal_form, coalesce(l.street_address, l.registered_street, '') AS street, coalesce(l.postal_code, l.registered_zip, '') AS postal_code,
  coalesce(l.city, l.registered_city, '') AS city, coalesce(l.country, l.registered_country, 'Germany') AS country, l.ceo_name, CASE WHEN directors LIKE '["Erika%' THEN 'Erika Muster; Max Mustermann; info' WHEN directors = 'not json' THEN directors ELSE '' END AS directors,
  coalesce(l.email, split_part(r.emails, ',', 1), '') AS email, coalesce(l.phone, split_part(r.phones, ',', 1), '') AS phone, register_type, register_court, registration_number FROM legal l LEFT JOIN web r ON l.domain = r.domain),
  spec AS (SELECT *, company_name <> '' AND legal_form <> '' AND street <> '' AND postal_code <> '' AND city <> '' AND (ceo_name <> '' OR directors <> '') AND (email <> '' OR phone <> '') AND registration_number <> '' AS complete FROM client)"""

SQL = {
    "export_unified": f"WITH {TABLES}, {_UNIFIED} SELECT * FROM unified",
    "export_unified_complete_de": f"WITH {TABLES}, {_UNIFIED} SELECT * FROM unified WHERE domain ILIKE '%.de' AND length(company_name) > 2 AND (street <> '' OR postal_code <> '' OR city <> '')",
    "export_unified_latest": f"WITH {TABLES}, {_UNIFIED} SELECT domain, run_id, company_size FROM unified WHERE run_id = (SELECT arg_max(run_id, crawled_at) FROM web)",
    "export_client_spec": f"WITH {TABLES}, {_CLIENT} SELECT * FROM spec",
    "export_client_completeness": f"WITH {TABLES}, {_CLIENT} SELECT count(*) AS exported, count(*) FILTER (complete) AS complete, round(avg(CASE WHEN complete THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS rate FROM spec",
    "export_legal_strict": f"WITH {TABLES} SELECT domain, legal_name, street_address, city, extraction_confidence FROM legal WHERE {_FULL}",
    "export_enhanced": f"WITH {TABLES} SELECT r.domain, company_name, legal_name, vat_id AS legal_vat_id, extraction_confidence AS legal_confidence, CASE WHEN directors LIKE '[\"Erika%' THEN 'Erika Muster; Max Mustermann; info' WHEN directors = '[]' THEN '' ELSE directors END AS directors FROM web r LEFT JOIN legal l ON r.domain = l.domain",
    "join_reverse": f"WITH {TABLES} SELECT l.domain, legal_name, emails, phones FROM legal l LEFT JOIN web r ON l.domain = r.domain",
    "completed_without_legal": f"WITH {TABLES} SELECT id, domain FROM queue q WHERE status = 'COMPLETED' AND NOT EXISTS (SELECT 1 FROM legal l WHERE l.domain = q.domain)",
    "blacklist_anti": f"WITH {TABLES}, b(entry) AS (VALUES ('00001'), ('9.com'), ('77')) SELECT domain FROM web WHERE NOT EXISTS (SELECT 1 FROM b WHERE contains(domain, entry))",
    "tld_filter_ci": f"WITH {TABLES} SELECT domain FROM web WHERE domain ILIKE '%.CO.UK'",
    "insert_or_ignore": f"WITH {TABLES}, new AS (SELECT domain, 'web' AS source, 1 AS ord FROM web UNION ALL SELECT domain, 'list', 0 FROM web WHERE domain LIKE '%1.at') SELECT domain, source FROM queue UNION ALL SELECT domain, arg_min(source, ord) FROM new WHERE domain NOT IN (SELECT domain FROM queue) GROUP BY domain",
    "insert_or_replace": f"WITH {TABLES} SELECT domain, status, source FROM queue WHERE domain NOT IN (SELECT domain FROM web WHERE run_id = 'run1') UNION ALL SELECT domain, 'PARKED', NULL FROM web WHERE run_id = 'run1'",
    "upsert_subset": f"WITH {TABLES}, new AS (SELECT domain, company_name FROM web WHERE run_id <> 'run2') SELECT coalesce(l.domain, n.domain) AS domain, CASE WHEN n.domain IS NULL THEN l.legal_name ELSE n.company_name END AS legal_name, CASE WHEN n.domain IS NULL THEN l.vat_id ELSE '9.9' END AS vat_id, city FROM legal l FULL JOIN new n ON l.domain = n.domain",
    "reset_failed": f"WITH {TABLES} SELECT CASE WHEN status LIKE 'FAILED_%' OR status = 'PROCESSING' THEN 'PENDING' ELSE status END AS status, count(*) AS n FROM queue GROUP BY 1",
    "reset_listed": f"WITH {TABLES} SELECT id, CASE WHEN status IN ('PARTIAL_HTTP', 'FAILED_DNS') THEN 'PENDING' ELSE status END AS status FROM queue",
    "status_update": f"WITH {TABLES} SELECT id, CASE WHEN id % 6 = 1 THEN 'COMPLETED' WHEN id % 2 = 1 THEN 'PROCESSING' ELSE status END AS status, CAST(epoch(updated_at) AS BIGINT) + CASE WHEN id % 6 = 1 THEN 3600 ELSE 0 END AS updated_at FROM queue",
    "pending_batch": f"WITH {TABLES} SELECT id, domain FROM queue WHERE status = 'PENDING' ORDER BY id LIMIT 50",
    "sample_newest": f"WITH {TABLES} SELECT domain, CAST(epoch(updated_at) AS BIGINT) AS updated_at FROM queue ORDER BY queue.updated_at DESC, domain LIMIT 20",
    "topk_confidence": f"WITH {TABLES} SELECT domain, legal_name, extraction_confidence FROM legal WHERE coalesce(legal_name, '') <> '' ORDER BY extraction_confidence DESC, domain LIMIT 10",
    "latest_run": f"WITH {TABLES} SELECT arg_max(run_id, crawled_at) AS run_id FROM web",
    "status_breakdown": "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1",
    "status_in_list": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1",
    "progress_rollup": "SELECT count(*) AS total, count(*) FILTER (event_type IN ('click', 'purchase')) AS done, round(count(*) FILTER (event_type IN ('click', 'purchase')) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6), 4) AS per_minute FROM events",
    "avg_positive": "SELECT round(coalesce(avg(c_acctbal) FILTER (c_acctbal > 0), 0), 4) AS mean_positive FROM customer",
    "field_coverage": f"WITH {TABLES}, f AS (UNPIVOT (SELECT coalesce(legal_name, '') AS legal_name, registration_number, vat_id, coalesce(street_address, '') AS street_address, coalesce(city, '') AS city FROM legal) ON legal_name, registration_number, vat_id, street_address, city INTO NAME field VALUE v) SELECT field, count(*) FILTER (v <> '') AS n, count(*) AS total, printf('%.1f%%', count(*) FILTER (v <> '') * 100.0::DOUBLE / count(*)) AS share FROM f GROUP BY field",
    "statistics": f"WITH {TABLES}, w AS (SELECT count(*) AS a, round(coalesce(avg(confidence_score) FILTER (confidence_score > 0), 0), 6) AS b, count(*) FILTER (confidence_score > 70) AS c FROM web), l AS (SELECT count(*) AS a, count(*) FILTER (registration_number <> '') AS b, count(*) FILTER (vat_id <> '') AS c FROM legal), q AS (SELECT count(*) AS a, count(*) FILTER (status = 'PENDING') AS b FROM queue) SELECT 'web_results' AS name, a::DOUBLE AS value FROM w UNION ALL SELECT 'mean_confidence', b FROM w UNION ALL SELECT 'high_confidence', c FROM w UNION ALL SELECT 'legal_entities', a FROM l UNION ALL SELECT 'with_registration', b FROM l UNION ALL SELECT 'with_vat', c FROM l UNION ALL SELECT 'queued', a FROM q UNION ALL SELECT 'pending', b FROM q",
    "table_counts": f"WITH {TABLES} SELECT 'web' AS name, count(*) AS n FROM web UNION ALL SELECT 'legal', count(*) FROM legal UNION ALL SELECT 'queue', count(*) FROM queue",
    "status_latest": "SELECT user_id, arg_max(event_type, ts) AS status, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM events GROUP BY user_id",
    "quality_grades": f"WITH {TABLES}, s AS (SELECT 20 * (coalesce(legal_name, '') <> '')::INT + 10 + 15 * (coalesce(street_address, '') <> '')::INT + 5 * (postal_code <> '')::INT + 10 * (coalesce(city, '') <> '')::INT + 15 * (registration_number <> '')::INT + 10 + 5 * (coalesce(email, '') <> '')::INT + 5 AS v FROM legal) SELECT CASE WHEN v >= 80 THEN 'A' WHEN v >= 60 THEN 'B' WHEN v >= 40 THEN 'C' WHEN v >= 20 THEN 'D' ELSE 'F' END AS grade, count(*) AS n FROM s GROUP BY 1",
    "issue_histogram": f"WITH {TABLES}, f AS (UNPIVOT (SELECT coalesce(legal_name, '') AS legal_name, registration_number, coalesce(street_address, '') AS street_address, postal_code, coalesce(city, '') AS city, coalesce(email, '') AS email FROM legal) ON legal_name, registration_number, street_address, postal_code, city, email INTO NAME field VALUE v) SELECT 'no ' || field AS issue, count(*) AS n FROM f WHERE v = '' GROUP BY field ORDER BY n DESC, issue LIMIT 10",
    "smart_fill": f"WITH {TABLES} SELECT l.domain, coalesce(nullif(legal_name, ''), company_name) AS legal_name, coalesce(nullif(city, ''), 'Köln') AS city, vat_id FROM legal l LEFT JOIN web r ON l.domain = r.domain",
    "address_lines": f"WITH {TABLES} SELECT domain, concat_ws(', ', nullif(street_address, ''), nullif(postal_code, ''), nullif(city, ''), nullif(country, '')) AS address FROM legal",
    "conversation_fold": "SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ';') AS roles, CAST(length(arg_min(text, turn) FILTER (text <> '')) AS BIGINT) AS first_length FROM conversations GROUP BY conv_id",
}
