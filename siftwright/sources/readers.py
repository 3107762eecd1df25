"""Sources of domains, and the mix of them: readers that end in (domain, source) rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled, host
from ..functions.validate import skip_domain


def tld_of(arg: str | None) -> str | None:
    """'.de' of 'de'; None (no filter) of blank, all, any and *."""
    if not arg or arg.strip().lower() in ("", "all", "any", "*"):
        return None
    return arg if arg.startswith(".") else f".{arg}"


def in_tld(domain: Column, arg: str | None, any_case: bool = False) -> Column:
    tld = tld_of(arg)
    if tld is None:
        return F.lit(True)
    return F.lower(domain).endswith(tld.lower()) if any_case else domain.endswith(tld)


def domains(names: DataFrame, source: str, tld: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct usable domains of a column `domain`, labelled with their source; the limit is exact and takes the first by rank, where the list has one, then by name."""
    usable = F.col("domain").isNotNull() & ~skip_domain(F.col("domain")) & in_tld(F.col("domain"), tld)
    rank = F.col("rank") if "rank" in names.columns else F.lit(None).cast("long")
    out = names.select(F.lower(F.trim("domain")).alias("domain"), rank.alias("rank")).where(usable).groupBy("domain").agg(F.min("rank").alias("rank"))
    if limit is not None:
        out = out.orderBy(F.asc_nulls_last("rank"), "domain").limit(limit)
    return out.select("domain", F.lit(source).alias("source"))


def top_list(spark: SparkSession, path: str) -> DataFrame:
    """A headerless (rank, domain) CSV."""
    return spark.read.schema("rank long, domain string").csv(path)


def headed_list(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header: its Domain column, else the last one."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col(f"`{'Domain' if 'Domain' in df.columns else df.columns[-1]}`").alias("domain"))


def crawl_index(lines: DataFrame) -> DataFrame:
    """JSON lines (value) with a url each; broken lines are skipped."""
    return lines.select(host(F.get_json_object("value", "$.url")).alias("domain")).where("domain is not null")


def certificates(documents: DataFrame) -> DataFrame:
    """JSON arrays (value) of certificates: the common name, else all names; wildcards lose their star."""
    one = F.from_json("value", "array<struct<common_name:string,name_value:string>>")
    rows = documents.select(F.inline(one)).select(F.when(filled(F.col("common_name")), F.col("common_name")).otherwise(F.col("name_value")).alias("n"))
    return rows.select(F.explode(F.split("n", r"\s+")).alias("d")).select(F.regexp_replace("d", r"^[*.]+", "").alias("domain")).where("domain <> ''")


def archive_index(documents: DataFrame) -> DataFrame:
    """JSON arrays of arrays (value) with a header row; the first column is a URL, with or without a scheme."""
    rows = documents.select(F.explode(F.slice(F.from_json("value", "array<array<string>>"), 2, 1_000_000)).alias("r"))
    url = F.when(F.col("r")[0].rlike("^[a-z]+://"), F.col("r")[0]).otherwise(F.concat(F.lit("http://"), F.col("r")[0]))
    return rows.select(host(url).alias("domain")).where("domain is not null")


def search_results(parsed: DataFrame, link_class: str = "result__a", parameter: str = "uddg") -> DataFrame:
    """Result pages (parsed by operators.dom): links of a class, unwrapped from the redirect parameter."""
    links = parsed.select(F.explode("nodes").alias("n")).where((F.col("n.tag") == "a") & F.array_contains(F.split(F.coalesce(F.col("n.attrs")["class"], F.lit("")), " "), link_class)).select(F.col("n.attrs")["href"].alias("href"))
    inner = F.url_decode(F.nullif(F.regexp_extract("href", rf"[?&]{re.escape(parameter)}=([^&]+)", 1), F.lit("")))
    return links.select(host(F.coalesce(inner, F.col("href"))).alias("domain")).where("domain is not null")


#: by company size: source and its share of the limit (numerator, denominator, most)
PLANS = {
    "smb": [("crtsh", 1, 1, None), ("common_crawl", 1, 1, 100), ("wayback", 1, 2, None), ("targeted", 1, 2, None)],
    "enterprise": [("tranco", 1, 1, None), ("majestic", 1, 1, None), ("umbrella", 1, 1, None)],
    "all": [("targeted", 1, 3, None), ("tranco", 1, 3, None), ("majestic", 1, 3, None), ("common_crawl", 1, 2, None), ("search", 1, 1, 50)],
}


def discover(available: dict[str, DataFrame], tld: str | None = None, limit: int = 100, company_size: str = "all") -> DataFrame:
    """(domain, source, ord) of the plan's sources, each up to its share; ord is the source's place in the plan."""
    out = None
    for i, (name, n, d, most) in enumerate(PLANS[company_size]):
        if name not in available:
            continue
        share = limit * n // d
        rows = domains(available[name], name, tld, share if most is None else min(share, most)).withColumn("ord", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"none of the sources of {company_size} is given")
    return out
