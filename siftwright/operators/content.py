"""Parts of parsed pages: the legal section, the company's own notice, ranked links, microdata, metadata, the best legal page.

All work on the rows of dom.parse, as columns over its nodes; only the candidates of an
operator have their text cut from the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import legal
from ..functions import lexicon as L
from ..functions import validate as V
from ..functions.text import has_any, hits, host, strip
from ..functions.web import link_kind, meta, resolve
from .dom import attr, text_of
from .structured import ORGANISATIONS, items

# fixed values: names of elements that hold a notice, by preference, and words in one
SECTION_NAMES = ["impressum", "imprint", "legal", "rechtlich", "main[-_]?content", "content[-_]?main", "page[-_]?content", "content[-_]?area", "article", "main", "primary"]
SECTION_WORDS = ["impressum", "imprint", "legal", "rechtlich", "angaben", "gemäß", "tmg", "telemedien", "anbieterkennzeichnung", "pflichtangaben", "company information", "legal notice", "mentions légales", "aviso legal", "note legali"]
PAGE_WORDS = ["impressum", "geschäftsführer", "handelsregister", "amtsgericht", "legal notice", "company number", "registered office", "mentions légales", "siège social", "rcs", "partita iva", "codice fiscale", "registro imprese"]
SUBSTANCE_WORDS = ["impressum", "geschäftsführer", "handelsregister", "gmbh", "ag", "legal notice", "company", "registered", "director", "limited", "mentions légales", "société", "siège", "directeur", "partita iva", "società", "amministratore"]
LEGAL_TYPES = ["Organization", "LocalBusiness", "Corporation", "LegalService"]


def legal_section(nodes: Column, flow: Column) -> Column:
    """The text of a page's legal section.

    The first that there is: an element of over 100 characters with one of the names (the
    preferred name first, ids before classes), main or article of over 100, the div or
    section of over 200 with most words and at least two, the body.
    """
    none = F.lit(None).cast("int")

    def rated(n):
        named = [(F.when(F.lower(F.coalesce(attr(n, a), F.lit(""))).rlike(name), F.lit(-(2 * i + j)))) for i, name in enumerate(SECTION_NAMES) for j, a in enumerate(("id", "class"))]
        size = F.length(text_of(n, flow))
        words = F.when(n["tag"].isin("div", "section"), hits(F.lower(text_of(n, flow)), SECTION_WORDS))
        name = F.when((n["tag"] != "body") & (size > 100), F.coalesce(*named))
        tier = F.when(name.isNotNull(), 3).when(n["tag"].isin("main", "article") & (size > 100), 2).when((words >= 2) & (size > 200), 1).when(n["tag"] == "body", 0)
        score = F.coalesce(name, F.when(n["tag"].isin("main", "article"), (n["tag"] == "main").cast("int")), words, none)
        return F.struct(tier.alias("tier"), score.alias("score"), (-n["ord"]).alias("o"), n["start"].alias("start"), n["end"].alias("end"))

    able = F.filter(nodes, lambda n: n["tag"].isin("main", "article", "div", "section", "body") | F.lower(F.concat_ws(" ", attr(n, "id"), attr(n, "class"))).rlike("|".join(SECTION_NAMES)))
    best = F.array_max(F.filter(F.transform(able, rated), lambda x: x["tier"].isNotNull()))
    return F.when(best.isNotNull(), text_of(best, flow))


def own_notice(nodes: Column, flow: Column) -> Column:
    """The company's own part of the legal section: parts about agencies, hosts and picture sources go."""
    return strip(legal.primary_block(legal_section(nodes, flow)))


def ranked_links(base: Column, nodes: Column, most: int = 10) -> Column:
    """Absolute links that may lead to a notice: legal ones, footer links with a notice's word, contact pages; each once, in order."""

    def rated(n):
        href, kind = attr(n, "href"), link_kind(attr(n, "href"), F.coalesce(n["text"], F.lit("")))
        rank = F.when(kind == "legal", 0).when(n["in_footer"] & has_any(F.lower(href), legal.NOTICE_KEYWORDS), 1).when(kind == "contact", 2)
        return F.struct(rank.alias("rank"), n["ord"].alias("ord"), resolve(base, href).alias("url"))

    links = F.transform(F.filter(nodes, lambda n: (n["tag"] == "a") & attr(n, "href").isNotNull()), rated)
    links = F.filter(links, lambda x: x["rank"].isNotNull() & x["url"].isNotNull())
    return F.slice(F.array_distinct(F.transform(F.array_sort(links), lambda x: x["url"])), 1, most)


def footer_links(nodes: Column) -> Column:
    """The targets of links in a footer, each once."""
    return F.array_distinct(F.transform(F.filter(nodes, lambda n: (n["tag"] == "a") & n["in_footer"] & attr(n, "href").isNotNull()), lambda n: attr(n, "href")))


def microdata(nodes: Column, flow: Column) -> Column:
    """struct(company_name, description, phone, email, address) of the first organisation in microdata; null without one. Of a property its first value counts; those of items within are not the organisation's."""
    scopes = F.filter(nodes, lambda n: attr(n, "itemscope").isNotNull())
    top = F.try_element_at(F.filter(scopes, lambda n: attr(n, "itemtype").rlike("Organization|LocalBusiness")), F.lit(1))
    value = lambda n: F.coalesce(attr(n, "content"), F.when(n["tag"].isin("a", "link"), F.regexp_replace(attr(n, "href"), "^(?:mailto|tel):", "")), text_of(n, flow))

    def direct(scope, name):
        within = F.filter(nodes, lambda n: (n["ord"] > scope["ord"]) & (n["ord"] <= scope["last"]) & (attr(n, "itemprop") == name))
        return F.try_element_at(F.filter(within, lambda n: ~F.exists(scopes, lambda x: (x["ord"] > scope["ord"]) & (x["ord"] < n["ord"]) & (n["ord"] <= x["last"]))), F.lit(1))

    get = lambda name: value(direct(top, name))
    place = direct(top, "address")
    parts = [F.nullif(value(direct(place, p)), F.lit("")) for p in ("streetAddress", "addressLocality", "postalCode")]
    address = F.nullif(F.concat_ws(", ", *parts), F.lit(""))
    return F.when(top.isNotNull(), F.struct(get("name").alias("company_name"), get("description").alias("description"), get("telephone").alias("phone"), get("email").alias("email"), address.alias("address")))


def metadata(nodes: Column, title: Column) -> Column:
    """struct(title, author, date, description, sitename) of a page's meta elements; '' where there is none."""
    named = lambda n: F.lower(F.coalesce(attr(n, "property"), attr(n, "name")))
    get = lambda *names: [F.nullif(attr(F.try_element_at(F.filter(nodes, lambda n: (n["tag"] == "meta") & (named(n) == name)), F.lit(1)), "content"), F.lit("")) for name in names]
    one = lambda *c: F.coalesce(*c, F.lit(""))
    return F.struct(
        one(*get("og:title"), title).alias("title"), one(*get("author", "article:author")).alias("author"), one(*get("article:published_time", "date")).alias("date"),
        one(*get("description", "og:description")).alias("description"), one(*get("og:site_name", "application-name")).alias("sitename"),
    )


def substantial(text: Column) -> Column:
    """Whether a text is long enough (100 words) and has a word of notices."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.coalesce((words >= 100) & (hits(F.lower(text), SUBSTANCE_WORDS) >= 1), F.lit(False))


def best_legal_page(candidates: DataFrame) -> DataFrame:
    """(domain, url) of candidates (domain, ord, url, text): the first page with two words of notices, else the first."""
    legal_page = hits(F.lower(F.coalesce("text", F.lit(""))), PAGE_WORDS) >= 2
    return candidates.groupBy("domain").agg(F.min_by("url", F.struct(~legal_page, "ord")).alias("url"))


def legal_entity(html: Column, strict: bool = True) -> Column:
    """The legal fields of a page's JSON-LD organisations.

    strict: types as given exactly, the first valid name, other fields of the last item that
    has them, the name of the site without any. Otherwise also companies, every field checked,
    and fax numbers; the last item that has a valid value counts.
    """
    types = LEGAL_TYPES if strict else ORGANISATIONS
    own = F.filter(items(html), lambda x: F.get_json_object(x, "$['@type']").isin(types))

    def last(*paths, check=None, first=False):
        got = F.transform(own, lambda x: F.coalesce(*(F.nullif(F.get_json_object(x, p), F.lit("")) for p in paths)))
        got = F.filter(F.transform(got, check) if check else got, lambda x: x.isNotNull())
        return F.try_element_at(got, F.lit(1 if first else -1))

    checked = lambda f: None if strict else f
    name = last("$.legalName", "$.name", check=V.field_company_name, first=strict)
    number = lambda x: V.phone(x, "DE")
    return F.struct(
        (F.coalesce(name, meta(html, "og:site_name")) if strict else name).alias("legal_name"), last("$.vatID", "$.taxID", check=checked(V.vat_id)).alias("vat_id"),
        last("$.address.streetAddress").alias("street_address"), last("$.address.postalCode").alias("postal_code"), last("$.address.addressLocality").alias("city"), last("$.address.addressCountry").alias("country"),
        last("$.telephone", check=checked(number)).alias("phone"), last("$.email", check=checked(V.field_email)).alias("email"), *([] if strict else [last("$.faxNumber", check=number).alias("fax")]),
    )


def engine_results(parsed: DataFrame, own_hosts: tuple[str, ...] = ("bing.com", "microsoft.com"), box: str = "b_algo") -> DataFrame:
    """(domain) of an engine's result pages: links in the headings of result boxes, without the engine's own hosts."""
    classes = lambda n: F.split(F.coalesce(attr(n, "class"), F.lit("")), " ")
    inside = lambda n, outer: F.exists(outer, lambda x: (x["ord"] < n["ord"]) & (n["ord"] <= x["last"]))
    nodes = F.col("nodes")
    boxes = F.filter(nodes, lambda n: F.array_contains(classes(n), box))
    heads = F.filter(nodes, lambda n: (n["tag"] == "h2") & inside(n, boxes))
    found = F.filter(nodes, lambda n: (n["tag"] == "a") & inside(n, heads))
    domain = host(F.col("n.attrs")["href"])
    return parsed.select(F.explode(found).alias("n")).select(domain.alias("domain")).where(F.col("domain").isNotNull() & ~F.col("domain").rlike("|".join(h.replace(".", r"\.") for h in own_hosts)))


def targeted(results: DataFrame, blacklist: DataFrame, most_queries: int = 5, patience: int = 3) -> DataFrame:
    """(domain, ord) of targeted searches (query, ord, domain; a null domain is an empty answer).

    Only the first queries count, and those after `patience` empty ones in a row do not. A
    domain is out if it, or its last two labels, is in the blacklist (entry). The answers of a
    search are few by most_queries, so their order needs no partition.
    """
    per = results.where(F.col("ord") < most_queries).groupBy("ord").agg(F.count("domain").alias("n"))
    row = Window.orderBy("ord").rowsBetween(-patience, -1)  # at most most_queries rows
    empty = (F.count("*").over(row) == patience) & (F.sum("n").over(row) == 0)
    stopped = per.withColumn("stop", empty.cast("int")).withColumn("stopped", F.max("stop").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    kept = results.where("domain is not null").join(F.broadcast(stopped.where("stopped = 0").select("ord")), "ord", "left_semi")
    d = kept.select(F.lower("domain").alias("domain"), "ord").withColumn("root", F.substring_index("domain", ".", -2))
    entries = blacklist.select(F.lower("entry").alias("entry")).where("entry is not null").distinct()
    d = d.join(entries, F.col("domain") == F.col("entry"), "left_anti").join(entries, F.col("root") == F.col("entry"), "left_anti")
    return d.groupBy("domain").agg(F.min("ord").alias("ord"))
