"""Operators beyond the registered queries: streams, long blacklists, files, odd input."""

from pyspark.sql import functions as F

from siftwright.functions import validate as V
from siftwright.operators import dom, store
from siftwright.plans import export
from siftwright.sources import readers
from siftwright.streaming import status


def test_status_stream(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), F.concat(F.lit("s"), "id").alias("status"), F.timestamp_seconds(F.col("id") * 60).alias("at"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = status.events(spark, str(tmp_path / "in"), rows.schema.simpleString()[7:-1].replace(":", " "), 2)
    query = status.process(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    query.awaitTermination()
    assert sum(seen) == 100 and len(seen) > 1
    last = {r.k: r.status for r in status.current(rows, "k", "status", "at").collect()}
    assert last[0] == "s98" and last[6] == "s97"


def test_hourly_progress(spark, tmp_path):
    rows = spark.range(180).select(F.timestamp_seconds(F.col("id") * 60).alias("at"), F.lit("x").alias("status"))
    out = {r.hour.hour: r.n for r in status.hourly(rows, "at", "status").collect()}
    assert sorted(out.values()) == [60, 60, 60]


def test_long_blacklist_equals_short(spark):
    domains = spark.createDataFrame([("a.t.co",), ("x.com",), ("mail.de",), ("",), (None,)], "domain string")
    entries = spark.createDataFrame([("t.co",), ("x.com",), ("",), (None,)], "entry string")
    short = store.without_blacklisted(domains.where("domain is not null"), ["t.co", "x.com"])
    listed = store.without_blacklisted(domains.where("domain is not null"), entries)
    joined = store.without_blacklisted(domains.where("domain is not null"), entries, most=1)
    assert sorted(r[0] for r in short.collect()) == sorted(r[0] for r in listed.collect()) == sorted(r[0] for r in joined.collect()) == ["", "mail.de"]


def test_store_on_empty_tables(spark):
    q = spark.createDataFrame([], "domain string, source string, status string")
    new = spark.createDataFrame([("a.de", "x", 1), ("a.de", "y", 0), (None, "z", 0)], "domain string, source string, ord int")
    assert [tuple(r) for r in store.insert_or_ignore(q, new, "domain", ["ord"]).collect()] == [("a.de", "y", None)]
    assert store.reset_failed(q).count() == 0 and store.pending(q).count() == 0


def test_csv_source_and_sink(spark, tmp_path):
    (tmp_path / "top.csv").write_text("1,Acme.de\n2,mail.acme.de\n3,beta.de\n4,gamma.fr\n")
    (tmp_path / "head.csv").write_text("rank,Domain,x\n1,Delta.de,y\n")
    top = readers.domains(readers.top_list(spark, str(tmp_path / "top.csv")), "tranco", "de")
    assert sorted(r.domain for r in top.collect()) == ["acme.de", "beta.de"]
    assert readers.headed_list(spark, str(tmp_path / "head.csv")).first().domain == "Delta.de"
    export.save_csv(top, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    export.save_json(top, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_broken_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<p>a<b>c<div>d</p></i><script>x='</p>'</script><"), (4, "u", "plain")], "page_id long, url string, html string")
    found = {r.page_id: r for r in dom.parse(pages).collect()}
    assert found[1].text == found[2].text == "" and "d" in found[3].text and "x=" not in found[3].text and found[4].text == "plain"


def test_validators_on_null(spark):
    row = spark.range(1).select(F.lit(None).cast("string").alias("c"))
    for f in (V.postal_code, V.city, V.street, V.ceo_name):
        assert row.select(f(F.col("c"))).first()[0] == ""
    for f in (V.vat_id, V.registration_number, V.legal_form, V.field_company_name, V.web_company_name, V.web_email, V.field_email, V.person_name, V.phone):
        assert row.select(f(F.col("c"))).first()[0] is None
    assert row.select(V.skip_domain(F.col("c"))).first()[0] is True


def test_limit_takes_the_best_ranked(spark):
    from siftwright.sources import readers

    names = spark.createDataFrame([(3, "alpha.de"), (1, "zeta.de"), (2, "mid.de"), (9, "zeta.de"), (4, None)], "rank long, domain string")
    assert {r.domain for r in readers.domains(names, "list", limit=2).collect()} == {"zeta.de", "mid.de"}
    assert {r.domain for r in readers.domains(names.drop("rank"), "list", limit=2).collect()} == {"alpha.de", "mid.de"}
