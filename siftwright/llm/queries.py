"""The corpus queries that the entry module registers, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql_near_dup, sql_pages, sql_texts, sql_vectors
from .common import doc_hash_mod, read_table


EXAMPLE_KEY = "example-key-for-synthetic-tables"  # of these queries; anyone who reads it can undo their pseudonyms


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"), order=2)
    held = F.coalesce(doc_hash_mod("doc_id", toxicity.FOLDS) == 0, F.lit(False))
    return toxicity.score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    records = warc.read(warc.archive(read_table(spark, sf_dir, "pages", "page_id", "url", "html")))
    return warc.revisits(records, 0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dup

    return near_dup.cluster(read_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hamming

    rows = hamming.sign_codes(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")).select(F.col("vec_id").alias("id"), "code")
    return hamming.search(rows, rows.where("id % 100 = 0"), 10).withColumnRenamed("id", "vec_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = doc_hash_mod("doc_id", 3) == 1
    network = language.train(docs.where(~held))
    return language.identify(docs.select("doc_id", "text"), network).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import passages

    done = passages.deduplicate(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    spans = F.concat_ws(";", F.transform("spans", lambda x: F.concat_ws("-", x["s"], x["e"])))
    return done.select("doc_id", "class_id", "n_words", "n_repeated", F.size("spans").cast("long").alias("n_spans"), spans.alias("spans"), "n_links", F.concat_ws(";", F.col("leaders").cast("array<string>")).alias("leader_ids"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.matches(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), F.concat_ws(";", F.col("item_ids").cast("array<string>")).alias("item_ids"), "containment")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    mixed = mixing.mix(read_table(spark, sf_dir, "documents", "doc_id", "source"))
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "mix_rank", "mix_slot", "mix_within")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixes

    done = suffixes.remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    done = pii.pseudonymise(read_table(spark, sf_dir, "documents", "doc_id", "text"), spark.conf.get(pii.KEY_CONF, EXAMPLE_KEY))
    n = {k: F.coalesce(F.try_element_at("pii", F.lit(k)), F.lit(0)).cast("long") for k in pii.KINDS}
    return done.select("doc_id", "text", *(v.alias(f"n_{k}") for k, v in n.items()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_near_dup": op2_near_dup,
    "op3_hamming_topk": op3_hamming_topk,
    "op4_language": op4_language,
    "op5_passages": op5_passages,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_repeats": op9_repeats,
    "op10_pii": op10_pii,
}
SQL: dict[str, str] = {
    "op1_warc": sql_pages.OP1,
    "op2_near_dup": sql_near_dup.OP2,
    "op3_hamming_topk": sql_vectors.OP3,
    "op6_decontaminate": sql_texts.OP6,
    "op8_mixing": sql_texts.OP8,
    "op9_repeats": sql_texts.OP9,
}
