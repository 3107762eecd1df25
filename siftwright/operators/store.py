"""The work queue and result tables: insert-or-ignore, replace, upsert and status changes as rewrites of DataFrames.

Parquet has no MERGE, so each operator returns the table's new state. All joins are
equi-joins on the key; a table that is clustered by it needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_of


def first_per_key(rows: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first row of each key. Aggregates before the shuffle: no sort, no window."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order])).alias("_row")).select(key, "_row.*").select(*rows.columns)


def insert_or_ignore(table: DataFrame, new: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """table and, of new keys, the first row in order; columns that new lacks are null."""
    fresh = first_per_key(new.where(F.col(key).isNotNull()), key, order).join(table.select(key), key, "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True).select(*table.columns)


def insert_or_replace(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new take the place of table's; their columns that new lacks become null."""
    return table.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).select(*table.columns)


def upsert(table: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sets the listed columns of existing keys, leaves the others; inserts new keys."""
    n = new.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_new"))
    both = table.join(n, table[key] == n["_key"], "full_outer")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) if c in columns else F.coalesce(F.col(key), F.col("_key")) if c == key else F.col(c)
    return both.select(*(pick(c).alias(c) for c in table.columns))


def set_status(queue: DataFrame, changes: DataFrame, key: str = "domain") -> DataFrame:
    """queue with the latest status of changes (key, status, updated_at)."""
    last = changes.groupBy(key).agg(F.max_by("status", "updated_at").alias("_status"), F.max("updated_at").alias("_at"))
    return queue.join(last, key, "left").withColumns({"status": F.coalesce("_status", "status"), "updated_at": F.coalesce("_at", "updated_at")}).select(*queue.columns)


def reset_failed(queue: DataFrame) -> DataFrame:
    """Failed and interrupted entries are pending again."""
    return queue.withColumn("status", F.when(F.col("status").like("FAILED_%") | (F.col("status") == "PROCESSING"), "PENDING").otherwise(F.col("status")))


def pending(queue: DataFrame, n: int | None = None) -> DataFrame:
    out = queue.where(F.col("status") == "PENDING")
    return out.orderBy("id").limit(n) if n else out


def without_blacklisted(domains: DataFrame, blacklist: list[str] | DataFrame, column: str = "domain", most: int = 5000) -> DataFrame:
    """domains that contain no entry of the blacklist. A short list is one pattern and needs no join; a longer table is compared by a broadcast, once its size is checked."""
    if isinstance(blacklist, DataFrame):
        entries = [r[0] for r in blacklist.where("entry is not null and entry <> ''").select("entry").distinct().limit(most + 1).collect()]
        if len(entries) > most:
            # too many for one pattern: cut each domain into all its substrings of the entries' lengths and join on equality
            lengths = F.array(*(F.lit(n) for n in sorted(r[0] for r in blacklist.select(F.length("entry")).distinct().collect() if r[0])))
            parts = F.flatten(F.transform(lengths, lambda n: F.transform(F.when(F.length(column) >= n, F.sequence(F.lit(1), F.length(column) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(F.col(column), i, n))))
            hit = domains.select(column, F.explode(parts).alias("entry")).join(blacklist.select("entry").distinct(), "entry", "left_semi").select(column).distinct()
            return domains.join(hit, column, "left_anti")
        blacklist = entries
    return domains.where(~F.col(column).rlike(any_of(blacklist))) if blacklist else domains


def update_columns(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with the columns' values of changes (one row a key) where a key has any; others stay as they are."""
    mine = changes.select(key, F.lit(True).alias("changed_"), *(F.col(c).alias(f"{c}_new_") for c in columns))
    out = table.join(mine, key, "left")
    return out.select(*(F.when(F.col("changed_"), F.col(f"{c}_new_")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def wiped(table: DataFrame) -> DataFrame:
    """An empty table of the same columns, to overwrite a store with."""
    return table.where(F.lit(False))


def best_first(table: DataFrame, score: str = "confidence_score", newest: str | None = None, key: str = "domain") -> DataFrame:
    """Rows by score, then age, then key, so that equal scores have one order."""
    return table.orderBy(F.desc_nulls_last(score), *([F.desc_nulls_last(newest)] if newest else []), key)


#: the columns of the stored tables
SCHEMAS = {
    "queue": "id long, domain string, source string, status string, created_at timestamp, updated_at timestamp, robots_status string, robots_reason string",
    "web": "domain string, company_name string, description string, emails string, phones string, industry string, confidence_score double, crawled_at timestamp, run_id string",
    "legal": "domain string, legal_name string, legal_form string, register_type string, register_court string, registration_number string, vat_id string, ceo_name string, directors string, street_address string, postal_code string, city string, country string, phone string, email string, fax string, extraction_confidence double, extraction_date timestamp",
}


def created(spark: SparkSession, name: str) -> DataFrame:
    """An empty stored table."""
    return spark.createDataFrame([], SCHEMAS[name])


def migrated(rows: DataFrame, schema: str) -> DataFrame:
    """rows with all columns of a newer schema: missing ones are null, others stay as they are."""
    empty = rows.sparkSession.createDataFrame([], schema)
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in empty.schema if f.name not in rows.columns})
