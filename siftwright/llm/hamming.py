"""Exact top-k search among binary codes: incremental multi-index hashing.

A 64-bit code is cut into m segments, about log2(number of codes) bits each. Round
r looks up, for every segment of an unfinished query, the values that differ from
it in exactly r bits; candidates are verified by their full Hamming distance. After
the round every code nearer than m (r + 1) has been seen, so a query is finished
when its kth distance is below that. A candidate counts where it is first found
(the lowest round, then segment), so nothing is looked at twice, and only within the
query's kth distance so far, so that candidates do not grow with both tables.

Equal codes are one entry with the k smallest ids, so copies cost nothing. Where a
round would probe more values than there are codes, the remaining queries are
compared with all codes in blocks instead, which is exact too.

Nulls and edges: rows with a null id or code are neither found nor queries; of
queries that share an id all are answered. Ties go to the smaller id. A query finds
itself if it is among the rows. Fewer than k rows give fewer results.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 64
BLOCK = 2048  # queries that are compared with all codes at once


def sign_codes(vectors: DataFrame, vector: str = "embedding", output: str = "code") -> DataFrame:
    """vectors with a 64-bit code: bit i is set where the sum of the components at i, i + 64, ... is over 0. A null or empty vector has a null code."""
    v = F.col(vector)
    n = F.size(v)
    folded = F.transform(F.sequence(F.lit(0), F.least(F.lit(BITS), n) - 1), lambda i: F.aggregate(F.sequence(i, n - 1, F.lit(BITS)), F.lit(0.0), lambda a, j: a + F.coalesce(F.element_at(v, j + 1).cast("double"), F.lit(0.0))))
    bits = F.transform(folded, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return vectors.withColumn(output, F.when(n > 0, F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))))


def segments(n_codes: int) -> int:
    """The number of segments whose length is nearest to log2 of the number of codes."""
    return min((2, 4, 8, 16), key=lambda m: abs(BITS / m - math.log2(max(n_codes, 2))))


def _segment(code, i, bits: int):
    """Segment number i (a column) of a code."""
    return F.call_function("shiftrightunsigned", code, (i * bits).cast("int")).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows (id, code) of each query (id, code)."""
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code")).where("id is not null and code is not null")
    queries = queries.select(F.col("id").cast("long").alias("query_id"), F.col("code").cast("long").alias("query")).where("query_id is not null and query is not null")
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    codes = written(rows.withColumn("_n", first).where(F.col("_n") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "mih-codes")
    n_codes, n_ids = codes.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    m = segments(n_codes)
    bits = BITS // m
    numbers = F.explode(F.array(*(F.lit(i) for i in range(m))))
    index = codes.select("code", numbers.alias("segment")).withColumn("value", _segment(F.col("code"), F.col("segment"), bits))
    active = written(queries.select("query", F.lit(BITS).alias("bound")).distinct(), "mih-queries")
    best = written(spark.createDataFrame([], "query long, distance int, id long"), "mih-best")
    enough = min(k, n_ids)
    order = Window.partitionBy("query").orderBy("distance", "id")
    for r in range(bits + 1):
        if active.isEmpty():
            break
        if math.comb(bits, r) * m > max(n_codes, 1024):
            found = _compare(codes, active, k)
        else:
            masks = [sum(1 << b for b in c) for c in itertools.combinations(range(bits), r)]
            probes = active.select("query", "bound", numbers.alias("segment")).withColumn("mask", F.explode(F.from_json(F.lit(str(masks)), "array<long>")))
            probes = probes.select("query", "bound", "segment", _segment(F.col("query"), F.col("segment"), bits).bitwiseXOR(F.col("mask")).alias("value"))
            near = [F.bit_count(_segment(F.col("query").bitwiseXOR(F.col("code")), F.lit(i), bits)) for i in range(m)]
            least = F.least(*near)
            at = F.coalesce(*(F.when(x == least, F.lit(i)) for i, x in enumerate(near)))
            # the planner does not see how far the masks multiply rows, and would broadcast them
            distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
            found = probes.hint("merge").join(index, ["segment", "value"]).where((least == r) & (F.col("segment") == at) & (distance <= F.col("bound"))).select("query", "code", distance.alias("distance"))
        found = found.hint("merge").join(codes, "code").select("query", "distance", F.explode("ids").alias("id"))
        if math.comb(bits, r) * m > max(n_codes, 1024):
            best = best.join(active.select("query"), "query", "left_anti")  # compared with everything anew
        best = written(best.unionByName(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "mih-best")
        if math.comb(bits, r) * m > max(n_codes, 1024):
            break
        covered = m * (r + 1) - 1
        state = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        active = active.select("query").join(state, "query", "left").where(~F.coalesce((F.col("n") >= enough) & (F.col("last") <= covered), F.lit(False)))
        active = written(active.select("query", F.when(F.col("n") >= k, F.col("last")).otherwise(BITS).alias("bound")), "mih-queries")
    return queries.join(best.withColumn("rank", F.row_number().over(order)), "query").select("query_id", "rank", "id", "distance")


def _compare(codes: DataFrame, active: DataFrame, k: int) -> DataFrame:
    """(query, code, distance) of the codes that may be among the k nearest of each query, by comparing all in blocks."""
    spark = codes.sparkSession
    out = None
    rows = active.toLocalIterator()  # streams; one block at a time is held
    while block := [r[0] for r in itertools.islice(rows, BLOCK)]:
        shared = spark.sparkContext.broadcast(np.array(block, np.int64))

        def run(batches, shared=shared):
            for b in batches:
                code = b.column("code").to_numpy()
                for i in range(0, len(code), 4096):
                    part = code[i : i + 4096]
                    d = np.bitwise_count(shared.value[:, None] ^ part[None, :])
                    last = np.partition(d, min(k, len(part)) - 1, 1)[:, min(k, len(part)) - 1]
                    q, c = np.nonzero(d <= last[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(shared.value[q]), pa.array(part[c]), pa.array(d[q, c].astype(np.int32))], ["query", "code", "distance"])

        found = codes.select("code").mapInArrow(run, "query long, code long, distance int")
        out = found if out is None else out.unionByName(found)
    return out
