"""Mixing sources to target weights: a Pfair schedule of quanta of documents.

A source's documents, in a seeded hash order, form quanta of block // 3 rows; one
quantum runs in each slot. Time is cut into frames of FRAME slots. By the start t of
a frame, source i has had A_i(t) quanta: t is shared out along a Huffman tree of the
exact integer weights, each node giving its left part of n slots round(n wl / w). The
A_i(t) add up to t, never fall, and stay within 2 quanta of w_i t: an error halves at
least by a third a level, and each level adds half a quantum. So any frame is found
without the ones before it, and there is no period after which errors repeat.

Within a frame, quantum k (from 0) of the c of a source is released at slot
floor(k FRAME / c) and due at ceil((k + 1) FRAME / c); at each slot the released
quantum with the earliest deadline runs. As the c of a frame add up to FRAME, all
deadlines are met, within less than a quantum of a straight line from frame to frame.
Together a source stays within 3 quanta of its target weight, less than one block, at
every slot, however long the schedule. A source that ends leaves its slots empty; all
others keep their rates, and nothing is dropped or repeated.

Only DataFrame functions touch the rows, and the frames too are planned by them, side
by side. A source may hold any share of the rows: they are numbered within hash
buckets of a source, and a bucket brings the slots of its rows with it.

Nulls and edges: a null source is the source ''; a null doc_id is ordered as ''.
Rows that repeat a doc_id are placed one by one. An empty table gives an empty one.
Columns named as one of the three new ones are replaced, others are kept.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

BLOCK = 32  # rows by which a source may stray from its weight
FRAME = 512  # slots that are planned together
BUCKET_ROWS = 4096
MOST_WEIGHT = 1 << 31  # sum of the integer weights, so that products fit 64 bits


def exact(weights: Mapping[str, float]) -> dict[str, int]:
    """Integers in the proportions of the weights as they are written in decimals; rounded only where their sum would pass MOST_WEIGHT."""
    parts = {s: Fraction(str(w)) for s, w in weights.items()}
    if any(w <= 0 for w in parts.values()):
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in parts.values()))
    whole = {s: int(w * scale) for s, w in parts.items()}
    shared = math.gcd(*whole.values())
    whole = {s: w // shared for s, w in whole.items()}
    total = sum(whole.values())
    return whole if total <= MOST_WEIGHT else {s: max(1, w * (MOST_WEIGHT - len(whole)) // total) for s, w in whole.items()}


def paths(weights: Mapping[str, int]) -> list[list[dict]]:
    """For each source, in order of its name: the weights of the left part and of the node, and its own side, from the root of a Huffman tree down."""
    names = sorted(weights)
    heap = [(weights[s], i, [i]) for i, s in enumerate(names)]
    heapq.heapify(heap)
    out: list[list[dict]] = [[] for _ in names]
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            out[i].append({"wl": a[0], "wn": a[0] + b[0], "left": len(a[2]) > 0 and i in a[2]})
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return [p[::-1] for p in out]


def _div(a, b):
    return F.call_function("div", a, b)


def _shared(n, step):
    """The part of n slots that goes down one step of a path."""
    wl, wn = step["wl"], step["wn"]
    left = _div(n, wn) * wl + _div(2 * (n % wn) * wl + wn, 2 * wn)
    return F.when(step["left"], left).otherwise(n - left)


def _earliest(done, c, slot, frame: int):
    """The source of the released quantum with the earliest deadline, the first of equal ones."""
    due = F.transform(c, lambda n, i: F.when((F.get(done, i) < n) & (_div(F.get(done, i) * frame, n) <= slot), F.struct(_div((F.get(done, i) + 1) * frame + n - 1, n).alias("due"), i.alias("i"))))
    return F.array_min(due)["i"]


def _edf(c, frame: int):
    """The (i, k) of each slot of a frame: source and quantum within the frame, for c[i] quanta of each source."""
    start = F.struct(F.transform(c, lambda n: F.lit(0).cast("long")).alias("done"), F.array().cast("array<struct<i:int,k:bigint>>").alias("out"))

    def step(state, slot):
        run = lambda i: F.struct(
            F.transform(state["done"], lambda k, j: k + (i == j).cast("long")).alias("done"),
            F.concat(state["out"], F.array(F.struct(i.cast("int").alias("i"), F.get(state["done"], i).alias("k")))).alias("out"),
        )
        return F.get(F.transform(F.array(_earliest(state["done"], c, slot, frame)), run), 0)

    return F.aggregate(F.sequence(F.lit(0), F.lit(frame - 1)), start, step, lambda x: x["out"])


def schedule(spark, weights: Mapping[str, int], quanta: Mapping[str, int], frame: int = FRAME) -> DataFrame:
    """(source, quantum, slot) for the quanta of each source (so many from 0 on)."""
    names, total = sorted(weights), sum(weights.values())
    slots = max(((quanta[s] + 2) * total // weights[s] + 1 for s in names), default=0)
    tree = F.from_json(F.lit(json.dumps(paths(weights))), "array<array<struct<wl:bigint,wn:bigint,left:boolean>>>")
    many = F.from_json(F.lit(json.dumps([quanta[s] for s in names])), "array<bigint>")
    had = lambda t: F.transform(tree, lambda p: F.aggregate(p, t, _shared))
    frames = spark.range(-(-slots // frame)).select((F.col("id") * frame).alias("t"))
    frames = frames.select("t", had(F.col("t")).alias("before"), had(F.col("t") + frame).alias("after"))
    frames = frames.select("t", "before", F.zip_with("after", "before", lambda a, b: a - b).alias("c"))
    frames = frames.where(F.exists(F.arrays_zip("before", "c", many.alias("n")), lambda x: (x["before"] < x["n"]) & (x["c"] > 0)))
    rows = frames.select("t", "before", F.posexplode(_edf(F.col("c"), frame)).alias("place", "run"))
    own = F.from_json(F.lit(json.dumps(names)), "array<string>")
    rows = rows.select(F.col("run.i").alias("i"), (F.get("before", F.col("run.i")) + F.col("run.k")).alias("quantum"), (F.col("t") + F.col("place")).alias("slot"))
    return rows.where(F.col("quantum") < F.get(many, F.col("i"))).select(F.get(own, F.col("i")).alias("source"), "quantum", "slot")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, seed: str = "mix", frame: int = FRAME) -> DataFrame:
    """docs with mix_rank (place within its source), mix_slot (the slot of its quantum) and mix_within (place within the quantum).

    The mix is the order by (mix_slot, mix_within). Without weights, a source's weight is the square
    root of its number of rows, to three decimals; a source without a weight of its own has the
    smallest given.
    """
    spark, quantum = docs.sparkSession, max(1, block // 3)
    docs = docs.drop("mix_rank", "mix_slot", "mix_within")
    source, order, bucket, place, before, turns = fresh(docs.columns, "source_", "order_", "bucket_", "place_", "before_", "turns_")
    own = F.coalesce(F.col("source").cast("string"), F.lit(""))
    sizes = {r[0]: r[1] for r in docs.groupBy(own.alias("s")).count().collect()}  # one row a source
    if weights is None:
        parts = {s: math.isqrt(n * 10**6) for s, n in sizes.items()}
    else:
        parts = {s: weights.get(s, min(weights.values())) for s in sizes}
    plan = schedule(spark, exact(parts) if parts else {"": 1}, {s: -(-n // quantum) for s, n in sizes.items()} or {"": 0}, frame)

    digits = max(0, math.ceil(math.log(max([1, *sizes.values()]) / BUCKET_ROWS, 16)))
    rows = docs.withColumns({source: own, order: F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))})
    rows = rows.withColumn(bucket, F.substring(order, 1, digits))
    counts = rows.groupBy(source, bucket).agg(F.count("*").alias("n"))
    past = F.sum("n").over(Window.partitionBy(source).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn(before, F.coalesce(past, F.lit(0)))
    wanted = counts.withColumn("quantum", F.explode(F.sequence(_div(F.col(before), F.lit(quantum)), _div(F.col(before) + F.col("n") - 1, F.lit(quantum)))))
    slots = wanted.join(plan.withColumnRenamed("source", source), [source, "quantum"])
    slots = slots.groupBy(source, bucket, before).agg(F.transform(F.array_sort(F.collect_list(F.struct("quantum", "slot"))), lambda x: x["slot"]).alias(turns))  # of a bucket's rows
    rank = F.row_number().over(Window.partitionBy(source, bucket).orderBy(order, "doc_id"))
    rows = rows.withColumn(place, rank).join(slots, [source, bucket])
    rows = rows.withColumn("mix_rank", F.col(before) + F.col(place) - 1)
    at = _div(F.col("mix_rank"), F.lit(quantum)) - _div(F.col(before), F.lit(quantum))
    return rows.withColumns({"mix_slot": F.get(turns, at.cast("int")), "mix_within": F.col("mix_rank") % quantum}).select(*docs.columns, "mix_rank", "mix_slot", "mix_within")
