"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are put into classes by the size q of their shingle set: c <= q < 2c
for a power of two c. For each class that has items, documents are cut into
overlapping windows of 4c shingles at every 2c, so a passage that quotes an item
lies within one window, of which it is a fair share. Window and item MinHash
samples that agree in any of SAMPLES values make a candidate: at a containment
of 0.8 the similarity is at least 0.19, and a miss has a chance of 1.4e-6.
Candidates are verified by exact containment of the item's shingle set in the
whole document's.

Items are broadcast in passes of about PASS_SHINGLES shingles (some 40 MB with their
samples). The rows found so far are written between passes, so that tasks hold the items
of one pass: a benchmark of any size is searched in bounded memory.

Nulls and edges: an item or document without words matches nothing; 1 to k - 1
words are one shingle. An empty benchmark or table matches nothing. Items with a null id are left out; items that share an id
count as one if any of them is found. Documents are judged row by row; further
columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import U64, distinct, fresh, lists, pieces, shingles, words, written

SAMPLES = 64
PASS_SHINGLES = 500_000
_rng = np.random.default_rng(20240301)
FACTOR = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * U64(2) + U64(1)
SHIFT = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)


@dataclass
class Items:
    """One pass's items: ids, shingle sets, and by class the sorted MinHash values of each sample with the items that have them."""

    ids: np.ndarray
    sets: list[np.ndarray]
    classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def prepare(ids: np.ndarray, texts: pa.Array, k: int) -> Items:
    sets: list[np.ndarray] = []
    for i, j, buf, off in pieces(texts):
        _, _, h, first = words(buf, off)
        doc, h = distinct(*shingles(h, first, k))
        sets += np.split(h, np.searchsorted(doc, np.arange(1, j - i)))
    level = np.array([len(s).bit_length() - 1 for s in sets], np.int64)
    classes = {}
    for t in sorted(set(level[level >= 0].tolist())):
        own = np.flatnonzero(level == t)
        flat, start = np.concatenate([sets[i] for i in own]), np.cumsum([0, *(len(sets[i]) for i in own[:-1])])
        found = []
        for p in range(SAMPLES):
            with np.errstate(over="ignore"):
                low = np.minimum.reduceat(flat * FACTOR[p] + SHIFT[p], start)
            order = np.argsort(low, kind="stable")
            near = np.zeros(1 << 16, bool)
            near[(low >> U64(48)).astype(np.int64)] = True
            found.append((low[order], own[order], near))
        classes[1 << t] = found
    return Items(ids, sets, classes)


def search(column: pa.Array, items: Items, k: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item id, containment) of each text of column and item that it contains."""
    out: list[tuple[int, int, float]] = []
    for i, j, buf, off in pieces(column):
        _, _, h, first = words(buf, off)
        doc, h = shingles(h, first, k)
        if not len(doc):
            continue
        begin = np.searchsorted(doc, np.arange(j - i + 1))
        halves = {}
        for c in items.classes:
            n = -(-np.diff(begin) // (2 * c))
            owner = np.repeat(np.arange(j - i), n)
            at = begin[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * 2 * c
            halves[c] = owner, at, np.r_[owner[1:] == owner[:-1], False]
        pairs: set[tuple[int, int]] = set()
        for p in range(SAMPLES):
            with np.errstate(over="ignore"):
                v = h * FACTOR[p] + SHIFT[p]
            for c, found in items.classes.items():
                owner, at, more = halves[c]
                low = np.minimum.reduceat(v, at)
                low[:-1] = np.where(more[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                value, item, near = found[p]
                for w in np.flatnonzero(near[(low >> U64(48)).astype(np.int64)]):
                    a, b = np.searchsorted(value, low[w], "left"), np.searchsorted(value, low[w], "right")
                    pairs.update((int(owner[w]), int(x)) for x in item[a:b])
        sets: dict[int, np.ndarray] = {}
        for d, x in sorted(pairs):
            if d not in sets:
                sets = {d: np.unique(h[begin[d] : begin[d + 1]])}
            own, q = sets[d], items.sets[x]
            at = np.minimum(np.searchsorted(own, q), len(own) - 1)
            common = int((own[at] == q).sum())
            if 100 * common >= percent * len(q):
                out.append((i + d, int(items.ids[x]), common / len(q)))
    return tuple(np.array(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, items_column: str = "item_ids", best_column: str = "containment") -> DataFrame:
    """docs with the sorted ids of the items that each text contains (empty: none) and the largest containment (null: none).

    The two columns replace any of these names.
    """
    spark = docs.sparkSession
    docs = docs.drop(items_column, best_column)
    schema = StructType([*docs.schema.fields, StructField(items_column, ArrayType(LongType())), StructField(best_column, DoubleType())])
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    # passes: items dealt by hash, so that each holds about PASS_SHINGLES shingles at most
    total = rows.agg(F.sum(F.length("text") / 5)).first()[0] or 0
    passes = int(total // PASS_SHINGLES) + 1
    for k_pass in range(passes):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k_pass).orderBy("item_id", "text").toArrow()
        items = prepare(part.column("item_id").to_numpy(), part.column("text").combine_chunks(), k)
        shared = spark.sparkContext.broadcast(items)
        docs = _one_pass(docs, shared, k, percent, schema, first=k_pass == 0)
        if k_pass + 1 < passes:
            docs = written(docs, "decontaminate-pass")
            shared.unpersist()
    return docs


def _one_pass(docs, shared, k, percent, schema, first):
    def run(batches):
        for b in batches:
            row, item, part = search(b.column("text"), shared.value, k, percent)
            n = b.num_rows
            old = ([()] * n, [None] * n) if first else (b.column(-2).to_pylist(), b.column(-1).to_pylist())
            ids, best = [set(x) for x in old[0]], list(old[1])
            for r, x, c in zip(row.tolist(), item.tolist(), part.tolist(), strict=True):
                ids[r].add(x)
                best[r] = max(best[r] or 0.0, c)
            flat = np.array([x for s in ids for x in sorted(s)], np.int64)
            columns = b.columns if first else b.columns[:-2]
            yield pa.RecordBatch.from_arrays([*columns, lists(flat, np.array([len(s) for s in ids]), pa.int64()), pa.array(best, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that contain no item of the benchmark; columns as in docs."""
    items, best = fresh(docs.columns, "items_", "containment_")
    return matches(docs, benchmark, k, percent, items, best).where(F.size(items) == 0).drop(items, best)
