"""Near-duplicate documents: banded MinHash, odd sketches and exact confirmation.

1. One pass over the texts gives each document the size and a 128-bit fingerprint
   of its shingle set and the keys of BANDS bands of ROWS MinHash values. Documents
   with equal sets form a class, for which its smallest document stands.
2. Each document of a bucket (a band key) meets the smallest of it, its leader, in
   tasks of at most STAR_DOCS documents of one leader. That settles copies of any
   number without pairs among them.
3. Buckets whose documents are now in one component are done. The documents of others
   meet in blocks of bounded size, a large bucket as pairs of blocks; only pairs of
   different components are looked at.
4. Within a task, each document's MinHash sample is folded into an odd sketch (a bitmap
   of parities); the population count of the XOR of two sketches estimates their
   similarity and rejects pairs far below the threshold. The other pairs of one
   distance in the task, likeliest first, are confirmed on the full sets unless links
   made before join them, so no list of pairs is longer than the task's rows.
5. The components of the confirmed links are the result: one row per document.

Texts are thinned to those of documents in buckets before they are joined, where few are.

A pair at the threshold shares no band with a chance of about 2e-6.

Nulls and edges: a null or empty text, or one without words, has no shingles and
is linked with nothing; 1 to k - 1 words are one shingle. Rows that repeat a doc_id
are one document: `cluster` returns each, `deduplicate` one of them. A row with a null
doc_id is linked with nothing and kept. Extra columns are ignored by `cluster` and kept
by `deduplicate`. A long text takes some ten times its size while it is hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, distinct, fresh, lists, mix, pieces, shingles, thinned, words, written
from .components import components

BANDS, ROWS, SKETCH_BITS = 28, 6, 512
SAMPLES = BANDS * ROWS
BLOCK_DOCS, BLOCK_SHINGLES, STAR_DOCS = 1000, 1_000_000, 500
_rng = np.random.default_rng(20240229)
FACTOR = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * U64(2) + U64(1)
SHIFT = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, past the last row, text, hash) of the different shingles of each text."""
    for i, j, buf, off in pieces(column):
        _, _, h, first = words(buf, off)
        yield i, j, *distinct(*shingles(h, first, k))


def samples(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """SAMPLES MinHash values of each of n sets; zeros of an empty one."""
    out = np.zeros((n, SAMPLES), U64)
    if len(doc):
        start = np.flatnonzero(np.diff(doc, prepend=-1))
        with np.errstate(over="ignore"):
            for p in range(SAMPLES):
                out[doc[start], p] = np.minimum.reduceat(h * FACTOR[p] + SHIFT[p], start)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    keys = np.tile(mix(np.arange(1, BANDS + 1, dtype=U64)), (len(sample), 1))
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = mix(keys * U64(0xD1342543DE82EF95) + sample[:, r::ROWS])
    return keys


def odd_sketches(sample: np.ndarray) -> np.ndarray:
    """Parity bitmaps: bit b is the parity of the number of sampled values that hash to b."""
    with np.errstate(over="ignore"):
        bit = (mix(sample + mix(np.arange(SAMPLES, dtype=U64))) % U64(SKETCH_BITS)).astype(np.int64)
    out = np.zeros((len(sample), SKETCH_BITS // 64), U64)
    at = (np.arange(len(sample))[:, None] * (SKETCH_BITS // 64) + (bit >> 6)).ravel()
    np.bitwise_xor.at(out.reshape(-1), at, U64(1) << (bit.ravel() & 63).astype(U64))
    return out


def most_bits(threshold: float, deviations: float = 5.5) -> float:
    """The XOR population count beyond which a pair at the threshold lies with negligible chance."""
    differ = SAMPLES * (1 - threshold) + deviations * np.sqrt(SAMPLES * threshold * (1 - threshold))
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differ))
    return float(mean + 3 * np.sqrt(mean / 2))


def estimate(bits: np.ndarray) -> np.ndarray:
    """Similarity from XOR population counts of odd sketches."""
    part = np.minimum(2 * np.asarray(bits, float) / SKETCH_BITS, 1 - 1e-9)
    return np.clip(1 + SKETCH_BITS * np.log(1 - part) / (4 * SAMPLES), 0, 1)


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, keys): set size, fingerprint of the set, band keys (null if it is empty)."""

    def run(batches):
        for b in batches:
            for i, j, doc, h in shingle_sets(b.column("text"), k):
                n = np.bincount(doc, minlength=j - i)
                start = np.flatnonzero(np.diff(doc, prepend=-1))
                f = np.zeros((2, j - i), U64)
                if len(doc):
                    f[0, doc[start]] = np.add.reduceat(mix(h), start)
                    f[1, doc[start]] = np.bitwise_xor.reduceat(mix(h ^ U64(0xABCDEF0123456789)), start)
                keys = band_keys(samples(doc, h, j - i))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), lists(keys[n > 0].ravel().view(np.int64), np.where(n > 0, BANDS, 0), pa.int64())],
                    ["doc_id", "n_shingles", "f1", "f2", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>")


def confirm(ids: np.ndarray, task: np.ndarray, side: np.ndarray, root: np.ndarray, text: pa.Array, k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed links between documents of one task and of different roots; rows are sorted by task. side: -1, or which of two parts (then only pairs across count)."""
    n = len(ids)
    sets: list[np.ndarray] = []
    sketch = np.zeros((n, SKETCH_BITS // 64), U64)
    for i, j, doc, h in shingle_sets(text, k):
        sets += np.split(h, np.searchsorted(doc, np.arange(1, j - i)))
        sketch[i:j] = odd_sketches(samples(doc, h, j - i))
    size = np.array([len(s) for s in sets])
    start = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
    last = np.repeat(np.r_[start[1:], n], np.diff(np.r_[start, n]))
    group = np.unique(root, return_inverse=True)[1]
    limit = most_bits(percent / 100)
    links = []
    row, gap = np.arange(n), 1
    while len(row := row[row + gap < last[row]]):
        a, b = row, row + gap
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        ok = (100 * low >= percent * high) & ((side[a] < 0) | (side[a] != side[b])) & (group[a] != group[b])
        a, b = a[ok], b[ok]
        bits = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64)
        near = np.flatnonzero(bits <= limit)
        for p in near[np.argsort(bits[near], kind="stable")].tolist():
            x, y = a[p], b[p]
            if group[x] == group[y]:
                continue
            both = np.concatenate([sets[x], sets[y]])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (len(both) - common):
                links.append((ids[x], ids[y]))
                group[group == group[y]] = group[x]
        gap += 1
    found = np.array(links, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def confirmed(blocks: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between documents of blocks (task, side, doc_id, root, text)."""
    most_rows, most_bytes = 2000, 1 << 22

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def done(table: pa.Table):
            table = table.combine_chunks()
            col = lambda c: table.column(c).to_numpy()
            a, b = confirm(col("doc_id"), col("task"), col("side"), col("root"), table.column("text"), k, percent)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                held.append(part)
                rows, size = rows + part.num_rows, size + part.nbytes
                if rows < most_rows and size < most_bytes:
                    continue
                table = pa.Table.from_batches(held)
                task = table.column("task").to_numpy()
                cut = int(np.searchsorted(task, task[-1]))  # the last task may go on
                if cut:
                    yield done(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    rows, size = table.num_rows - cut, 0
        if held:
            yield done(pa.Table.from_batches(held))

    return blocks.repartition("task").sortWithinPartitions("task").select("task", "side", "doc_id", "root", "text").mapInArrow(run, "a long, b long")


def dealt(members: DataFrame, key: str, docs: int) -> DataFrame:
    """members (key, doc_id, n_shingles, ...) with a block number below `blocks`, so that a block has about `docs` documents and BLOCK_SHINGLES shingles at most."""
    sizes = members.groupBy(key).agg(F.ceil(F.greatest(F.count("*") / docs, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return members.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))


def cluster(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id (smallest document with the same set), component_id, kept."""
    signed = written(signatures(docs, k), "near-signatures")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("class_id"), F.first("keys").alias("keys"))
    classes = written(classes, "near-classes")
    keyed = classes.select(F.col("class_id").alias("doc_id"), "n_shingles", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    leaders = written(leaders, "near-leaders")  # a plain exchange, so that a large bucket can be split in the join
    shared = written(keyed.join(leaders.hint("merge"), "key"), "near-buckets")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    texts = thinned(texts, written(shared.select("doc_id").distinct(), "near-members"), "doc_id")

    def settled(tasks: DataFrame, label: str) -> DataFrame:
        return written(confirmed(texts.join(tasks.hint("merge"), "doc_id"), k, percent), label)

    stars = dealt(shared.where("doc_id <> leader").select("leader", "doc_id", "n_shingles").distinct(), "leader", STAR_DOCS)
    stars = written(stars.select("doc_id", "leader", F.xxhash64("leader", "block").alias("task")), "near-stars")
    heads = stars.select(F.col("leader").alias("doc_id"), "task").distinct()
    side = lambda n: F.lit(n).alias("side")
    first = settled(stars.select("doc_id", "task", side(1), F.col("doc_id").alias("root")).unionByName(heads.select("doc_id", "task", side(0), F.col("doc_id").alias("root"))), "near-links")
    roots = written(components(first, "near-parts"), "near-roots").withColumnRenamed("node", "doc_id")
    placed = written(shared.join(roots.hint("merge"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "near-placed")
    # buckets of several components; of those with the same documents, one
    members = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("f"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("g"))
    open_ = written(members.where("low < high").groupBy("n", "f", "g").agg(F.min("key").alias("key")).select("key"), "near-open")
    blocks = dealt(placed.join(open_.hint("merge"), "key"), "key", BLOCK_DOCS)
    # a bucket in one block is one task; of n blocks, each pair of blocks is one
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "doc_id",
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
        F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"),
        "root",
    )
    second = settled(blocks, "near-more-links")
    roots = components(first.unionByName(second), "near-components").withColumnRenamed("node", "class_id")
    out = signed.join(classes.drop("keys").hint("merge"), ["n_shingles", "f1", "f2"], "left").withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id"))).join(roots, "class_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("root", "class_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """The documents of which each near-duplicate group keeps its smallest, once each; columns as in docs."""
    found = written(cluster(docs, k, percent).select("doc_id", "kept"), "near-kept").where("doc_id is not null")
    again = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept"))
    dropped, again = again.where("not kept").select("doc_id"), written(again.where("kept and n > 1").select("doc_id"), "near-repeated")
    gone = fresh(docs.columns, "dropped_")[0]
    left = docs.join(dropped.select(F.col("doc_id").alias(gone)), docs["doc_id"] == F.col(gone), "left_anti")
    if again.isEmpty():
        return left
    # of rows that repeat an id one stays, whose text's hash is least
    mark, row = fresh(docs.columns, "again_", "row_")
    left = left.join(again.select(F.col("doc_id").alias(mark)), left["doc_id"] == F.col(mark), "left")
    one = left.where(F.col(mark).isNotNull()).groupBy(mark).agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias(row))
    return left.where(F.col(mark).isNull()).drop(mark).unionByName(one.select(f"{row}.*"))
