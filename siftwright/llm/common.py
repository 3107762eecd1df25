"""Shared pieces of the corpus operators: tables in the shared folder, and text hashing in numpy.

Texts reach Python as Arrow batches; they are hashed in bounded pieces of a few
MB by prefix polynomials modulo 2**64, so that no per-word Python code runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64
INVERSE = U64(pow(int(BASE), -1, 2**64))
PIECE = 1 << 18  # bytes of text that are hashed at once; longer texts are hashed piece by piece
FEW = 1_000_000  # ids of 8 bytes that are broadcast to thin a table before a join
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ---------------------------------------------------------------- tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one in /tmp only for a master in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints/siftwright"
    return at.rstrip("/")


def thinned(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """rows without those that a join with keys (a table) would drop, where few keys make that cheap; all rows otherwise."""
    return rows.join(F.broadcast(keys), on, "left_semi") if keys.count() <= FEW else rows


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the shuffle files of this write go when it ends
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `written`, once all that is computed from them is written too."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fresh(taken, *names: str) -> list[str]:
    """The names, lengthened until no column of `taken` has them (case aside)."""
    held, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def doc_hash_mod(column: str, n: int):
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


# ---------------------------------------------------------------- hashing
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept between calls."""
    if len(_powers[0]) < n:
        n = max(n, PIECE + 4096)
        with np.errstate(over="ignore"):
            for k, b in enumerate((BASE, INVERSE)):
                x = np.full(n, b, U64)
                x[0] = 1
                _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (buf[t] + 1) * BASE**t over i <= t < j, modulo 2**64."""
    pw, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(U64) + U64(1)) * pw[: len(buf)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the bytes of each span, the same wherever it stands."""
    _, inv = powers(len(prefix))
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * inv[start]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets) of runs of texts of about limit bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def long_hash(buf: np.ndarray) -> np.uint64:
    """The span hash of one string of any length, by pieces."""
    out, turn = 0, 1
    for i in range(0, len(buf), PIECE):
        out += int(prefix_hashes(buf[i : i + PIECE])[-1]) * turn
        turn = turn * pow(int(BASE), PIECE, 2**64) % 2**64
    return U64(out % 2**64)


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each of these spans, which follow each other, by pieces of about PIECE bytes."""
    out, i = np.zeros(len(start), U64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        part = buf[start[i] : end[j - 1]]
        out[i:j] = span_hashes(prefix_hashes(part), start[i:j] - start[i], end[i:j] - start[i]) if len(part) <= PIECE else long_hash(part)
        i = j
    return out


def words(buf: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: start, end, hash of each, and the index of each text's first word (one more entry than texts)."""
    if lower:
        buf = LOWER[buf]
    black = np.zeros(len(buf) + 2, bool)
    black[1:-1] = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(black[1:-1] & (~black[:-2] | edge[:-1]))
    end = np.flatnonzero(black[1:-1] & (~black[2:] | edge[1:])) + 1
    h = mix(hashes(buf, start, end) + U64(1))
    return start, end, h, np.searchsorted(start, off)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of k words, in order; of fewer words, the whole sequence as one."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
    start = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(n - k + 1, 0)) - np.maximum(n - k + 1, 0), np.maximum(n - k + 1, 0)) + first[doc]
    docs, hashes = [doc], [sequence_hash(h, start, k)]
    for short in range(1, k):
        d = np.flatnonzero(n == short)
        if len(d):
            docs.append(d)
            hashes.append(sequence_hash(h, first[d], short))
    if len(docs) == 1:
        return docs[0], hashes[0]
    doc, out = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(doc, kind="stable")
    return doc[order], out[order]


def sequence_hash(h: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """The hash of k words from each start on."""
    with np.errstate(over="ignore"):
        out = np.full(len(start), U64(k), U64)
        for i in range(k):
            out = out * U64(0xD1342543DE82EF95) + h[start + i]
        return mix(out)


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, hash) pairs, by text and hash."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list a row, of that many of the values."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, type=kind))
