"""WARC archives: writing, normalising whole-file gzip streams, reading by offset index.

`normalise_file` takes a .warc.gz that is one gzip stream over all records (or has
any other member layout), inflates it once in bounded pieces, writes every record
as a member of its own and a sidecar index (archive, offset, length, and the
record's type, id and target, tab-separated), so that readers can seek. `archive`
does it for a table of pages: each task writes monolithic archives of bounded size
into the shared folder and normalises them. `read` goes through the index.

Files appear under their final names only when complete, and a repeated task
replaces them by the same bytes, so lost executors leave no half archives.

Nulls and edges: a null html is an empty payload; a null url is written as
urn:page:<id>; white space and control characters in a url are percent-encoded.
Rows that repeat a page_id are records of their own. A null page_id stays null. An
empty table makes no archive. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written

PIECE = 1 << 20
ARCHIVE_BYTES = 64 << 20  # of records before compression
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "archive string, entries long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string"


# ---------------------------------------------------------------- files
def _store(uri: str):
    """(file system or None for local files, path) of a location."""
    if uri.startswith("file:"):
        return None, "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return None, uri
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _open(uri: str, mode: str):
    store, path = _store(uri)
    if store is None:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    return store.open_output_stream(path) if mode == "wb" else store.open_input_file(path)


def _move(old: str, new: str) -> None:
    store, a = _store(old)
    b = _store(new)[1]
    os.replace(a, b) if store is None else store.move(a, b)


def _remove(uri: str) -> None:
    store, path = _store(uri)
    os.remove(path) if store is None else store.delete_file(path)


# ---------------------------------------------------------------- records
def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A response record, as bytes of an uncompressed archive."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = (
        f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target}')}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {target}\r\n"
        f"WARC-Payload-Digest: sha1:{digest(payload)}\r\n" + ("" if page_id is None else f"X-Page-ID: {page_id}\r\n") + f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def inflated(file) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in bounded pieces."""
    engine = zlib.decompressobj(31)
    while data := file.read(PIECE):
        while data:
            if engine.eof:
                engine = zlib.decompressobj(31)
            yield engine.decompress(data, PIECE)
            data = engine.unused_data if engine.eof else engine.unconsumed_tail
            if engine.eof and not data.strip(b"\0"):
                data = b""
    if not engine.eof:
        if rest := engine.flush():
            yield rest
        if not engine.eof:
            raise ValueError("the gzip stream ends early")


def split_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(header fields, all bytes of the record in pieces) of each record; only a header and a piece are in memory."""
    held = bytearray()

    def more() -> bool:
        part = next(parts, None)
        if part:
            held.extend(part)
        return part is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a record's header ends early")
                return
        head = bytes(held[: end + 4])
        found = fields(head)
        if not re.match(rb"WARC/\d", head) or "content-length" not in found:
            raise ValueError(f"not a WARC record: {head[:60]!r}")
        need = len(head) + int(found["content-length"]) + 4

        def body(need=need):
            while need:
                while not held:
                    if not more():
                        raise ValueError("a record ends early")
                part = bytes(held[:need])
                del held[: len(part)]
                need -= len(part)
                yield part

        content = body()
        yield found, content
        for _ in content:  # what the caller has not taken
            pass


def normalise_file(source: str, target: str, level: int = 6) -> tuple[int, int]:
    """Writes source's records to target, one member each, and target.idx; (records, bytes)."""
    temporary = f"{target}.{uuid.uuid4().hex}.tmp"
    at = n = 0
    with _open(source, "rb") as old, _open(temporary, "wb") as new, _open(temporary + ".idx", "wb") as index:
        for found, content in split_records(inflated(old)):
            engine, start = zlib.compressobj(level, zlib.DEFLATED, 31), at
            for part in content:
                data = engine.compress(part)
                at += len(data)
                new.write(data)
            data = engine.flush()
            at += len(data)
            new.write(data)
            n += 1
            index.write("\t".join([str(start), str(at - start), found.get("warc-type", ""), found.get("warc-record-id", ""), found.get("warc-target-uri", "")]).encode() + b"\n")
    _move(temporary, target)
    _move(temporary + ".idx", target + ".idx")  # the index last: where it is, the archive is complete
    return n, at


def write_monolithic(records: Iterator[bytes], target: str, level: int = 1) -> int:
    """One gzip stream over all records; their number."""
    engine, n = zlib.compressobj(level, zlib.DEFLATED, 31), 0
    with _open(target, "wb") as file:
        for r in records:
            file.write(engine.compress(r))
            n += 1
        file.write(engine.flush())
    return n


# ---------------------------------------------------------------- tables
def archive(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives the pages; (archive, entries) of the normalised files in folder (default: a new one in the shared folder)."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        part = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        number, left = 0, next(rows, None)
        while left is not None:

            def bounded():
                nonlocal left
                size = 0
                while left is not None and size < archive_bytes:
                    data = record(*left)
                    size += len(data)
                    yield data
                    left = next(rows, None)

            whole = f"{folder}/whole-{part:06d}-{number:04d}.{uuid.uuid4().hex}.warc.gz"
            target = f"{folder}/part-{part:06d}-{number:04d}.warc.gz"
            write_monolithic(bounded(), whole)
            n, _ = normalise_file(whole, target)
            _remove(whole)
            yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], ["archive", "entries"])
            number += 1

    return written(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, MANIFEST), "warc-manifest")


def normalise(spark: SparkSession, paths: DataFrame, folder: str) -> DataFrame:
    """Rewrites the archives of paths (archive) into folder, under their own names; (archive, entries)."""

    def run(batches):
        for b in batches:
            for old in b.column("archive").to_pylist():
                new = f"{folder}/{old.rsplit('/', 1)[-1]}"
                n, _ = normalise_file(old, new)
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([n], pa.int64())], ["archive", "entries"])

    return written(paths.select("archive").repartition(spark.sparkContext.defaultParallelism, "archive").mapInArrow(run, MANIFEST), "warc-manifest")


def read(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """Every record of the archives, found through their indexes and verified against its digest; with payload its content too."""
    schema = RECORDS + (", payload binary" if payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def rows(name: str):
        with _open(name + ".idx", "rb") as index, _open(name, "rb") as file:
            for line in index.read().splitlines():
                start, length = map(int, line.split(b"\t", 2)[:2])
                file.seek(start)
                data = zlib.decompress(file.read(length), 31)
                head, _, block = data.partition(b"\r\n\r\n")
                found = fields(head)
                content = block[: int(found["content-length"])].partition(b"\r\n\r\n")[2]
                own = digest(content)
                if found.get("warc-payload-digest", f"sha1:{own}") != f"sha1:{own}":
                    raise ValueError(f"{name} at {start}: the payload does not match its digest")
                page, target = found.get("x-page-id"), found.get("warc-target-uri")
                yield (int(page) if page else None, target, len(content), own, content)[: len(names)]

    def batched(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds)], names)

    def run(batches):
        for b in batches:
            for name in b.column("archive").to_pylist():
                held, size = [], 0
                for r in rows(name):
                    held.append(r)
                    size += r[2] if payload else 100
                    if size > 4 << 20:
                        yield batched(held)
                        held, size = [], 0
                if held:
                    yield batched(held)

    # by number, as a few file names would otherwise be read by one task
    return manifest.select("archive").repartition(max(1, manifest.count())).mapInArrow(run, schema)


def revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """records with record_type and refers_to: of equal payloads of at least least_bytes, all but the one with the smallest page_id are revisits.

    Without any page_id among equal payloads all are responses.
    """
    records = written(records, "warc-records")
    first = records.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("_first"))
    first = written(first, "warc-first")  # a plain exchange, so that a frequent payload can be split in the join
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return records.join(first, ["payload_digest", "payload_bytes"], "left").withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_first"))}).drop("_first")
