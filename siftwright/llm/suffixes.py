"""Removing long repeats: a suffix sort that compares by prefix hashes.

Every byte that lies in a string of `span` bytes which also starts elsewhere goes.

1. Each window of `span` bytes has an anchor: the leftmost least-hashed gram of GRAM
   bytes within it, which depends on the window's bytes alone. The windows of a text
   with one anchor are neighbours; the bytes they cover are a segment. Equal windows
   have equal anchors at equal places, so only segments with one anchor are compared.
2. Anchors that occur once need no look. Segments whose bytes occur more than once
   are removed whole; this is counted, so copies never meet in one task.
3. The other segments of an anchor come together, each with its bytes. The suffixes
   from the anchor on, and the reversed prefixes before it, are sorted by mergesort.
   Two suffixes are compared in a logarithmic number of steps: prefix polynomial
   hashes and binary search give their common extension, the next byte the order.
   Extensions of neighbours are verified on the bytes (after a collision that block
   is sorted by the bytes). For each distance of the window's start from the anchor,
   segments that agree that far to the left and, for the rest, to the right have an
   equal window.
4. An anchor with over GROUP different segments is split by more context. Windows are
   equal only at an equal distance d of their start from the anchor, so each segment is
   cut into its windows with d in the lower and in the upper half of the range, and
   grouped anew by the bytes that all windows of that half have in common. These grow
   from the anchor's own GRAM bytes, at 8 halvings, to the window's span bytes, where a
   group has one kind of segment at most. Groups that fit by then are sorted as above.

Equal segments, which are counted and not sorted, agree in two 64-bit hashes, of the
anchor and of the segment.

Nulls and edges: a null text counts as empty; texts under `span` bytes keep all.
Matches never cross texts, and overlapping ones count. Rows are told apart by a 96-bit
hash of doc_id and text, so rows that repeat an id, or have none, are judged each by
their own text and returned each; rows equal in both are copies of each other. Extra
columns are ignored. Long texts are hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, PIECE, U64, mix, pieces, prefix_hashes, span_hashes, written

SPAN, GRAM, GROUP = 200, 48, 4096


def segment(buf: np.ndarray, off: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, end, anchor's place, anchor hash, bytes' hash) of each segment of the texts."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),) * 2
    width = span - gram + 1
    n = len(buf) - gram + 1
    if n < width:
        return none
    prefix = prefix_hashes(buf)
    at = np.arange(n)
    key = (mix(span_hashes(prefix, at, at + gram)) & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    # the least of each run of `width` keys: from the block's start to the run's end, and from the run's start to its block's end
    padded = np.full(-(-n // width) * width, np.iinfo(U64).max, U64)
    padded[:n] = key
    ahead = np.minimum.accumulate(padded.reshape(-1, width), 1).ravel()
    back = np.minimum.accumulate(padded.reshape(-1, width)[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    doc = np.repeat(np.arange(len(off) - 1), np.maximum(np.diff(off) - span + 1, 0))
    size = np.maximum(np.diff(off) - span + 1, 0)
    start = off[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    if not len(doc):
        return none
    anchor = (low[start] & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:], len(doc)] - 1
    s, e, p = start[first], start[last] + span, anchor[first]
    h = mix(span_hashes(prefix, s, e) ^ mix((e - s).astype(U64)))
    return doc[first], s, e, p, mix(span_hashes(prefix, p, p + gram)), h


def parts(buf: np.ndarray, off: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, offsets): the texts as they are, or one long text in parts that overlap, so that each window is in one."""
    if len(buf) <= 2 * PIECE:
        yield 0, buf, off
        return
    for at in range(0, max(len(buf) - span + 1, 1), PIECE):
        part = buf[at : at + PIECE + span - 1]
        yield at, part, np.array([0, len(part)])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, d, t): d and t tell rows apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.withColumns({"d": F.xxhash64("doc_id", "text"), "t": F.hash("doc_id", "text")})


def segments(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(a, h, d, t, s, e, q): anchor and segment hashes, row, start, end and the anchor's place in the segment."""

    def run(batches):
        for b in batches:
            for i, j, whole, ends in pieces(b.column("text")):
                for at, buf, off in parts(whole, ends, span):
                    doc, s, e, p, a, h = segment(buf, off, span, gram)
                    base, row = off[doc] - at, pa.array(i + doc)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(h.view(np.int64)), b.column("d").take(row), b.column("t").take(row), pa.array((s - base).astype(np.int64)), pa.array((e - base).astype(np.int64)), pa.array((p - s).astype(np.int32))],
                        ["a", "h", "d", "t", "s", "e", "q"],
                    )

    return keyed(docs).select("d", "t", "text").mapInArrow(run, "a long, h long, d long, t int, s long, e long, q int")


class Sorter:
    """Suffixes of a buffer, each from a place over at most so many bytes, compared by prefix hashes."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.buf, self.start, self.length = buf, start, length
        self.prefix = prefix_hashes(buf)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The common extension of suffixes x and y, by binary search over equal hashes."""
        a, b = self.start[x], self.start[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.length[x], self.length[y])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = span_hashes(self.prefix, a, a + mid) == span_hashes(self.prefix, b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether x sorts before y; where neither does, ties."""
        n = self.common(x, y)
        more_x, more_y = n < self.length[x], n < self.length[y]
        a = self.buf[np.where(more_x, self.start[x] + n, 0)].astype(np.int16)
        b = self.buf[np.where(more_y, self.start[y] + n, 0)].astype(np.int16)
        a, b = np.where(more_x, a, -1), np.where(more_y, b, -1)
        return (a < b) | ((a == b) & ties)

    def sort(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The order of the suffixes by group: bottom-up mergesort of all groups at once. begin, size: of each suffix's group."""
        n = len(self.start)
        order, width = np.arange(n), 1
        while (at := np.flatnonzero(size > width)).size:
            place = at - begin[at]
            run = place // width
            other = begin[at] + (run ^ 1) * width  # the run to merge with
            low = np.minimum(other, begin[at] + size[at])
            stop = np.minimum(other + width, begin[at] + size[at])
            first, high, left = low.copy(), stop.copy(), run % 2 == 0
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) >> 1
                x, y = order[at[open_]], order[mid]
                # an element of the left run stands before equal ones of the right
                smaller = np.where(left[open_], self.before(y, x, False), self.before(y, x, True))
                low[open_], high[open_] = np.where(smaller, mid + 1, low[open_]), np.where(smaller, high[open_], mid)
            to = begin[at] + (run - run % 2) * width + place % width + (low - first)
            new = order.copy()
            new[to] = order[at]
            order, width = new, width * 2
        return order

    def extensions(self, order: np.ndarray, group: np.ndarray) -> np.ndarray | None:
        """The common extension of each sorted suffix with the next of its group (-1: none), verified on the bytes; None after a collision."""
        x, y = order[:-1], order[1:]
        out = np.full(len(order), -1, np.int64)
        at = np.flatnonzero(group[x] == group[y])
        x, y = x[at], y[at]
        n = self.common(x, y)
        for i in range(0, len(at), 20_000):
            c, d, m = x[i : i + 20_000], y[i : i + 20_000], n[i : i + 20_000]
            step = np.arange(m.max(initial=0))
            inside = step < m[:, None]
            a, b = np.where(inside, self.start[c][:, None] + step, 0), np.where(inside, self.start[d][:, None] + step, 0)
            if ((self.buf[a] != self.buf[b]) & inside).any():
                return None
        out[at] = n
        return out

    def sort_bytes(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and extensions from the bytes themselves."""
        text = [self.buf[s : s + n].tobytes() for s, n in zip(self.start, self.length, strict=True)]
        order = np.array(sorted(range(len(text)), key=lambda i: (group[i], text[i])), np.int64)
        out = np.full(len(order), -1, np.int64)
        for i in range(len(order) - 1):
            if group[order[i]] == group[order[i + 1]]:
                c, d = text[order[i]], text[order[i + 1]]
                out[i] = next((k for k in range(min(len(c), len(d))) if c[k] != d[k]), min(len(c), len(d)))
        return order, out


def repeated(group: np.ndarray, buf: np.ndarray, off: np.ndarray, anchor: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each segment (rows sorted by group): the largest and least distance from its window's start to the anchor at which another of the group has an equal window; -1: none."""
    n = len(group)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    begin, size = np.repeat(first, size), np.repeat(size, size)
    place, end = off[:-1] + anchor, off[1:]
    found = []
    for b, start, length in ((buf, place, np.minimum(end - place, span)), (buf[::-1].copy(), len(buf) - place, np.minimum(anchor, span))):
        sorter = Sorter(b, start, length)
        order = sorter.sort(begin, size)
        common = sorter.extensions(order, group)
        if common is None:
            order, common = sorter.sort_bytes(group)
        most = np.zeros(n, np.int64)
        most[order] = np.maximum(common, np.r_[-1, common[:-1]])
        found.append((order, common, most))
    (right, right_common, most_right), (left, left_common, most_left) = found
    far, near = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    may = np.flatnonzero(most_right + most_left >= span)
    reach, rest = anchor, end - place  # bytes before the anchor, and from it on
    kind_right, kind_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for distance in range(span - gram + 1):
        own = may[(reach[may] >= distance) & (rest[may] >= span - distance) & (most_left[may] >= distance) & (most_right[may] >= span - distance)]
        if len(own) < 2:
            continue
        kind_right[right] = np.r_[0, np.cumsum(right_common[:-1] < span - distance)]
        kind_left[left] = np.r_[0, np.cumsum(left_common[:-1] < distance)]
        key = kind_right[own] * (n + 1) + kind_left[own]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = own[count[inverse] > 1]
        far[hit] = distance
        near[hit] = np.where(near[hit] < 0, distance, near[hit])
    return far, near


BODIES = "a long, d long, t int, s long, q int, need boolean, lo int, hi int, body binary"


def _with_bytes(docs: DataFrame, wanted: DataFrame, span: int, gram: int) -> DataFrame:
    """wanted (a, d, t, s, e, q, need) with the segments' bytes and the range of distances, which is whole."""
    names = [x.split()[0] for x in BODIES.split(", ")]

    def run(batches):
        for b in batches:
            kept = b.column("found")
            found, offset = kept.flatten(), np.r_[0, np.cumsum(kept.value_lengths().to_numpy(zero_copy_only=False))]
            s, e = found.field("s").to_numpy(), found.field("e").to_numpy()
            for i, j, buf, off in pieces(b.column("text")):
                lo, hi = offset[i], offset[j]
                row = np.repeat(np.arange(j - i), np.diff(offset[i : j + 1]))
                for k in range(lo, hi, 20_000):
                    m = min(k + 20_000, hi)
                    base = off[:-1][row[k - lo : m - lo]]
                    data = [buf[x:y].tobytes() for x, y in zip((s[k:m] + base).tolist(), (e[k:m] + base).tolist(), strict=True)]
                    own, at, full = found.slice(k, m - k), pa.array(i + row[k - lo : m - lo]), np.zeros(m - k, np.int32)
                    columns = [own.field("a"), b.column("d").take(at), b.column("t").take(at), own.field("s"), own.field("q"), own.field("need"), pa.array(full), pa.array(full + (span - gram)), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    by_doc = wanted.groupBy("d", "t").agg(F.collect_list(F.struct("a", "s", "e", "q", "need")).alias("found"))  # of one text: bounded by its length
    return keyed(docs).join(by_doc.hint("merge"), ["d", "t"]).select("d", "t", "text", "found").mapInArrow(run, BODIES)


def _halved(bodies: DataFrame, span: int) -> DataFrame:
    """The windows of segments in each half of their range of distances, as segments (h: their hash) with the half's common bytes as anchor hash."""
    names = ["h", *(x.split()[0] for x in BODIES.split(", "))]

    def run(batches):
        for b in batches:
            a, d, t, s, q, need, low, high = (b.column(c).to_numpy(zero_copy_only=False) for c in names[1:-1])
            q, low, high = q.astype(np.int64), low.astype(np.int64), high.astype(np.int64)
            for i, j, buf, off in pieces(b.column("body")):
                prefix, own = prefix_hashes(buf), slice(i, j)
                middle = (low[own] + high[own]) >> 1
                for lo, hi in ((low[own], middle), (middle + 1, high[own])):
                    near, far = np.maximum(lo, span - (np.diff(off) - q[own])), np.minimum(hi, q[own])  # distances that the segment has
                    at = np.flatnonzero((lo <= hi) & (near <= far))
                    lo, hi, near, far, row, anchor = lo[at], hi[at], near[at], far[at], i + at, off[at] + q[i + at]
                    start, end = anchor - far, anchor - near + span
                    key = mix(a[row].view(U64) ^ mix(span_hashes(prefix, anchor - lo, anchor - hi + span) + mix((lo << 32 | hi).astype(U64))))
                    h = mix(span_hashes(prefix, start, end) ^ mix((end - start).astype(U64)))
                    data = [buf[x:y].tobytes() for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                    out = [h.view(np.int64), key.view(np.int64), d[row], t[row], s[row] + start - off[at], far.astype(np.int32), need[row], lo.astype(np.int32), hi.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(data, pa.binary())], names)

    return bodies.mapInArrow(run, "h long, " + BODIES)


def _settled(bodies: DataFrame, span: int, gram: int) -> DataFrame:
    """(d, t, s, e) to remove, from segments that meet by anchor."""
    most = 3 << 20

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def done(table: pa.Table):
            col = lambda c: table.column(c).to_numpy()
            body = table.column("body").combine_chunks().cast(pa.large_binary())
            _, _, buf, off = next(pieces(body, 1 << 62))
            q, s = col("q").astype(np.int64), col("s")
            far, near = repeated(col("a"), buf, off, q, span, gram)
            at = np.flatnonzero((far >= 0) & col("need"))
            return pa.RecordBatch.from_arrays([pa.array(col("d")[at]), pa.array(col("t")[at]), pa.array(s[at] + q[at] - far[at]), pa.array(s[at] + q[at] - near[at] + span)], ["d", "t", "s", "e"])

        for batch in batches:
            for i in range(0, batch.num_rows, 4000):
                held.append(batch.slice(i, 4000))
                size += held[-1].nbytes
                if size < most:
                    continue
                table = pa.Table.from_batches(held)
                cut = int(np.searchsorted(table.column("a").to_numpy(), table.column("a")[-1].as_py()))  # the last group may go on
                if cut:
                    yield done(table.slice(0, cut))
                    held, size = table.slice(cut).to_batches(), 0
        if held and sum(x.num_rows for x in held):
            yield done(pa.Table.from_batches(held))

    return bodies.select("a", "d", "t", "s", "q", "need", "body").repartition("a").sortWithinPartitions("a").mapInArrow(run, "d long, t int, s long, e long")


def repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(d, t, s, e): byte ranges of the rows' texts (see keyed), possibly overlapping, that together are all repeated bytes."""
    found = written(segments(docs, span, gram), "suffix-segments")
    anchors = found.groupBy("a").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).where("n > 1")
    anchors = written(anchors, "suffix-anchors")  # a plain exchange, so that a frequent anchor can be split in the join
    shared = written(found.join(anchors.select("a", (F.col("low") != F.col("high")).alias("mixed")).hint("merge"), "a"), "suffix-shared")
    out = shared.where("not mixed").select("d", "t", "s", "e")
    mixed = shared.where("mixed")
    kinds = written(mixed.groupBy("a", "h").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "s", "e", "q")).alias("x")), "suffix-kinds")
    out = out.unionByName(mixed.join(kinds.where("n > 1").select("a", "h"), ["a", "h"]).select("d", "t", "s", "e"))
    bodies = written(_with_bytes(docs, kinds.select("a", "x.*", (F.col("n") == 1).alias("need")), span, gram), "suffix-bodies")
    while True:
        large = written(bodies.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > group).select("a"), "suffix-large")
        n = large.count()
        if not n:
            return out.unionByName(_settled(bodies, span, gram))
        if n <= FEW:
            large = F.broadcast(large)
        out = out.unionByName(written(_settled(bodies.join(large, "a", "left_anti"), span, gram), "suffix-found"))
        halves = written(_halved(bodies.join(large, "a", "left_semi"), span), "suffix-halves")
        kinds = halves.groupBy("a", "h").agg(F.count("*").alias("n"), F.min_by(F.struct(*(c for c in bodies.columns if c != "a")), F.struct("d", "t", "s")).alias("x"))
        kinds = written(kinds, "suffix-half-kinds")
        again = halves.where("need").join(kinds.where("n > 1").select("a", "h"), ["a", "h"])
        out = out.unionByName(again.select("d", "t", "s", (F.col("s") + F.length("body")).alias("e")))
        bodies = kinds.select("a", "x.*", "n").withColumn("need", F.col("need") & (F.col("n") == 1)).select(*bodies.columns)


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte ranges, merged and in order, and the bytes that are left."""
    ranges = written(repeats(docs, span, gram, group), "suffix-ranges")
    by_doc = ranges.groupBy("d", "t").agg(F.collect_set(F.struct("s", "e")).alias("found"))  # of one text: bounded by its length

    def run(batches):
        for b in batches:
            found = b.column("found")
            for i, j, buf, off in pieces(b.column("text")):
                spans, kept = [], []
                for r in range(i, j):
                    body, own = buf[off[r - i] : off[r - i + 1]], found[r]
                    out, parts, last = [], [], 0
                    if own.is_valid and len(own.values):
                        s, e = own.values.field("s").to_numpy(), own.values.field("e").to_numpy()
                        order = np.argsort(s, kind="stable")
                        s, e = s[order], np.maximum.accumulate(e[order])
                        cut = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
                        for x, y in zip(s[cut].tolist(), e[np.r_[cut[1:] - 1, len(e) - 1]].tolist(), strict=True):
                            out.append({"start": x, "end": y})
                            parts.append(body[last:x].tobytes())
                            last = y
                    kept.append(b"".join([*parts, body[last:].tobytes()]))
                    spans.append(out)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(np.diff(off)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"]
                )

    rows = keyed(docs).join(by_doc.hint("merge"), ["d", "t"], "left").select("doc_id", "text", "found")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
