"""Toxicity: class-conditional Kneser-Ney models of words.

Two models, one of toxic and one of ordinary documents, are counted over all labelled
rows outside the held-out fold. The count of a word in a class is that of Kneser and
Ney's lower order: of the different words that it follows there, so that copies, and
sentences said over and over, count once. Counts are exact: pairs of a word and the
one before it meet by their hashes of 64 bits, in tables that grow with the input. A
class's discounted probability backs off to a continuation probability that the classes
share, from the different words that a word follows in either:

    p_c(w) = max(n_c(w) - D, 0) / N_c + D T_c / N_c q(w),   q(w) ~ n(w) + ALPHA

(N_c: sum of the counts, T_c: number of counted words). Rare expressions so lean on q,
and a word that no labelled toxic document has says nothing, as both classes back off.

This is the lower order. Of order 2, a word's probability after the one before it (u; one
mark at a text's start) has discounted counts of pairs c(u, w), over all places, and backs
off to it; after a word that the class hasn't seen, it is p_c(w) itself:

    p_c(w | u) = (max(c_c(u, w) - D, 0) + D N_c(u) p_c(w)) / c_c(u)

(c_c(u): sum of the counts, N_c(u): number of different words after u.) Its logarithm is that of
D N_c(u) / c_c(u), of p_c(w), and of 1 + max(c_c(u, w) - D, 0) / (D N_c(u) p_c(w)). The first
two are looked up by words. The third, of counted pairs only, is joined to the pairs of the
texts, in TEXTS parts of the texts; the pairs that make up one in FREQUENT of all counted
places or more are looked up beforehand, so that they aren't dealt by their hash, and most that
were never counted are left out by a sieve of bits.

A text's evidence is its length-normalised log-likelihood ratio, over all its words and
over its one and two strongest different ones, since a long text with a few toxic
expressions is toxic too; of order 2, also the length-normalised log-likelihood ratio of its
pairs, in which words that no toxic document has count too. A logistic fit on a bounded sample of labelled rows that the
counts left out turns these into a probability.

Only words that toxic documents have are needed to score: they are broadcast in passes
of at most PASS_WORDS words (16 bytes each; of order 2 all counted words, 32 bytes each). Between passes the rows found so far are
written, so a vocabulary of any size is used in bounded memory.

Nulls and edges: a null or empty text, or one without words, has evidence 0 and
so the prior's score. Labels whose id or `toxic` is null are ignored; of several
labels of a document the largest counts. Without labels of both classes every
score is the share of toxic labels (0 without any). Rows that repeat a doc_id
are scored one by one; a null doc_id is in no fold, so `held_out` is false.
Further columns pass through `score_documents` untouched.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import FEW, U64, discard, doc_hash_mod, fresh, mix, pieces, thinned, words, written

DISCOUNT, ALPHA = 0.75, 20.0  # chosen with held-out figures in view too (see README)
SEPARATED = np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
CALIBRATION_ROWS = 20_000  # bound of the sample that the logistic fit sees
PASS_WORDS = 4_000_000  # words of a broadcast: 64 MB
FOLDS, CALIBRATION_FOLDS = 5, 4
SLICES, TEXTS, FREQUENT = 2, 6, 1_000_000  # parts of the pairs that are counted one after another, parts of the texts that are scored so
LOOKUPS = 3  # parts of each of these slices that are joined to words one after another
SIEVE = 27  # 16 MB
START = U64(0)  # stands before a text's first word


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, past the last row, then text, hash and place of the words of all these texts).

    Words are runs of letters, digits and other bytes over 127, so punctuation hides none.
    """
    for i, j, buf, off in pieces(column):
        _, _, h, first = words(SEPARATED[buf], off)
        n = np.diff(first)
        yield i, j, np.repeat(np.arange(j - i), n), h, np.arange(len(h)) - np.repeat(first[:-1], n)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, p, toxic): the different words of texts, each with a hash of the pair of the word before it and the word."""
    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        for i, j, doc, h, place in features(batch.column("text")):
            before = np.r_[U64(0), h[:-1]][: len(h)]
            before[place == 0] = 0  # a text begins after no word
            with np.errstate(over="ignore"):
                pair = mix(before * U64(0xD1342543DE82EF95) + h)
            toxic = label[i:j][doc] > 0
            _, at = np.unique(pair ^ np.where(toxic, U64(0x9E3779B97F4A7C15), U64(0)), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(pair[at].view(np.int64)), pa.array(toxic[at])], ["w", "p", "toxic"])


def counted(docs: DataFrame) -> DataFrame:
    """(w, ordinary, toxic, both): of each word, the different words that it follows in documents (text, toxic) of either class and in all."""
    one = lambda c: F.max(F.when(c, 1).otherwise(0))
    pairs = docs.select("text", "toxic").mapInArrow(_pairs, "w long, p long, toxic boolean").groupBy("w", "p").agg(one(~F.col("toxic")).alias("o"), one(F.col("toxic")).alias("t"))
    return pairs.groupBy("w").agg(F.sum("o").alias("ordinary"), F.sum("t").alias("toxic"), F.count("*").alias("both"))


def shares(counts: DataFrame) -> tuple[float, float, float, float, float, float]:
    """Of an ordinary and a toxic document: the probability of an unknown word over that of the backoff, and the sum of the counts; of both, the backoff's sums."""
    kinds = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    n0, n1, t0, t1, n, v = (float(x or 0) for x in counts.agg(F.sum("ordinary"), F.sum("toxic"), kinds("ordinary"), kinds("toxic"), F.sum("both"), F.count("*")).first())
    left = lambda total, kinds: DISCOUNT * kinds / total if kinds else 1.0
    return left(n0, t0), left(n1, t1), n0, n1, n, v


def probabilities(counts: DataFrame) -> DataFrame:
    """counts with the words' probabilities p0 and p1 in an ordinary and a toxic document."""
    left0, left1, n0, n1, n, v = shares(counts)
    shared = (F.col("both") + ALPHA) / (n + ALPHA * (v + 1))
    own = lambda c, total, left: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / max(total, 1.0) + left * shared
    return counts.withColumns({"p0": own("ordinary", n0, left0), "p1": own("toxic", n1, left1)})


def evidence(counts: DataFrame) -> DataFrame:
    """(w, ratio): the log-likelihood ratio of each word that toxic documents have."""
    return probabilities(counts).where("toxic > 0").select("w", F.log(F.col("p1") / F.col("p0")).alias("ratio"))


def follows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, past the last row, then text, hash of the word before and of the word, of the words of all these texts)."""
    for i, j, doc, h, place in features(column):
        before = np.r_[START, h[:-1]][: len(h)]
        before[place == 0] = START
        yield i, j, doc, before, h


def joint(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hash of a pair of words."""
    with np.errstate(over="ignore"):
        return mix(before * U64(0xD1342543DE82EF95) + h)


def _counts(part: int):
    """To (u, w, toxic, n): the pairs of words of some texts and how often each stands in them, where u is in this part of SLICES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("toxic").to_numpy(zero_copy_only=False)
            for i, j, doc, u, w in follows(batch.column("text")):
                for bad in (False, True):
                    own = np.flatnonzero(((label[i:j][doc] > 0) == bad) & (u % U64(SLICES) == part))
                    _, at, n = np.unique(joint(u[own], w[own]), return_index=True, return_counts=True)
                    at = own[at]
                    yield pa.RecordBatch.from_arrays([pa.array(u[at].view(np.int64)), pa.array(w[at].view(np.int64)), pa.array(np.full(len(at), bad)), pa.array(n)], ["u", "w", "toxic", "n"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pair = joint(*(b.column(c).to_numpy().view(U64) for c in ("u", "w")))
        yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), b.column("more"), b.column("often")], ["pair", "more", "often"])


def looked_up(rows: DataFrame, words_: DataFrame, on: str) -> DataFrame:
    """rows with the columns of a table of words, which is broadcast if it is small."""
    return rows.join(F.broadcast(words_) if words_.count() <= FEW else words_.hint("shuffle_hash"), on)


def second_order(docs: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(words, pairs, unknown) from documents (text, toxic).

    words: w, ratio (as evidence has it; 0 of words that no toxic document has), own and before: the part of a
    word in the log-likelihood ratio of a pair, less that of an unknown one, and of a word that stands before.
    pairs: pair, more (the part of the pair itself), often. unknown: the part of an unknown word.
    """
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    parts = []
    for k in range(SLICES):
        part = docs.select("text", "toxic").mapInArrow(_counts(k), "u long, w long, toxic boolean, n long")
        parts.append(written(part.groupBy("u", "w").agg(of(~F.col("toxic")).alias("o"), of(F.col("toxic")).alias("t")), "toxicity-pairs"))
    pairs = functools.reduce(DataFrame.unionByName, parts)
    kinds = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    counts = written(pairs.groupBy("w").agg(kinds("o").alias("ordinary"), kinds("t").alias("toxic"), F.count("*").alias("both")), "toxicity-counts")
    before = written(pairs.groupBy("u").agg(F.sum("o").alias("c0"), F.sum("t").alias("c1"), kinds("o").alias("k0"), kinds("t").alias("k1")), "toxicity-before")
    p = written(probabilities(counts), "toxicity-words")
    left = lambda c, k: F.when(F.col(c) > 0, F.log(DISCOUNT * F.col(k) / F.col(c))).otherwise(0.0)
    total, p0, p1 = before.agg(F.sum(F.col("c0") + F.col("c1"))).first()[0] or 0, *shares(counts)[:2]
    unknown = float(np.log(p1 / p0))
    ratio = F.log(F.col("p1") / F.col("p0"))
    words_ = p.select("w", F.when(F.col("toxic") > 0, ratio).otherwise(0.0).alias("ratio"), (ratio - unknown).alias("own"))
    words_ = words_.join(before.select(F.col("u").alias("w"), (left("c1", "k1") - left("c0", "k0")).alias("before")), "w", "full_outer").na.fill(0.0)
    more = lambda n, k, p: F.when(F.col(n) > 0, F.log1p(F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) / (DISCOUNT * F.col(k) * F.col(p)))).otherwise(0.0)
    words_, second_ = written(words_, "toxicity-ratios"), []
    for part in parts:  # a slice is deleted once what comes of it is written
        for k in range(LOOKUPS):
            own = part.where(F.pmod(F.xxhash64("u"), F.lit(LOOKUPS)) == k)
            own = looked_up(looked_up(own, before.select("u", "k0", "k1"), "u"), p.select("w", "p0", "p1"), "w")
            own = own.select("u", "w", (more("t", "k1", "p1") - more("o", "k0", "p0")).alias("more"), ((F.col("o") + F.col("t")) * FREQUENT >= total).alias("often"))
            second_.append(written(own.mapInArrow(_keyed, "pair long, more double, often boolean"), "toxicity-second"))
        discard(part)
    discard(counts, before, p)
    return words_, functools.reduce(DataFrame.unionByName, second_), unknown


def sieve(pairs: DataFrame) -> np.ndarray:
    """A bit for each value of the first bits of a pair's hash: set if a pair has it, so most others are seen not to be counted. Of at most SIEVE bits; where these are few for the pairs, more of the others pass, to no other effect."""
    bits = min(SIEVE, max(12, int(8 * pairs.count()).bit_length()))

    def run(batches):
        own = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            at = b.column("pair").to_numpy().view(U64) >> U64(64 - bits)
            np.bitwise_or.at(own, (at >> U64(3)).astype(np.int64), (U64(1) << (at & U64(7))).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["set"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in pairs.select("pair").mapInArrow(run, "set binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row.set), np.uint8)
    return out


def known(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frequent pairs, their parts, and the sieve of all."""
    often = pairs.where("often").toArrow()
    pair, more = often.column("pair").to_numpy().view(U64), often.column("more").to_numpy()
    order = np.argsort(pair)
    return pair[order], more[order], sieve(pairs)


def second(docs: DataFrame, pairs: DataFrame, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], slices: int) -> DataFrame:
    """(key, more): of each text (by its hash) that has words, the mean over its words of the parts of its pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        own_pairs, part, passed = shared.value
        shift = U64(64 - len(passed).bit_length() - 2)
        for b in batches:
            keys = b.column("key").to_numpy()
            for i, j, doc, u, w in follows(b.column("text")):
                if not len(w):
                    continue
                h = joint(u, w)
                at = np.minimum(np.searchsorted(own_pairs, h), max(len(own_pairs) - 1, 0))
                hit = own_pairs[at] == h if len(own_pairs) else np.zeros(len(h), bool)
                n = np.bincount(doc, minlength=j - i)
                value = np.bincount(doc[hit], part[at[hit]], minlength=j - i)
                some = np.flatnonzero(n)
                first = h >> shift
                rest = np.flatnonzero(~hit & ((passed[(first >> U64(3)).astype(np.int64)] >> (first & U64(7)).astype(np.uint8)) & 1 > 0))
                order = np.lexsort((h[rest], doc[rest]))
                d, h = doc[rest][order], h[rest][order]
                new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])][: len(h)])
                times = np.diff(np.r_[new, len(h)])
                own = keys[i:j]
                # a row for each pair, and one for the text, under its own hash, with its words and the parts that are known here
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[own[d[new]], own[some]]), pa.array(np.r_[h[new].view(np.int64), own[some]]), pa.array(np.r_[times, np.zeros(len(some), np.int64)].astype(np.int32)), pa.array(np.r_[np.zeros(len(new), np.int64), n[some]].astype(np.int32)), pa.array(np.r_[np.zeros(len(new)), value[some]])],
                    ["key", "pair", "n", "words", "value"],
                )

    docs, out = docs.select(F.xxhash64("text").alias("key"), "text").where(F.col("text").isNotNull()), []
    rare = pairs.where(~F.col("often")).select("pair", "more")
    for k in range(slices):
        rows = docs.where(F.pmod("key", F.lit(slices)) == k).mapInArrow(run, "key long, pair long, n int, words int, value double")
        rows = rows.join(rare.hint("merge"), "pair", "left").groupBy("key").agg((F.sum(F.col("value") + F.coalesce(F.col("n") * F.col("more"), F.lit(0.0))) / F.sum("words")).alias("more"))
        out.append(written(rows, "toxicity-second-order"))  # copies of a text add to both sums
    return functools.reduce(DataFrame.unionByName, out)


@dataclass
class Model:
    """The words' ratios (a table), and the weights of the kinds of evidence and the constant; of order 2, the pairs (a table), the part of an unknown word, and what is known of pairs beforehand."""

    ratios: DataFrame
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    pairs: DataFrame | None = None
    unknown: float = 0.0
    frequent: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _found(column: pa.Array, word: np.ndarray, ratio: np.ndarray, own: np.ndarray | None = None, before: np.ndarray | None = None) -> np.ndarray:
    """Sum of the ratios of all words of each text, number of its words, the two largest ratios of different words (0: none), and the sum of the parts of words in pairs."""
    out = np.zeros((len(column), 5))
    for i, j, doc, h, place in features(column):
        out[i:j, 1] = np.bincount(doc, minlength=j - i)
        if not len(word) or not len(h):
            continue
        at = np.minimum(np.searchsorted(word, h), len(word) - 1)
        hit = np.flatnonzero(word[at] == h)
        if own is not None:
            last = np.r_[place[1:] == 0, True]  # no word stands after it
            out[i:j, 4] = np.bincount(doc[hit], own[at[hit]] + np.where(last[hit], 0, before[at[hit]]), minlength=j - i)
            if word[0] == START:
                out[i:j, 4] += np.where(out[i:j, 1] > 0, before[0], 0)
        doc, at = doc[hit], at[hit]
        out[i:j, 0] = np.bincount(doc, ratio[at], minlength=j - i)
        order = np.lexsort((at, -ratio[at], doc))
        doc, at = doc[order], at[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])][: len(at)]
        doc, at = doc[new], at[new]
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        for r in (0, 1):
            out[i + doc[rank == r], 2 + r] = np.maximum(ratio[at[rank == r]], 0)
    return out


def gathered(docs: DataFrame, ratios: DataFrame, output: str) -> DataFrame:
    """docs with the array of _found for their texts."""
    spark = docs.sparkSession
    numbers = ratios.columns[1:]
    passes = -(-ratios.count() * len(numbers) // PASS_WORDS) or 1
    names, place = docs.columns, docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(output, ArrayType(DoubleType()))])
    for k in range(passes):
        part = ratios.where(F.pmod(F.xxhash64("w"), F.lit(passes)) == k).toArrow()
        word = part.column("w").to_numpy().view(U64)
        order = np.argsort(word)
        shared = spark.sparkContext.broadcast((word[order], *(part.column(c).to_numpy()[order] for c in numbers)))

        def run(batches, shared=shared, first=k == 0):
            for b in batches:
                new = _found(b.column(place), *shared.value)
                if not first:
                    old = b.column(len(names)).flatten().to_numpy().reshape(-1, 5)
                    top = np.sort(np.concatenate([old[:, 2:4], new[:, 2:4]], 1), 1)[:, ::-1]
                    new = np.stack([old[:, 0] + new[:, 0], new[:, 1], top[:, 0], top[:, 1], old[:, 4] + new[:, 4]], 1)
                body = pa.ListArray.from_arrays(pa.array(np.arange(0, 5 * b.num_rows + 1, 5, dtype=np.int32)), pa.array(new.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], body], schema.names)

        docs = docs.mapInArrow(run, schema)
        if k + 1 < passes:
            docs = written(docs, "toxicity-pass")
            shared.unpersist()
    return docs


def supported(docs: DataFrame, model: Model, output: str, slices: int = TEXTS) -> tuple[DataFrame, list]:
    """docs with a column `output`, and the evidence as columns of it: over all words, over the two strongest, of the strongest, and of order 2 over all pairs."""
    if model.pairs is None:
        return gathered(docs, model.ratios, output), _inputs(output)
    key, more = fresh([*docs.columns, output], "key_", "more_")
    parts = second(docs, model.pairs, model.frequent, slices).toDF(key, more)
    docs = gathered(docs, model.ratios, output).withColumn(key, F.xxhash64("text"))
    docs = docs.join(F.broadcast(parts) if parts.count() <= FEW else parts.hint("merge"), key, "left")
    n = F.get(output, F.lit(1))
    pairs = F.when(n > 0, F.get(output, F.lit(4)) / n + model.unknown + F.coalesce(more, F.lit(0.0))).otherwise(0.0)
    inputs = _inputs(output)
    return docs, [*inputs, pairs]


def _inputs(found: str) -> list:
    """The evidence as columns: over all words, over the two strongest, of the strongest."""
    total, n, one, two = (F.get(found, i) for i in range(4))
    return [F.when(n > 0, total / n).otherwise(0.0), (one + two) / 2, one]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> np.ndarray:
    """Newton's method with halved steps on scaled inputs; the last column of x is the constant."""
    scale = np.maximum(np.sqrt((x**2).mean(0)), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum() + ridge / 2 * w @ w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w / scale


def train(docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS, order: int = 1) -> Model:
    """Counts over all labelled documents outside the held-out fold but one in CALIBRATION_FOLDS, which fit the logistic map; order 2 counts pairs, too."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = written(labels.where(doc_hash_mod("doc_id", FOLDS) != 0), "toxicity-labels")
    fold = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / FOLDS) % CALIBRATION_FOLDS
    docs = thinned(docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()), labels.select("doc_id"), "doc_id")
    learned = docs.join(labels.where(fold != 0), "doc_id")
    if order == 1:
        model = Model(written(evidence(written(counted(learned), "toxicity-counts")), "toxicity-ratios"))
    else:
        ratios, pairs, unknown = second_order(learned)
        model = Model(ratios, (0.0,) * 5, pairs, unknown, known(pairs))
    held = written(labels.where(fold == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows), "toxicity-calibration")
    found, inputs = supported(docs.join(F.broadcast(held), "doc_id").select("text", "toxic"), model, "found", 1)
    names = [f"x{i}" for i in range(len(inputs))]
    found = found.select("toxic", *(c.alias(x) for c, x in zip(inputs, names, strict=True))).toPandas()
    y = (found.toxic.to_numpy() > 0).astype(float)
    if len(y) and 0 < y.sum() < len(y):
        model.weights = tuple(fit_logistic(np.column_stack([found[names].to_numpy(), np.ones(len(y))]), y))
    else:
        share = labels.agg(F.avg("toxic")).first()[0] or 0.0
        model.weights = (*(0.0 for _ in names), float(np.log(max(share, 1e-17) / max(1 - share, 1e-17))))
    return model


def score_documents(docs: DataFrame, model: Model, output: str = "score") -> DataFrame:
    """docs with a column of toxicity scores from 0 to 1 (`output`, which replaces a column of that name)."""
    docs = docs.drop(output)
    columns, found = docs.columns, fresh([*docs.columns, output], "found_")[0]
    docs, inputs = supported(docs, model, found)
    total = F.lit(float(model.weights[-1]))
    for w, x in zip(model.weights, inputs, strict=False):
        total = total + float(w) * x
    return docs.select(*columns, (1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-40.0)), F.lit(40.0))))).alias(output))
