"""Language identification: a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of 2, 3 and 4 bytes slide over windows of WINDOW bytes,
each filter's largest response is rectified, and a softmax layer gives the
languages. A document's prediction is the mean of its windows' log-probabilities,
weighted by their letters; all windows of the whole text count.

The network learns from a bounded sample: at most SAMPLE_DOCS documents of each
language (the first in a hash order of the id) and SAMPLE_WINDOWS windows of each,
evenly spread over the text.

Nulls and edges: a null text, or one without a letter, is `und` with score 0.
Documents with a null language or id are never learned from; without any labelled
text everything is `und`. Rows are judged one by one; further columns pass through
and columns of the new names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import FEW, pieces, written

WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
SAMPLE_DOCS, SAMPLE_WINDOWS = 800, 3
EPOCHS, BATCH, RATE = 8, 64, 4e-3
DEEP = max(WIDTHS)
#: letters in lower case and all bytes over 127 stay, everything else is a space
PLAIN = np.array([b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)
LETTER = np.array([b > 127 or 97 <= b <= 122 for b in range(256)])


def windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each window, its bytes): all bytes of each text in runs of WINDOW, the last one filled up with spaces."""
    n = -(-np.diff(off) // WINDOW)
    doc = np.repeat(np.arange(len(n)), n)
    start = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    inside = at < off[doc + 1][:, None]
    return doc, np.where(inside, PLAIN[buf[np.where(inside, at, 0)]] if len(buf) else 32, 32).astype(np.uint8)


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        total = FILTERS * len(WIDTHS)
        self.mask = np.zeros((DEEP, 1, total), np.float32)
        for i, width in enumerate(WIDTHS):
            self.mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.conv = (rng.normal(0, 0.3, (DEEP, EMBED, total)) * self.mask).astype(np.float32)
        self.bias = np.zeros(total, np.float32)
        self.out = rng.normal(0, 0.1, (total, len(languages))).astype(np.float32)
        self.shift = np.zeros(len(languages), np.float32)

    def columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, DEEP * EMBED): the embedded bytes under the filters at each position."""
        e = self.embed[x]
        n, steps = len(x), WINDOW - DEEP + 1
        view = np.lib.stride_tricks.as_strided(e, (n, steps, DEEP * EMBED), (e.strides[0], e.strides[1], e.strides[2]), writeable=False)
        return np.ascontiguousarray(view)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        kernel = self.conv.reshape(DEEP * EMBED, -1)
        for i in range(0, len(x), 64):
            c = self.columns(x[i : i + 64])
            top = (c.reshape(-1, DEEP * EMBED) @ kernel).reshape(len(c), -1, kernel.shape[1]).max(1)
            out[i : i + 64] = np.maximum(top + self.bias, 0) @ self.out + self.shift
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        c = self.columns(x)
        kernel = self.conv.reshape(DEEP * EMBED, -1)
        r = (c.reshape(-1, DEEP * EMBED) @ kernel).reshape(len(x), -1, kernel.shape[1])
        at = r.argmax(1)
        top = np.take_along_axis(r, at[:, None], 1)[:, 0] + self.bias
        a = np.maximum(top, 0)
        z = a @ self.out + self.shift
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        d = (p @ self.out.T) * (top > 0)
        under = c[np.arange(len(x))[:, None], at]  # (windows, filters, DEEP * EMBED)
        conv = np.einsum("nf,nfe->ef", d, under).reshape(self.conv.shape) * self.mask
        back = (d[:, :, None] * kernel.T).reshape(len(x), -1, DEEP, EMBED)
        embed = np.zeros_like(self.embed)
        np.add.at(embed, x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(DEEP)], back)
        return [embed, conv, d.sum(0), a.T @ p, p.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
        """Adam on cross-entropy."""
        rng = np.random.default_rng(seed)
        weights = [self.embed, self.conv, self.bias, self.out, self.shift]
        m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                t += 1
                rate = RATE * (1 - 0.9 * epoch / epochs)
                for k, g in enumerate(self.gradients(x[order[i : i + BATCH]], y[order[i : i + BATCH]])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    weights[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, probability) of each text."""
        names, score = [], np.zeros(len(column))
        for i, j, buf, off in pieces(column, 1 << 19):
            doc, x = windows(buf, off)
            weight = LETTER[x].sum(1).astype(np.float64)
            total = np.bincount(doc, weight, minlength=j - i)
            mean = np.zeros((j - i, len(self.languages)))
            if self.languages and len(x):
                z = self.logits(x).astype(np.float64)
                z -= np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) + z.max(1, keepdims=True)
                for c in range(len(self.languages)):
                    mean[:, c] = np.bincount(doc, z[:, c] * weight, minlength=j - i) / np.maximum(total, 1)
            for r in range(j - i):
                text = None if total[r] == 0 else column[i + r].as_py() if not ((buf[off[r] : off[r + 1]] | 32) - 97 < 26).any() else "a"
                if not self.languages or text is None or not any(ch.isalpha() for ch in text):
                    names.append("und")
                    continue
                p = np.exp(mean[r] - mean[r].max())
                names.append(self.languages[int(p.argmax())])
                score[i + r] = p.max() / p.sum()
        return names, score


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network:
    """The network for the languages of docs (doc_id, text, lang), from the bounded sample."""
    labelled = docs.where("lang is not null and doc_id is not null and text is not null")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # most rows of a frequent language go before the sort: about four times the sample stay, so one language never fills a task
    sizes = written(labelled.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_rows")), "language-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= FEW else sizes  # thinned where the rows are, before they are dealt by language
    part = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) * F.col("_rows") < F.lit((1 << 22) * sample_docs)
    thinned = labelled.select("doc_id", "lang").join(sizes, F.col("lang") == F.col("_lang")).where(part)
    chosen = thinned.select("doc_id", "lang").withColumn("_place", place).where(F.col("_place") <= sample_docs).select("doc_id", "lang")

    def cut(batches):
        for b in batches:
            langs = b.column("lang").to_pylist()
            for i, j, buf, off in pieces(b.column("text")):
                doc, x = windows(buf, off)
                n = np.bincount(doc, minlength=j - i)
                rank = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                own = np.repeat(n, n)
                keep = (LETTER[x].sum(1) >= 20) & ((own <= SAMPLE_WINDOWS) | (rank * SAMPLE_WINDOWS // own != (rank - 1) * SAMPLE_WINDOWS // own))
                yield pa.RecordBatch.from_arrays([pa.array([langs[i + d] for d in doc[keep]], pa.string()), pa.array([w.tobytes() for w in x[keep]], pa.binary())], ["lang", "window"])

    # a bounded number of rows: sample_docs a language
    found = labelled.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("lang", "text").mapInArrow(cut, "lang string, window binary").toArrow().sort_by([("lang", "ascending"), ("window", "ascending")])
    langs = found.column("lang").to_pylist()
    names = sorted(set(langs))
    if not names:
        return Network([])
    x = np.frombuffer(b"".join(found.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return Network(names).train(x, np.array([names.index(v) for v in langs]))


def identify(docs: DataFrame, network: Network, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(network)
    docs = docs.drop(lang, score)
    schema = StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])

    def run(batches):
        for b in batches:
            names, p = shared.value.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(p)], schema.names)

    return docs.mapInArrow(run, schema)
