import numpy as np
import pyarrow as pa

from siftwright.llm import common as C


def test_words_and_shingles(corpus, words):
    column = pa.array([t for _, t in corpus])
    got = []
    for i, j, buf, off in C.pieces(column, 5000):
        start, end, h, first = C.words(buf, off)
        low = C.LOWER[buf].tobytes()
        for r in range(j - i):
            own = [low[s:e].decode() for s, e in zip(start[first[r] : first[r + 1]], end[first[r] : first[r + 1]], strict=True)]
            got.append(own)
        doc, s = C.distinct(*C.shingles(h, first, 5))
        for r in range(j - i):
            w = got[i + r]
            want = len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0
            assert (doc == r).sum() == want
    assert got == [words(t) for _, t in corpus]


def test_span_hashes_do_not_depend_on_place():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 256, 50, dtype=np.uint8)
    buf = np.concatenate([body, rng.integers(0, 256, 999, dtype=np.uint8), body])
    p = C.prefix_hashes(buf)
    a, b = C.span_hashes(p, np.array([0]), np.array([50])), C.span_hashes(p, np.array([1049]), np.array([1099]))
    assert a == b


def test_empty_column():
    assert list(C.pieces(pa.array([], pa.string()))) == []
    assert [x[:2] for x in C.pieces(pa.array([None, ""]))] == [(0, 2)]
