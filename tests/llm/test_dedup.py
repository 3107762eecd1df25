"""op2, op5 and op9 against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.llm import near_dup, passages, suffixes


def sets_of(corpus, words):
    out = {}
    for i, t in corpus:
        w = words(t)
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("block", [1500, 5])
def test_near_dup(spark, docs, corpus, words, block, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", block)
    monkeypatch.setattr(near_dup, "STAR_DOCS", block)
    s = sets_of(corpus, words)
    links = [(a, b) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    want = roots(s, links)
    got = near_dup.cluster(docs).collect()
    assert len(got) == len(corpus) + 2
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(s[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, *sorted(i for i in s if want[i] == i)]


def test_large_group_of_near_copies(spark, prose):
    """A chain of variants, each linked to its neighbour only, is one component, over many blocks."""
    import random

    rng = random.Random(3)
    w, rows = prose(rng, 200).split(" "), []
    for i in range(120):
        rows.append((i, " ".join(w)))
        w[(i * 7) % 200] = f"v{i}"
    out = near_dup.cluster(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where("component_id <> 0").count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for share in (0.95, 0.85, 0.5):
        other = base.copy()
        n = int(400 * (1 - share) / (1 + share) * 1)
        other[:n] = rng.integers(0, 2**63, n, dtype=np.uint64)
        true = (400 - n) / (400 + n)
        sample = [near_dup.samples(np.zeros(400, np.int64), np.sort(x), 1) for x in (base, other)]
        bits = np.bitwise_count(near_dup.odd_sketches(sample[0]) ^ near_dup.odd_sketches(sample[1])).sum()
        assert abs(near_dup.estimate(bits) - true) < 0.15
        assert true < 0.85 or bits <= near_dup.most_bits(0.85)


def brute_repeats(corpus, span):
    text = {i: (t or "").encode() for i, t in corpus}
    seen = defaultdict(int)
    for b in text.values():
        for k in range(len(b) - span + 1):
            seen[b[k : k + span]] += 1
    out = {}
    for i, b in text.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = True
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]) == 1)
        out[i] = (len(b), int(gone.sum()), len(edges), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_repeats_of_rows_with_repeated_and_null_ids(spark, prose):
    import random

    rng = random.Random(31)
    own = [prose(rng, 120) for _ in range(6)]
    passage = prose(rng, 80)[:260]
    rows = [(1, own[0] + passage + own[1]), (1, own[2]), (None, own[3] + passage + own[4]), (2, own[5]), (None, None), (None, ""), (7, own[2][:150])]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    out = sorted((r.doc_id or 0, r.n_bytes, sum(x.end - x.start for x in r.spans)) for r in got)
    assert out == sorted((i or 0, len(t or ""), 260 if t and passage in t else 0) for i, t in rows)


def test_repeats_in_a_long_text(spark, prose, monkeypatch):
    import random

    rng = random.Random(32)
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    p = prose(rng, 90)
    rows = [(1, " ".join([prose(rng, 900), p, prose(rng, 900), p, prose(rng, 100)])), (2, prose(rng, 100)), (3, "q" * 5000)]
    want = brute_repeats(rows, 200)
    doc = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    for buf in doc:  # each window is in one part
        starts = [at + k for at, part, _ in suffixes.parts(buf, np.array([0, len(buf)]), 200) for k in range(len(part) - 199)]
        assert starts == list(range(max(len(buf) - 199, 0)))
    for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r.n_bytes, sum(x.end - x.start for x in r.spans)) == want[r.doc_id][:2]


@pytest.mark.parametrize("group", [4096, 1])
def test_repeats(spark, corpus, group):
    rows = [(i, t) for i, t in corpus] + [(1000, ("ab" * 400)), (1001, "z" * 199), (1002, "y" * 201), (1003, "ba" * 120), (1004, corpus[0][1][:150] + corpus[1][1][20:300] + corpus[2][1])]
    rows += [(2000 + i, f"{'pq' * i}{corpus[6][1][:180]}{i % 7:04d} one {i % 3} more {i % 2}") for i in range(30)]  # one anchor in many contexts
    want = brute_repeats(rows, 200)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), group=group).collect()
    assert len(got) == len(rows)
    for r in got:
        n = sum(x.end - x.start for x in r.spans)
        assert (r.n_bytes, n, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) == want[r.doc_id], r.doc_id


def test_suffix_sort_is_exact_and_survives_collisions(monkeypatch):
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 99, 400, dtype=np.uint8)
    start = np.arange(300)
    length = np.minimum(400 - start, 60)
    group = np.repeat([0, 1, 2], 100)
    begin, size = np.repeat([0, 100, 200], 100), np.full(300, 100)
    sorter = suffixes.Sorter(buf, start, length)
    order = sorter.sort(begin, size)
    text = [buf[s : s + n].tobytes() for s, n in zip(start, length, strict=True)]
    assert [(group[i], text[i]) for i in order] == sorted(zip(group, text, strict=True))
    assert (sorter.extensions(order, group) == sorter.sort_bytes(group)[1]).all()
    monkeypatch.setattr(suffixes, "span_hashes", lambda p, a, b: np.zeros(len(a), np.uint64))  # all hashes collide
    assert suffixes.Sorter(buf, start, length).extensions(order, group) is None


def test_passages_cover_exact_repeats(spark, docs, corpus, words):
    got = {r.doc_id: r for r in passages.deduplicate(docs).collect()}
    w = {i: words(t) for i, t in corpus}
    where = defaultdict(set)
    for i, x in w.items():
        for k in range(len(x) - 49):
            where[tuple(x[k : k + 50])].add(i)
    for i, x in w.items():
        need = {k + n for k in range(len(x) - 49) if len(where[tuple(x[k : k + 50])]) > 1 for n in range(50)}
        have = {n for s in got[i].spans for n in range(s.s, s.e)}
        assert len(need - have) <= 0.02 * len(need), i
        if not any(len(where[tuple(x[k : k + 50])]) > 1 for k in range(len(x) - 49)) and not (i < 20 or 60 <= i < 80):
            assert not have, i
    assert got[None].n_repeated == len(w[5])  # a copy of document 5


def test_fuzzy_passage(spark, prose):
    import random

    rng = random.Random(9)
    p = prose(rng, 90).split(" ")
    q = p.copy()
    for k in (11, 30, 52, 71):
        q[k] = "changed"
    del q[40]
    rows = [(1, prose(rng, 60) + " " + " ".join(p) + " " + prose(rng, 60)), (2, prose(rng, 30) + " " + " ".join(q)), (3, prose(rng, 200))]
    got = {r.doc_id: r for r in passages.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_repeated >= 85 and got[2].n_repeated >= 85 and got[3].n_repeated == 0
    assert got[2].leaders == [1] and got[1].n_links == 1


def test_passages_of_rows_with_repeated_and_null_ids(spark, prose):
    import random

    rng = random.Random(41)
    p, q = prose(rng, 70), prose(rng, 60)
    rows = [(1, f"{prose(rng, 40)} {p}"), (1, prose(rng, 100)), (1, f"{q} {prose(rng, 30)}"), (None, f"{prose(rng, 20)} {p} {prose(rng, 9)}"), (0, f"{prose(rng, 50)} {q}"), (None, None), (None, prose(rng, 60)), (0, f"{prose(rng, 50)}")]
    got = passages.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("i", F.lit("clash"))).collect()
    out = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_repeated > 0) for r in got)
    assert out == sorted((-1 if i is None else i, len((t or "").split()), bool(t) and (p in t or q in t)) for i, t in rows)
    assert all(r.n_links == (r.n_repeated > 0) for r in got)


def edited(rng, words, share):
    gone = set(rng.sample(range(len(words)), round(share * len(words))))
    return [f"e{rng.randrange(10**6)}" if k in gone else w for k, w in enumerate(words)]


@pytest.mark.parametrize("identity", [0.9, 0.85, 0.8])
def test_recall_of_edited_passages(spark, prose, identity):
    """Pairs of 80-word passages, in one of which a share of the words is replaced, in different surroundings."""
    import random

    rng, rows = random.Random(int(identity * 100)), []
    for i in range(60):
        p = prose(rng, 80).split(" ")
        e = edited(rng, p, 1 - identity)
        rows += [(2 * i, " ".join([prose(rng, 60), *p, prose(rng, 60)])), (2 * i + 1, " ".join([prose(rng, 60), *e, prose(rng, 60)]))]
    got = passages.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_repeated >= 40").count() / len(rows) >= 0.9


def test_chaining_is_optimal_under_its_cost():
    x, y = [0, 6, 12, 30, 18], [0, 6, 12, 5, 18]  # seeds of five words
    assert passages.chains(x, y)[0] == [0, 1, 2, 4]


@pytest.mark.parametrize("apart", [35, 60, 400])
def test_passage_after_a_long_one(spark, prose, apart):
    import random

    rng = random.Random(apart)
    one, two = prose(rng, 400), prose(rng, 90).split(" ")
    changed = [w if k % 30 != 29 else "x" for k, w in enumerate(two)]
    rows = [(1, f"{one} {prose(rng, apart)} {' '.join(two)} {prose(rng, 20)}"), (2, f"{prose(rng, 10)} {one} {prose(rng, apart)} {' '.join(changed)}")]
    got = {r.doc_id: r for r in passages.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.n_repeated >= 485 for r in got.values())


def test_chains_reach_past_a_better_scored_end():
    x = [*range(0, 400, 5), *range(460, 550, 6)]
    assert [len(c) for c in passages.chains(x, x)] == [80, 15]


def test_passage_of_lines_with_other_leaders(spark, prose):
    import random

    rng = random.Random(21)
    rows = []
    for g in range(0, 400, 4):
        one, two = prose(rng, 40), prose(rng, 40)
        rows += [(g, f"{prose(rng, 30)} {one} {prose(rng, 30)}"), (g + 1, f"{prose(rng, 30)} {two} {prose(rng, 30)}")]
        rows += [(g + k, f"{prose(rng, 30)} {one} {two} {prose(rng, 30)}") for k in (2, 3)]
    got = {r.doc_id: r.n_repeated for r in passages.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(80 <= n <= 84 if i % 4 > 1 else n == 0 for i, n in got.items())


@pytest.mark.parametrize("hot", [16, 2])
def test_edited_passage_of_seeds_with_other_leaders(spark, prose, hot, monkeypatch):
    """Each line of the passage leads back to a document that has no more of it; few places are listed, more compared in blocks."""
    import random

    monkeypatch.setattr(passages, "HOT", hot, raising=False)
    monkeypatch.setattr(passages, "BLOCK", 2, raising=False)
    rng, rows = random.Random(23), []
    for g in range(0, 240, 6):
        lines = [prose(rng, 16).split(" ") for _ in range(4)]
        rows += [(g + k, f"{prose(rng, 60)} {' '.join(line)} {prose(rng, 60)}") for k, line in enumerate(lines)]
        p = [w for line in lines for w in line]
        rows += [(g + 4, f"{prose(rng, 60)} {' '.join(p)} {prose(rng, 60)}"), (g + 5, f"{prose(rng, 60)} {' '.join(w if k % 12 != 8 else 'x' for k, w in enumerate(p))} {prose(rng, 60)}")]
    got = {r.doc_id: r for r in passages.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.n_repeated >= 60 and r.n_links == 1 if i % 6 > 3 else r.n_repeated == 0 for i, r in got.items())


def test_words_said_over_and_over(spark, prose):
    """Texts of runs of one word: places that have the same words about them count once, and matches grow with the texts."""
    import random

    import numpy as np
    import pyarrow as pa

    a, b = np.full(2000, 7, np.uint64), np.full(700, 7, np.uint64)
    x, y = passages.common_seeds(a, b)
    assert len(x) <= 3 * len(a) and set(x) == set(range(1996)) and set(y) == set(range(696))
    assert (found := passages.passages(a, b, x, y)) and {n for s, e, *_ in found for n in range(s, e)} == set(range(2000))
    rows = [{"doc": d, "x": k, "block": 0, "i": 0, "j": 0, "label": None, "items": list(range(125))} for d in (1, 2, 3) for k in range(40)]
    kinds = pa.schema([("doc", pa.int64()), ("x", pa.int32()), ("block", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("label", pa.int64()), ("items", pa.list_(pa.int32()))])
    got = passages.compared(pa.Table.from_pylist(rows, kinds)).to_pylist()
    assert [(r["doc"], r["leader"]) for r in got] == [(2, 1), (3, 1), (3, 2)]  # 4800 rows before, one for each pair of places
    rng = random.Random(24)
    rows = [(i, f"{prose(rng, 60)} {'the ' * 40} {prose(rng, 60)}") for i in range(40)]
    p = prose(rng, 30)
    rows += [(i, f"{prose(rng, 60)} {'the ' * 40} {p} {prose(rng, 60)} {'and ' * n}") for i, n in ((50, 400), (51, 300))]
    got = {r.doc_id: r for r in passages.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.n_repeated == 0 for i, r in got.items() if i < 40)
    assert got[50].n_repeated >= 370 and got[51].n_repeated >= 370


def test_runs_of_one_word_meet_by_what_stands_beside_them(spark, prose, monkeypatch):
    """Short runs of one word aren't paired on the run alone; long ones are covered whole; a passage that goes on beyond a run is found."""
    import random

    rng, pairs = random.Random(25), []
    written = passages.written
    monkeypatch.setattr(passages, "written", lambda df, label: pairs.append(out) or out if (out := written(df, label)) is not None and label == "passage-pairs" else out)
    rows = [(i, f"{prose(rng, 60)} {'the ' * (36 + i % 13)} {prose(rng, 60)}") for i in range(40)]
    rows += [(i, f"{prose(rng, 30)} {'the ' * n} {prose(rng, 30)}") for i, n in ((41, 400), (42, 60), (43, 215), (44, 50))]
    beside = prose(rng, 16).split()
    for i in (50, 51):  # no seed but the run's
        own = [w if k % 4 else f"{w}{i}" for k, w in enumerate(beside)]
        rows.append((i, f"{prose(rng, 60)} {'the ' * 45} {' '.join(own)} {prose(rng, 60)}"))
    got = {r.doc_id: r for r in passages.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_repeated == 0 for i in range(40))
    assert all(got[i].n_repeated >= n for i, n in ((41, 400), (42, 60), (43, 215), (44, 50)))
    assert got[50].n_repeated >= 55 and got[51].leaders == [50]
    assert sum(p.count() for p in pairs) <= 200  # of 1035


def test_all_places_in_the_leader(spark, prose):
    import random

    rng = random.Random(22)
    p, inner = prose(rng, 80), prose(rng, 80)
    parts = [x for _ in range(20) for x in (prose(rng, 70), p)] + [inner, prose(rng, 70), inner]
    rows = [(1, " ".join(parts)), (2, f"{prose(rng, 60)} {p} {prose(rng, 60)}"), (3, f"{prose(rng, 60)} {p} {prose(rng, 60)} {p}")]
    got = {r.doc_id: r for r in passages.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    have = {n for s in got[1].spans for n in range(s.s, s.e)}
    need = {150 * k + 70 + n for k in range(20) for n in range(80)}
    assert need <= have and len(have - need) <= 40  # not the part that only this document repeats
    assert got[2].n_repeated >= 80 and got[3].n_repeated >= 160 and got[1].n_links == 2 and got[1].leaders == []


def test_empty_tables(none):
    assert near_dup.cluster(none).count() == near_dup.deduplicate(none).count() == 0
    assert suffixes.remove_repeats(none).count() == passages.deduplicate(none).count() == 0


def test_components_follow_long_paths(spark):
    from siftwright.llm.components import components

    links = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).unionByName(spark.createDataFrame([(500, 501), (None, 3), (7, 7)], "a long, b long"))
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 200)} | {501: 500}
