import random
import re

import pytest

SYLLABLES = "an en er in on th st nd re ti ha es ou at ed or ea sh ing ble".split()


@pytest.fixture(scope="session")
def prose():
    def make(rng, n):
        return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def corpus(prose):
    """Documents with copies, near copies, shared passages, odd texts; (doc_id, text)."""
    rng = random.Random(5)
    out = [prose(rng, rng.randint(30, 220)) for _ in range(60)]
    for i in range(20):  # near copies: one word in forty differs
        w = out[i].split(" ")
        for k in range(0, len(w), 40):
            w[k] = "x" + w[k]
        out.append(" ".join(w))
    out += [out[3], out[3].upper(), out[4]]
    passage = prose(rng, 70)
    out += [f"{prose(rng, 40)} {passage} {prose(rng, 40)}" for _ in range(6)]
    out += [None, "", " \t\n", "one", "one two three", "ONE  two\nthree", "é" * 300, prose(rng, 9000), "é" * 300]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "x" * (i % 3), 1) for i, t in corpus] + [(3, corpus[3][1], "again", 1), (None, corpus[5][1], "no id", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_shingles int").repartition(4).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def words():
    def split(text):
        return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    return split
