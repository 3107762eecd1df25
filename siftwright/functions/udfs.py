"""The few functions that need Python: robots rules and language profiles, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# fixed values: frequent words by language
STOP_WORDS = {
    "de": "der die das und ist nicht mit für auf von den ein eine zu im sich auch als nach".split(),
    "en": "the and of to in is that for it with as was on be by at this from are".split(),
    "fr": "le la les de des et en un une est pour que qui dans sur au pas par du".split(),
    "es": "el la los las de que y en un una por con para es del se no su al".split(),
    "it": "il lo la gli le di che e un una per con non è del della in si da".split(),
    "nl": "de het een en van is dat niet met voor op te zijn aan door bij ook als".split(),
}


@F.pandas_udf(BooleanType())
def robots_allows(body: pd.Series, url: pd.Series) -> pd.Series:
    """Whether robots.txt lets any agent read the URL; true without a body."""

    def one(b, u):
        if not b:
            return True
        rules = RobotFileParser()
        rules.parse(b.splitlines())
        return rules.can_fetch("*", u)

    return pd.Series([one(b, u) for b, u in zip(body, url, strict=True)])


@F.pandas_udf(StringType())
def stop_word_language(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The language whose frequent words a text has most of; '' without any, or without text."""
    sets = {k: set(v) for k, v in STOP_WORDS.items()}
    for batch in texts:
        out = []
        for t in batch:
            words = (t or "").lower().split()
            score = {k: sum(w in s for w in words) for k, s in sets.items()}
            best = max(score, key=score.get)
            out.append(best if score[best] else "")
        yield pd.Series(out)
