"""Small column helpers: matching, blanks, keyword counts, best candidates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column) -> Column:
    """True where there is no value: null or ''."""
    return c.isNull() | (c == "")


def filled(c: Column) -> Column:
    return ~blank(c)


def strip(c: Column) -> Column:
    """White space of any kind goes from both ends."""
    return F.regexp_replace(c, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def any_of(words: Iterable[str]) -> str:
    """A pattern of literal alternatives."""
    return "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-").replace("\\@", "@").replace("\\/", "/") for w in words)


def has_any(c: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs anywhere in c: one pass, no join."""
    return c.rlike(any_of(words))


def hits(c: Column, words: Iterable[str]) -> Column:
    """How many of the words occur in c."""
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))


def best_class(c: Column, classes: Mapping[str, Iterable[str]]) -> Column:
    """The class with most words in c, the first of equals; null if none has any."""
    scored = F.array(*(F.struct(hits(c, words).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(classes.items())))
    top = F.array_max(scored)
    return F.when(top["score"] > 0, top["name"])


def letters(c: Column, kept: str = "A-Za-zÄÖÜäöüßÀ-ÖØ-öø-ÿ") -> Column:
    """The number of letters."""
    return F.length(F.regexp_replace(c, f"[^{kept}]", ""))


def title(c: Column) -> Column:
    """A capital after each space or hyphen, small letters elsewhere."""
    return F.array_join(F.transform(F.split(c, "-"), lambda x: F.initcap(x)), "-")


def label(domain: Column) -> Column:
    """The first label of a domain as a name."""
    return F.initcap(F.translate(F.substring_index(domain, ".", 1), "-_", "  "))


def host(url: Column) -> Column:
    """Host of a URL in lower case, without port or user; null if there is none."""
    return F.lower(found(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
