"""Text column expressions, and the token-set ratio."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def none_if_empty(c: Column) -> Column:
    return F.when(c == "", None).otherwise(c)


def root_domain(url: Column) -> Column:
    """The last two labels of a url's host part without `www.`; null without one. A user or a port in it stays; a url may begin with `//`, its scheme left out."""
    authority = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    host = F.regexp_replace(authority, r"^www\.", "")
    labels = F.split(host, r"\.")
    return F.when(authority == "", None).when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)


def longest_prefix(words: Column, table: Column) -> Column:
    """The value of the longest run of words, from the first, that is a key of a map column; null without one."""
    prefixes = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    known = F.filter(prefixes, lambda p: F.element_at(table, p).isNotNull())
    return F.when(F.size(words) > 0, F.element_at(table, F.get(known, 0)))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; a bit for each character of a."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Similarity 0 to 100 of two texts as sets of words: 100 if one's words are all in the other; else the best Indel similarity of the common words and either rest."""
    left, right = set((a or "").split()), set((b or "").split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = left & right, sorted(left - right), sorted(right - left)
    if both and (not only_a or not only_b):
        return 100.0
    x, y = " ".join(only_a), " ".join(only_b)
    shared = len(" ".join(both))
    gap = 1 if both else 0
    total = 2 * (shared + gap) + len(x) + len(y)
    best = 100.0 * 2 * (shared + gap + common_subsequence(x, y)) / total if total else 0.0
    if both:
        for rest in (x, y):
            longer = shared + gap + len(rest)
            best = max(best, 100.0 * 2 * shared / (shared + longer))
    return best


#: Pairs of texts of so many characters together are remembered, and so many of them.
SHORT, REMEMBERED = 400, 1 << 16


@functools.lru_cache(REMEMBERED)
def seen_ratio(a: str, b: str) -> float:
    return token_set_ratio(a, b)


def token_set_ratio_column(a: Column, b: Column) -> Column:
    """The ratio of two columns, in Arrow batches; the one place where Python looks at rows. Short texts, which come again and again, are remembered."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0.0 if p is None or q is None else (seen_ratio if len(p) + len(q) <= SHORT else token_set_ratio)(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return ratio(a, b)
