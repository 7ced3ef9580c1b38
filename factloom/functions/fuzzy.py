"""Similarity ratios from 0 to 100 by insertions and deletions: 200 x common subsequence / total length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, on the bits of one integer."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & where.get(c, 0)
        v = (v + u) | (v - u)
    return len(b) - (v & full).bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of common words against common words with either side's rest; 0 if a side is empty."""
    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return 0.0
    both, only_s, only_t = (" ".join(sorted(x)) for x in (s & t, s - t, t - s))
    if both and (not only_s or not only_t):
        return 100.0
    left, right = (both + " " + only_s).strip(), (both + " " + only_t).strip()
    scores = [ratio(left, right)]
    if both:
        scores += [ratio(both, left), ratio(both, right)]
    return max(scores)


def partial_ratio(needle: str, hay: str, around: int = 3) -> tuple[float, int, int]:
    """(score, start, end) of the window of ``hay`` most like ``needle``; windows at the ends may be shorter.

    Windows are tried where the two share runs of three letters: on the diagonals with at least a third of the most such
    runs, and up to ``around`` beside them. Texts without any common run are compared at every start.
    """
    n, m = len(needle), len(hay)
    if not n or not m:
        return (100.0 if n == m else 0.0), 0, 0
    if n > m:
        return partial_ratio(hay, needle, around)[0], 0, m
    where: dict[str, list[int]] = {}
    for i in range(n - 2):
        where.setdefault(needle[i : i + 3], []).append(i)
    votes: dict[int, int] = {}
    for j in range(m - 2):
        for i in where.get(hay[j : j + 3], ()):
            votes[j - i] = votes.get(j - i, 0) + 1
    if votes:
        most = max(votes.values())
        starts = sorted({d + k for d, v in votes.items() if 3 * v >= most for k in range(-around, around + 1)}) if most > 1 else sorted(votes)
    else:
        starts = list(range(m - n + 1))
    best = (0.0, 0, min(n, m))
    for start in starts:
        s, e = max(0, start), min(m, start + n)
        if s < e and (score := ratio(needle, hay[s:e])) > best[0]:
            best = (score, s, e)
    return best


def _udf(f):
    def apply(a: Column, b: Column) -> Column:
        @F.pandas_udf("double")
        def score(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y)], dtype="float64")

        return score(a, b)

    return apply


token_sort = _udf(token_sort_ratio)
token_set = _udf(token_set_ratio)
