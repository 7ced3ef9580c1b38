"""Similarity of single words as people type them: typos, abbreviations, accents."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Abbreviations that are no shortened form of the word, and letters that decomposition leaves alone.
IRREGULAR = {"no": "number", "nos": "number"}
_PLAIN = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "‘": "'"})


def fold(text: str) -> str:
    """Lower case without accents."""
    low = unicodedata.normalize("NFKD", text.lower())
    return low.translate(_PLAIN) if low.isascii() else "".join(c for c in low.translate(_PLAIN) if not unicodedata.combining(c))


def edits_allowed(n: int) -> int:
    """Edits that a word of ``n`` letters may differ by and still be the same word misspelt."""
    return 0 if n <= 3 else 1 if n <= 5 else 2 if n <= 9 else 3


@lru_cache(maxsize=1 << 18)
def letters(word: str) -> int:
    """The letters of a word, one bit each (unusual ones share bits)."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def banded_distance(a: str, b: str, k: int) -> int:
    """Edit distance with transpositions of neighbours, within the band of ``k``; ``k + 1`` where it is larger."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    x, y = letters(a), letters(b)
    if (x & ~y).bit_count() > k or (y & ~x).bit_count() > k:  # each letter only one side has takes an edit
        return k + 1
    far = k + 1
    before, last = None, [j if j <= k else far for j in range(m + 1)]
    for i in range(1, n + 1):
        row = [far] * (m + 1)
        if i <= k:
            row[0] = i
        low = row[0]
        for j in range(max(1, i - k), min(m, i + k) + 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if before and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            row[j] = d
            low = min(low, d)
        if low > k:
            return far
        before, last = last, row
    return min(last[m], far)


def abbreviates(short: str, full: str) -> bool:
    """``short`` has the first letter of ``full`` and the rest of its letters in order, with some left out."""
    if not short or len(short) >= len(full) or short[0] != full[0]:
        return False
    at = 0
    for c in short:
        at = full.find(c, at) + 1
        if not at:
            return False
    return True


@lru_cache(maxsize=1 << 18)
def word_similarity(q: str, t: str) -> float:
    """1 for the same word; less for a typo or an abbreviation; 0 where neither explains the difference."""
    if q == t:
        return 1.0
    best = 0.0
    k = edits_allowed(min(len(q), len(t)))
    if k and (d := banded_distance(q, t, k)) <= k:
        best = 1 - d / max(len(q), len(t))
    if IRREGULAR.get(q) == t:
        best = 0.9
    elif abbreviates(q, t):
        best = max(best, 0.9 if len(q) > 2 or len(q) > 1 and t.startswith(q) else 0.8 if len(q) == 1 else 0.6)
    return best


def align(query: list[str], target: list[str], sim=word_similarity) -> list[tuple[float, int, int]]:
    """Pairs of words, each word once, the most similar first: (similarity, query index, target index)."""
    pairs = sorted(((s, i, j) for i, q in enumerate(query) for j, t in enumerate(target) if (s := sim(q, t)) > 0), key=lambda x: (-x[0], abs(x[1] - x[2]), x[1], x[2]))
    used_q, used_t, out = set(), set(), []
    for s, i, j in pairs:
        if i not in used_q and j not in used_t:
            used_q.add(i)
            used_t.add(j)
            out.append((s, i, j))
    return out
