"""Jaro-Winkler similarity of column names: driver metadata, never rows."""

from __future__ import annotations

PREFIX_SCALE, PREFIX_MOST, BOOST_FROM = 0.1, 4, 0.7


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    theirs = [ch for ch, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str | None, b: str | None) -> float:
    """Lower-cased; 0 where either is blank."""
    if not a or not b:
        return 0.0
    a, b = a.lower(), b.lower()
    score = jaro(a, b)
    if score <= BOOST_FROM:
        return score
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y or i == PREFIX_MOST), min(len(a), len(b), PREFIX_MOST))
    return score + same * PREFIX_SCALE * (1 - score)
