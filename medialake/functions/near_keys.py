"""Join keys of strings that can be similar: two texts whose SequenceMatcher ratio reaches t share a key.

A ratio of t leaves at most (1 - t) times both lengths outside the common subsequence, d characters. One text cut into d + 1 pieces
keeps a piece whole in the other, moved by no more than the characters outside. The earlier text gives its pieces, the later one
every place where a piece of a possible length may lie. Where pieces would be shorter than two characters the length alone is the key.
"""

from __future__ import annotations

from math import ceil, floor

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_EPS = 1e-9


def _lengths(n: int, t: float) -> range:
    """Lengths of the texts that a text of n characters can be similar to."""
    return range(ceil(n * t / (2 - t) - _EPS), floor(n * (2 - t) / t + _EPS) + 1)


def _outside(n: int, m: int, t: float) -> int:
    return floor((1 - t) * (n + m) + _EPS)


def _pieces(n: int, t: float) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text of n characters; none where they would be too short."""
    k = _outside(n, _lengths(n, t)[-1], t) + 1
    return [(i * n // k, (i + 1) * n // k) for i in range(k)] if k == 1 or n >= 2 * k else []


def earlier_keys(text: str, t: float) -> list[str]:
    if t <= 0:
        return [""]
    n = len(text)
    return [f"{n}:{i}:{text[a:b]}" for i, (a, b) in enumerate(_pieces(n, t))] or [f"{n}"]


def later_keys(text: str, t: float) -> list[str]:
    if t <= 0:
        return [""]
    m, out = len(text), set()
    for n in _lengths(m, t):
        pieces, d = _pieces(n, t), _outside(n, m, t)
        if not pieces:
            out.add(f"{n}")
        left, right = (d - (m - n)) // 2, (d + (m - n)) // 2
        for i, (a, b) in enumerate(pieces):
            out.update(f"{n}:{i}:{text[s : s + b - a]}" for s in range(max(0, a - left), min(m - (b - a), a + right) + 1))
    return sorted(out)


def keys_column(text: str, t: float, later: bool) -> Column:
    make = later_keys if later else earlier_keys

    @F.pandas_udf("array<string>")
    def keys(values: pd.Series) -> pd.Series:
        return values.map(lambda v: make(v, t))

    return keys(text)
