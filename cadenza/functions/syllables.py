"""Spelling cut into a given number of syllables, as an Arrow UDF for distinct words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _runs(word: str) -> list[list[int]]:
    """[start, end) of the vowel-letter runs; a lone final e is silent after another run. A word without any is one run."""
    flags = [c.upper()[:1] in "AEIOUY" and c != "" for c in word]
    runs: list[list[int]] = []
    for i, v in enumerate(flags):
        if v and runs and runs[-1][1] == i:
            runs[-1][1] = i + 1
        elif v:
            runs.append([i, i + 1])
    if len(runs) > 1 and runs[-1] == [len(word) - 1, len(word)] and word[-1] in "eE":
        runs.pop()
    return runs or [[0, len(word)]]


def split(word: str, count: int) -> list[str]:
    """``count`` syllables of ``word`` if its letters allow: close runs are joined, wide ones halved, leftmost first."""
    if not word or count <= 1:
        return [word]
    runs = _runs(word)
    while len(runs) > count:
        gaps = [b[0] - a[1] for a, b in zip(runs, runs[1:], strict=False)]
        k = gaps.index(min(gaps))
        runs[k : k + 2] = [[runs[k][0], runs[k + 1][1]]]
    while len(runs) < count:
        widths = [b - a for a, b in runs]
        k = widths.index(max(widths))
        if widths[k] <= 1:
            break
        a, b = runs[k]
        runs[k : k + 1] = [[a, a + (b - a) // 2], [a + (b - a) // 2, b]]
    cuts = [0, *(a[1] if b[0] - a[1] <= 1 else a[1] + 1 for a, b in zip(runs, runs[1:], strict=False)), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def display(word: str, stresses: str) -> str:
    """Syllables joined by hyphens, stressed ones in upper case; missing stresses are none."""
    parts = split(word, len(stresses))
    return "-".join(p.upper() if stresses[i : i + 1] in ("1", "2") else p.lower() for i, p in enumerate(parts))


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_udf(word: pd.Series, count: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else split(w, int(n)) for w, n in zip(word, count, strict=True)])


@F.pandas_udf(T.StringType())
def display_udf(word: pd.Series, stresses: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else display(w, s or "") for w, s in zip(word, stresses, strict=True)])
