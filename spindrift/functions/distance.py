"""Edit distance with transpositions of neighbours (optimal string alignment), bounded."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def budget(word: str, content: bool = False) -> int:
    """Edits that a word may need: none for short ones, one up to seven letters, two beyond."""
    return 0 if len(word) < (4 if content else 3) else 1 if len(word) < 8 else 2


def osa(a: str, b: str, most: int) -> int:
    """Distance of two words, or ``most + 1`` if it is more: substitution, insertion, deletion and swap cost 1 each."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return min(prev[-1], most + 1)


def window(term: str, name: str, most: int) -> tuple[int, int]:
    """Least distance of a term to any stretch of a name, and the earliest start of one that has it; (most + 1, -1) if none.

    One table for all stretches at once: a stretch may begin anywhere at no cost, and every cell keeps its start.
    """
    far = (most + 1, -1)
    before: list[tuple[int, int]] = []
    row = [(0, j) for j in range(len(name) + 1)]
    for i, x in enumerate(term, 1):
        new = [(i, 0)]
        for j, y in enumerate(name, 1):
            up, left, cross = row[j], new[j - 1], row[j - 1]
            best = cross if x == y else (cross[0] + 1, cross[1])
            if up[0] < best[0] or (up[0] + 1, up[1]) < best:
                best = min(best, (up[0] + 1, up[1]))
            if (left[0] + 1, left[1]) < best:
                best = (left[0] + 1, left[1])
            if i > 1 and j > 1 and x == name[j - 2] and term[i - 2] == y:
                swap = before[j - 2]
                if (swap[0] + 1, swap[1]) < best:
                    best = (swap[0] + 1, swap[1])
            new.append(best)
        if min(c[0] for c in new) > most:
            return far
        before, row = row, new
    return min(min(row), far)


def _one_edit(term: str) -> list[str]:
    """Expressions for a term with one edit in it: a letter lost or wrong, one put in, two changed places."""
    e = [re.escape(c) for c in term]
    n, join = len(term), "".join
    lost = [join(e[:i] + e[i + 1 :]) for i in (0, n - 1)]
    wrong = [join([*e[:i], ".?", *e[i + 1 :]]) for i in range(1, n - 1)]
    more = [join([*e[:i], ".", *e[i:]]) for i in range(1, n)]
    turned = [join([*e[:i], e[i + 1], e[i], *e[i + 2 :]]) for i in range(n - 1)]
    return list(dict.fromkeys([*lost, *wrong, *more, *turned]))


def likely(term: str, most: int) -> str:
    """An expression that every name within ``most`` (at most 2) edits of a term matches somewhere.

    Of two edits, at least one half of the term has one at most; a swap across the middle leaves each half with one
    wrong letter at its end.
    """
    if most == 0 or len(term) < 3:
        return re.escape(term) if most == 0 else "."
    parts = [term] if most == 1 else [term[: len(term) // 2], term[len(term) // 2 :]]
    return "|".join(x for p in parts for x in _one_edit(p))


def osa_within(column: Column, word: str, most: int) -> Column:
    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: osa(v, word, most) if v is not None else most + 1).astype("int32")

    return run(column)


def best_window(column: Column, term: str, most: int) -> Column:
    """struct<dist, at> of ``window`` for each name."""

    @F.pandas_udf("dist int, at int")
    def run(values: pd.Series) -> pd.DataFrame:
        found = [window(term, v, most) if v is not None else (most + 1, -1) for v in values]
        return pd.DataFrame(found, columns=["dist", "at"]).astype("int32")

    return run(column)
