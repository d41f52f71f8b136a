"""Optimal string alignment: edits and swaps of neighbours, none inside another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def osa(a: str, b: str, most: int | None = None) -> int:
    """The distance of two texts; ``most + 1`` for anything above ``most``."""
    beyond = max(len(a), len(b)) + 1 if most is None else most + 1
    if abs(len(a) - len(b)) >= beyond:
        return beyond
    above: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two_up, above, row = above, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two_up[j - 2] + 1)
            row.append(cost)
        if min(row) >= beyond and (not above or min(above) >= beyond):
            return beyond
    return min(row[-1], beyond)


def is_similar(a: str, b: str, most: int) -> bool:
    return osa(a, b, most) <= most


def osa_column(c: Column, query: str, most: int) -> Column:
    """The distance to a fixed text, in Arrow batches; meant for the few that a native bound let through."""

    @F.pandas_udf("int")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: osa(query, t, most))

    return measured(c)


def may_be_within(c: Column, query: str, most: int) -> Column:
    """A native bound that no text within the distance fails: a swap is two plain edits at most."""
    near = F.levenshtein(c, F.lit(query), 2 * most)
    return (F.abs(F.char_length(c) - len(query)) <= most) & (near >= 0)
