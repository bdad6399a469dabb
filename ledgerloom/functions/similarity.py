"""Likeness of two short texts."""

from __future__ import annotations

import functools
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

#: Characters of each text that are compared, and the ratio of lengths beyond which texts are unlike.
COMPARED, RATIO = 50, 3


def common_length(a: str, b: str) -> int:
    """Characters in common: the longest shared run (the first one), and the same to its left and to its right."""
    todo, total = [(a, b)], 0
    while todo:
        x, y = todo.pop()
        n = p = 0
        for i in range(len(x)):
            while i + n < len(x) and x[i : i + n + 1] in y:  # only a longer run than the longest so far
                n, p = n + 1, i
        if n:
            q = y.find(x[p : p + n])
            total += n
            todo += [(x[:p], y[:q]), (x[p + n :], y[q + n :])]
    return total


def similarity(a: str | None, b: str | None) -> float:
    if not a or not b or max(len(a), len(b)) > RATIO * min(len(a), len(b)):
        return 0.0
    a, b = a[:COMPARED], b[:COMPARED]
    return common_length(a, b) * 200.0 / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}  # of a batch, each pair of texts once
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in seen:
            seen[pair] = similarity(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


_similarity = _similarity.asNondeterministic()  # else a filter on the result is pushed down with a copy of the call, which then runs twice


def text_similarity(a: Column | str, b: Column | str) -> Column:
    """0 to 100: twice the characters in common over both lengths (an Arrow function: use it on pairs that joins have narrowed)."""
    return _similarity(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def alike(a: str | None, b: str | None, least: float) -> bool:
    """Whether ``similarity`` is ``least`` or more; characters that both texts have bound what they have in common, so most unlike
    texts are told by counting."""
    if not a or not b or max(len(a), len(b)) > RATIO * min(len(a), len(b)):
        return False
    a, b = a[:COMPARED], b[:COMPARED]
    size = len(a) + len(b)
    return sum(min(a.count(c), b.count(c)) for c in set(a)) * 200.0 / size >= least and common_length(a, b) * 200.0 / size >= least


@functools.cache
def _alike(least: float):
    @F.pandas_udf(BooleanType())
    def judge(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple, bool] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in seen:
                seen[pair] = alike(*pair, least)
            out.append(seen[pair])
        return pd.Series(out, dtype="bool")

    return judge.asNondeterministic()


def text_alike(a: Column | str, b: Column | str, least: float) -> Column:
    """Whether two texts are alike by ``least`` or more (an Arrow function; texts whose lengths tell are not sent to it)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = (F.least(F.length(c), F.lit(COMPARED)) for c in (a, b))
    near = F.least(x, y) * 200.0 >= least * (x + y)
    return _alike(least)(F.when(near, a), F.when(near, b))
