"""Facts about tables that choose a plan, found once per session and table."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame

Value = TypeVar("Value")
REMEMBERED = 64
_known: deque[tuple] = deque(maxlen=REMEMBERED)


def remembered(df: DataFrame, about: tuple, find: Callable[[], Value]) -> Value:
    """``find()``, or what it gave for the same question about the same query over files of the same size.

    Only for facts that choose between plans with equal results: files that were rewritten in place
    with the same size are not noticed.
    """
    size = str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    for session, asked, bytes_then, then, value in _known:
        if session is df.sparkSession and asked == about and bytes_then == size and then.sameSemantics(df):
            return value
    value = find()
    _known.append((df.sparkSession, about, size, df, value))
    return value
