"""How rows are dealt out to tasks, where the bytes of a table say little of the work on its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over four tasks a core: a small file comes in one split, however dear the work on its rows is."""
    return df.repartition(max(32, 4 * cores(df)), *keys)


def tasks_of(text: DataFrame, column: str, size: int) -> int:
    """Tasks that hold about ``size`` characters of a text each, two a core at least; from one pass over its lengths."""
    n = text.agg(F.sum(F.length(column))).first()[0] or 0
    return max(2 * cores(text), -(-n // size))
