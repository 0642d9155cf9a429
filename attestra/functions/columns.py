"""Small helpers over column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it or loops over it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column, block: int = 256) -> Column:
    """Sums of an array of numbers up to and with each, as longs; block by block, so the time stays in proportion to the length."""

    def sums(of: Column, first: Column) -> Column:
        """``first``, then the sum up to each."""
        return F.aggregate(of, F.array(first.cast("long")), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))

    def made(blocks: Column) -> Column:
        before = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, v: a + v)), F.lit(0))
        return bound(before, lambda at: F.flatten(F.transform(blocks, lambda b, i: bound(sums(b, F.get(at, i)), lambda s: F.slice(s, F.lit(2), F.size(s) - 1)))))

    cut = F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(block)), lambda s: F.slice(values, s + 1, F.lit(block)))
    return F.when(F.size(values) > 0, bound(cut, made)).otherwise(F.array().cast("array<bigint>"))
