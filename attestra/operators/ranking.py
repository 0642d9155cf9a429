"""Row numbers, running totals and exact quantiles of groups of any size: a large group is cut into slices of its order, so no task holds a whole one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows a slice holds, on average; groups below it mostly stay whole.
SLICE = 2_000_000
#: Cuts among all groups, on average: what is broadcast stays at a few MB, and slices grow beyond it.
CUTS = 65_536
#: Ranks that a quantile's first pass tells apart.
ACCURACY = 100_000


def running(rows: DataFrame, group: list[str], order: list[Column], weight: Column | None = None, slice_rows: int = SLICE) -> DataFrame:
    """Rows with ``upto``, the sum of weights (1 unless given) up to and with the row in ascending order, and ``total``, their group's sum.

    Cuts are rows that the hash of their order picks, so every evaluation of the same
    rows finds the same ones. Rows of equal order stay in one slice and follow one
    another in any sequence; nulls come first and null groups are groups. ``rows`` may
    have columns of any other name.
    """
    k = rows.select(F.struct("*").alias("row"), F.struct(F.lit(0), *group).alias("key"), F.struct(*order).alias("at"), (F.lit(1) if weight is None else weight).cast("long").alias("weight"))
    every = k.agg(F.greatest(F.lit(slice_rows), F.ceil(F.count("*") / CUTS)).alias("every"))  # one row
    picked = k.select("key", "at").crossJoin(F.broadcast(every)).where(F.pmod(F.xxhash64("at"), "every") == 0)
    cuts = picked.groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("cuts"))
    steps = F.array(*(F.lit(2**i) for i in range(18, -1, -1)))
    below = F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= F.size("cuts")) & (F.get("cuts", n + step - 1) <= F.col("at")), n + step).otherwise(n))
    k = k.join(F.broadcast(cuts), "key", "left").withColumn("slice", below).drop("cuts")
    whole = W.partitionBy("key")
    sizes = k.groupBy("key", "slice").agg(F.sum("weight").alias("size"))
    sizes = sizes.select("key", "slice", (F.sum("size").over(whole.orderBy("slice")) - F.col("size")).alias("before"), F.sum("size").over(whole).alias("total"))
    here = W.partitionBy("key", "slice").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return k.join(sizes, ["key", "slice"]).select("row.*", (F.col("before") + F.sum("weight").over(here)).alias("upto"), "total")


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the facts of their keys, null ones included; ``right`` has one row for each combination of keys."""
    key = lambda df: df.withColumn("__key", F.struct(F.lit(0), *keys))
    return key(left).join(key(right).drop(*keys), "__key").drop("__key")


def _ranked(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], accuracy: int) -> DataFrame:
    """For each result ``what``: counts of the values near its share, with all smaller and all greater ones in a row each, and running totals. Nulls weigh nothing but keep their group.

    The first pass bounds each share by a sketch, whose rank error is at most 1 / accuracy;
    the second counts exactly what lies between the bounds, a few of 10^5 rows.
    """
    e = 2 / accuracy
    near = lambda c, share: F.percentile_approx(F.col(c).cast("double"), [max(0.0, share - e), min(1.0, share + e)], accuracy)
    bounds = rows.groupBy(*keys).agg(F.struct(*(near(c, share).alias(name) for name, (c, share) in wanted.items())).alias("__bounds"))
    needed = dict.fromkeys([*keys, *(c for c, _ in wanted.values())])
    of = lambda name, i: F.get(F.col("__bounds")[name], i)
    values = F.array(*(F.struct(F.lit(name).alias("what"), F.col(c).cast("double").alias("x"), of(name, 0).alias("least"), of(name, 1).alias("most")) for name, (c, _) in wanted.items()))
    v = beside(rows.select(*needed), bounds, keys).select(*keys, F.inline(values))
    v = v.withColumn("side", F.when(F.col("x") < F.col("least"), -1).when(F.col("x") > F.col("most"), 1).otherwise(0))
    v = v.groupBy(*keys, "what", "side", F.when(F.col("side") == 0, F.col("x")).alias("x")).agg(F.count("x").alias("n"), F.min("x").alias("first"), F.max("x").alias("last"))
    w = W.partitionBy(*keys, "what")
    return v.withColumns({"upto": F.sum("n").over(w.orderBy("side", "x").rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("n").over(w)})


def _at(name: str, i: Column) -> Column:
    """The value at position i (from 0): between the bounds, or the one next to them."""
    inside = (F.col("side") == 0) & (F.col("upto") - F.col("n") <= i) & (i < F.col("upto"))
    value = F.when(inside, F.col("x")).when((F.col("side") < 0) & (i == F.col("upto") - 1), F.col("last")).when((F.col("side") > 0) & (i == F.col("upto") - F.col("n")), F.col("first"))
    return F.max(F.when((F.col("what") == name) & (F.col("total") > 0), value))


def quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], accuracy: int = ACCURACY) -> DataFrame:
    """Exact, linearly interpolated quantiles: ``wanted`` has (column, share) by name of result. Null where a group has no values."""
    found = []
    for name, (_, share) in wanted.items():
        rank = (F.col("total") - 1) * share
        low, high, part = _at(name, F.floor(rank)), _at(name, F.ceil(rank)), F.max(F.when(F.col("what") == name, rank - F.floor(rank)))
        found.append(F.when(part == 0, low).otherwise(low + (high - low) * part).alias(name))
    return _ranked(rows, keys, wanted, accuracy).groupBy(*keys).agg(*found)


def upper_median(rows: DataFrame, keys: list[str], column: str, accuracy: int = ACCURACY) -> DataFrame:
    """The value at n // 2 of the sorted ones."""
    c = _ranked(rows, keys, {"upper_median": (column, 0.5)}, accuracy)
    return c.groupBy(*keys).agg(_at("upper_median", F.floor(F.col("total") / 2)).alias("upper_median"))


def spread(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Median, distance of the quartiles, median distance from the median, least and greatest value."""
    q = quantiles(rows, keys, {"median": (column, 0.5), "__low": (column, 0.25), "__high": (column, 0.75)})
    ends = rows.groupBy(*keys).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    from_median = beside(rows, q.select(*keys, "median"), keys).withColumn("mad", F.abs(F.col(column) - F.col("median")))
    both = beside(beside(q, quantiles(from_median, keys, {"mad": ("mad", 0.5)}), keys), ends, keys)
    return both.select(*keys, "median", (F.col("__high") - F.col("__low")).alias("iqr"), "mad", "low", "high")

