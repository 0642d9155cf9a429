"""Batch plans: chunks, widths, padding, archives and run matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.ranking import running


def chunks(items: DataFrame, group: list[str], order: list[Column], size: int) -> DataFrame:
    """``chunk``: ordinal // size inside each group, in ascending order; a group of any size."""
    return running(items, group, order).withColumn("chunk", F.floor((F.col("upto") - 1) / size).cast("long")).drop("upto", "total")


def cycled(items: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Positions 0..n-1, each with the item (all its columns) that is due when the items repeat in turn, in an order that is unique."""
    numbered = running(items.withColumn("__all", F.lit(1)), ["__all"], order).drop("__all")
    turns = F.ceil((F.lit(n) - F.col("upto") + 1) / F.col("total"))
    each = numbered.where(F.col("upto") <= n).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1)))
    return each.withColumn("pos", (F.col("upto") - 1 + F.col("turn") * F.col("total")).cast("long")).drop("upto", "total", "turn")


def target_width(width: Column, height: Column, to_height: int = 48, least: int = 320, most: int = 3200) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(to_height * width / height))).cast("long")


def width_bucket(width: Column) -> Column:
    return F.when(width < 64, "<64").when(width < 128, "64-127").when(width < 256, "128-255").when(width < 512, "256-511").otherwise("512+")


def efficiency(ratio: Column) -> Column:
    """Share of a padded batch that holds content."""
    return F.sum(ratio) / (F.max(ratio) * F.count("*"))


def side_pairs(entries: DataFrame) -> DataFrame:
    """Front and back images paired by parent folder."""
    parent, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lower(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    f, b = F.count_if(name == "front"), F.count_if(name == "back")
    return entries.groupBy(parent.alias("parent")).agg(F.count("*").alias("entries"), f.alias("fronts"), b.alias("backs"), ((f == 1) & (b == 1)).alias("paired"))


def matrix(axes: dict[str, DataFrame]) -> DataFrame:
    """Every combination of the distinct values of a few one-column tables of settings."""
    named = [df.select(F.col(df.columns[0]).alias(name)).distinct() for name, df in axes.items()]
    return reduce(DataFrame.crossJoin, named)
