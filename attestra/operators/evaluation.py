"""Scores, transitions and differences between runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCEPTED = ("match", "likely_match")

#: Parts of a group whose frontiers are taken apart.
PARTS = 1024


def accuracy(results: DataFrame, group: str) -> DataFrame:
    """Accepted and hard failures by group and, with a null group, overall."""
    ok = F.col("status").isin(*ACCEPTED)
    return results.rollup(group).agg(F.count("*").alias("fields"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("hard_failures"), F.avg(ok.cast("double")).alias("accuracy"))


def perfect_documents(results: DataFrame, doc: str) -> DataFrame:
    by_doc = results.groupBy(doc).agg(F.bool_and(F.col("status") == "match").alias("p"), F.bool_and(F.col("status").isin(*ACCEPTED)).alias("c"))
    return by_doc.agg(F.count("*").alias("documents"), F.count_if("p").alias("perfect"), F.count_if("c").alias("zero_hard_failure"))


def character_scores(rows: DataFrame, expected: str, seen: str, *groups: str) -> DataFrame:
    """Exact fields (null is empty), edit errors and accuracy; numerators and denominators are summed before dividing."""
    e, a = F.coalesce(F.col(expected), F.lit("")), F.coalesce(F.col(seen), F.lit(""))
    n, k = F.sum(F.greatest(F.length(e), F.lit(1))).cast("long"), F.sum(F.levenshtein(e, a)).cast("long")
    return rows.groupBy(*groups).agg(F.count("*").alias("fields"), F.count_if(e == a).alias("exact"), n.alias("expected_chars"), k.alias("errors"), (1 - k / n).alias("char_accuracy"))


def edit_buckets(rows: DataFrame, expected: str, seen: str) -> DataFrame:
    n = F.levenshtein(F.coalesce(F.col(expected), F.lit("")), F.coalesce(F.col(seen), F.lit("")))
    bucket = F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").when(n <= 6, "4-6").otherwise("7+")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("fields"))


def confusions(rows: DataFrame, expected: str, seen: str, top: int) -> DataFrame:
    """Most frequent (expected, seen) characters at equal positions; a missing one is empty. A report, so the limit is the feature."""
    n = F.greatest(F.length(expected), F.length(seen))
    at = rows.where(n > 0).select(expected, seen, F.explode(F.sequence(F.lit(1), n)).alias("i"))
    c = at.select(F.substr(expected, F.col("i"), F.lit(1)).alias("expected"), F.substr(seen, F.col("i"), F.lit(1)).alias("seen")).where("expected <> seen")
    return c.groupBy("expected", "seen").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "expected", "seen").limit(top)


def transition(before: Column, after: Column) -> Column:
    return F.when(before & after, "BOTH_CORRECT").when(before, "REGRESSION").when(after, "IMPROVEMENT").otherwise("BOTH_WRONG")


def keyed_difference(left: DataFrame, right: DataFrame, keys: list[str], value: str, by: str) -> DataFrame:
    """Changed, removed and added values under the union of both sides' keys."""
    j = left.select(*keys, F.col(value).alias("a")).join(right.select(*keys, F.col(value).alias("b")), keys, "full")
    return j.groupBy(by).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a").isNull()).alias("added"))


def pareto(rows: DataFrame, group: str, cost: str, gain: str, strict: bool = False) -> DataFrame:
    """Rows that none of their group dominates: one at most as dear with at least the gain and better in one of them; with ``strict``, one that is better in both.

    Costs are dealt by hash into parts of their group and each part's own frontier is taken first: what a part dominates its
    group dominates too, and leaves the best gains as they are. So the pass over a whole group sees the parts' frontiers only.
    """
    def not_dominated(per: DataFrame, *within) -> DataFrame:
        best = F.max("__top").over(W.partitionBy(group, *within).orderBy(cost).rowsBetween(W.unboundedPreceding, -1))
        per = per.withColumn("__best", best)
        return per.where(F.col("__best").isNull() | ((F.col("__top") >= F.col("__best")) if strict else (F.col("__top") > F.col("__best"))))

    per = rows.groupBy(group, cost).agg(F.max(gain).alias("__top"))
    per = not_dominated(not_dominated(per, F.pmod(F.xxhash64(cost), F.lit(PARTS))).drop("__best"))
    kept = F.col("__best").isNull() | (F.col(gain) >= F.col("__best")) if strict else F.col(gain) == F.col("__top")
    return rows.join(per, [group, cost]).where(kept).drop("__best", "__top")


def issues(rules: list[tuple[str, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("issue"), *df.columns) for name, df in rules])


def key_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of union, intersection and both differences of two key columns, in one pass over the keys."""
    k = a.distinct().select("k", F.lit(1).alias("side")).unionByName(b.distinct().select("k", F.lit(2).alias("side"))).groupBy("k").agg(F.sum("side").alias("s"))
    c = k.agg(F.count("*").alias("union"), F.count_if(F.col("s") == 3).alias("intersect"), F.count_if(F.col("s") == 1).alias("left only"), F.count_if(F.col("s") == 2).alias("right only"))
    return c.select(F.explode(F.array(*(F.struct(F.lit(x).alias("op"), F.col(x).alias("n")) for x in c.columns))).alias("x")).select("x.op", "x.n")


def status_changes(rows: DataFrame, before: str, after: str, *groups: str) -> DataFrame:
    """How often each status of one run became each of another."""
    return rows.groupBy(*groups, F.concat_ws("->", before, after).alias("change")).agg(F.count("*").alias("n"))


def transition_table(rows: DataFrame, before: Column, after: Column, group: str) -> DataFrame:
    """By group: both_correct, regression, improvement, both_wrong, zeros included."""
    names = ["BOTH_CORRECT", "REGRESSION", "IMPROVEMENT", "BOTH_WRONG"]
    tr = transition(before, after)
    return rows.groupBy(group).agg(*(F.count_if(tr == n).alias(n.lower()) for n in names))


def positional_changes(rows: DataFrame, left: str, right: str) -> DataFrame:
    """``changed`` and ``positions`` of two lists: places where they differ, what one lacks included; a missing list is empty."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(left, none), F.coalesce(right, none)
    pairs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    return rows.withColumns({"changed": F.size(F.filter(pairs, lambda x: x)).cast("long"), "positions": F.greatest(F.size(a), F.size(b)).cast("long")})


def stability(rows: DataFrame, output: Column, unit: str, *groups: str) -> DataFrame:
    """By group: units, and those whose repeats did not all give the same output (null counts as one)."""
    n = rows.groupBy(*groups, unit).agg(F.countDistinct(F.struct(output)).alias("n"))
    return n.groupBy(*groups).agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("unstable"))


def coverage(documents: DataFrame, labels: DataFrame, key: str, label: str, *groups: str) -> DataFrame:
    """By group: documents, labelled ones, good ones (label 1) and those without a label."""
    j = documents.join(labels.select(key, label), key, "left")
    return j.groupBy(*groups).agg(F.count("*").alias("documents"), F.count(label).alias("labelled"), F.count_if(F.col(label) == 1).alias("good"), (F.count("*") - F.count(label)).alias("missing"))


def breakdown(rows: DataFrame, tags: Column, value: Column, name: str = "tag") -> DataFrame:
    """Rows and mean value of each tag of an array; a row counts for every tag it has."""
    return rows.select(value.alias("__value"), F.explode(tags).alias(name)).groupBy(name).agg(F.count("*").alias("n"), F.avg("__value").alias("mean"))


def with_deltas(documents: DataFrame, deltas: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """Documents with a column for each named delta, 0 where a document has none."""
    wide = deltas.groupBy(key).agg(*(F.sum(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names))
    return documents.join(wide, key, "left").na.fill(0, names)
