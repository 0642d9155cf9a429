"""JSON results of runs: flattened to scalars by path, compared path by path, digested without what may differ, audited for equivalence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depth(text: Column) -> Column:
    """How deep objects and lists of a JSON text are nested; brackets inside strings don't count."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")
    step = lambda a, c: F.struct((a["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0)), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def scalars(rows: DataFrame, keys: list[str], text: str, lists: bool = False, deepest: int | None = None) -> DataFrame:
    """keys, path, value, kind: every scalar of a JSON column, to any depth. Names are joined by dots; list elements go, or are numbered (``[i]``) with ``lists``. Malformed texts have none.

    A level is unfolded at a time inside the same stage, without a shuffle; the number of
    levels is one number, found in a pass over the texts unless ``deepest`` is given.
    """
    if deepest is None:
        deepest = rows.agg(F.max(depth(F.col(text)))).first()[0] or 0
    df = rows.select(*keys, F.lit("").alias("path"), F.try_parse_json(text).alias("v")).where("v is not null")
    for _ in range(deepest):
        df = df.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
        if not lists:
            df = df.where("key is not null or pos is null")
        below = F.when(F.col("key").isNotNull(), F.concat(F.when(F.col("path") != "", F.concat("path", F.lit("."))).otherwise(""), F.col("key"))).when(F.col("pos").isNotNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.col("path"))
        df = df.select(*keys, below.alias("path"), F.coalesce("value", "v").alias("v"))
    df = df.withColumn("kind", F.schema_of_variant("v")).where(~F.col("kind").startswith("OBJECT") & ~F.col("kind").startswith("ARRAY"))
    return df.select(*keys, "path", F.try_variant_get("v", "$", "string").alias("value"), "kind")


def difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, change (added, removed, changed), before, after: scalars of two snapshots that differ in value or kind."""
    side = lambda df, name: df.select(*keys, "path", F.struct("value", "kind").alias(name))
    j = side(before, "b").join(side(after, "a"), [*keys, "path"], "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.withColumn("change", change).where("change is not null").select(*keys, "path", "change", F.col("b.value").alias("before"), F.col("a.value").alias("after"))


def document_changes(before: DataFrame, after: DataFrame, key: str, fields: str = "fields.", zone: str = "mrz", success: str = "success") -> DataFrame:
    """One row for each document that differs: changed_fields (sorted names), zone_changed, success_changed, from scalars (with lists) of two snapshots."""
    d = difference(before, after, [key])
    name = F.when(F.col("path").startswith(fields), F.regexp_extract(F.substr("path", F.lit(len(fields) + 1)), r"^[^.\[]+", 0))
    own = lambda p: F.bool_or((F.col("path") == p) | F.col("path").startswith(f"{p}.") | F.col("path").startswith(f"{p}["))
    out = d.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("changed_fields"), own(zone).alias("zone_changed"), own(success).alias("success_changed"))
    return out.where((F.size("changed_fields") > 0) | F.col("zone_changed") | F.col("success_changed"))


def digests(rows: DataFrame, keys: list[str], text: str, ignored: tuple[str, ...] = (), deepest: int | None = None) -> DataFrame:
    """keys, digest: of the scalars by path, so the order of names is of no account; paths that an ``ignored`` pattern finds don't count. ``keys`` name one row; malformed texts have a null digest."""
    s = scalars(rows, keys, text, lists=True, deepest=deepest)
    if ignored:
        s = s.where(~reduce(lambda a, b: a | b, (F.col("path").rlike(p) for p in ignored)))
    each = s.groupBy(*keys).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("path", "kind", "value")))), 256).alias("digest"))
    whole = rows.select(*keys, F.try_parse_json(text).isNotNull().alias("whole"))
    return whole.join(each, keys, "left").select(*keys, F.when(F.col("whole"), F.coalesce("digest", F.sha2(F.lit("[]"), 256))).alias("digest"))


def graded_digests(rows: DataFrame, keys: list[str], text: str, ignored: tuple[str, ...], detail: tuple[str, ...], deepest: int | None = None) -> DataFrame:
    """keys, semantic, whole: two digests as ``digests`` makes them from one unfolding; ``whole`` leaves out the ``ignored`` paths, ``semantic`` also those that a ``detail`` pattern finds."""
    found = lambda patterns: reduce(lambda a, b: a | b, (F.col("path").rlike(p) for p in patterns), F.lit(False))
    s = scalars(rows, keys, text, lists=True, deepest=deepest).where(~found(ignored))
    one = F.struct("path", "kind", "value")
    digest = lambda x: F.sha2(F.to_json(F.array_sort(F.collect_list(x))), 256)
    each = s.groupBy(*keys).agg(digest(F.when(~found(detail), one)).alias("semantic"), digest(one).alias("whole"))
    good = rows.select(*keys, F.try_parse_json(text).isNotNull().alias("good"))
    none = F.sha2(F.lit("[]"), 256)
    return good.join(each, keys, "left").select(*keys, *(F.when(F.col("good"), F.coalesce(c, none)).alias(c) for c in ("semantic", "whole")))


def equivalence(runs: DataFrame, baseline: str, key: str = "doc_id") -> DataFrame:
    """run, identical, different, missing, extra: digests of every other run (run, key, digest) as multisets by key against the baseline's. Repeats count each; nothing is paired with more than one row."""
    n = runs.groupBy("run", key, "digest").agg(F.count("*").alias("n"))
    base, other = n.where(F.col("run") == baseline).drop("run"), n.where(F.col("run") != baseline)
    same = other.join(base.select(key, "digest", F.col("n").alias("m")), (other[key].eqNullSafe(base[key])) & (other["digest"].eqNullSafe(base["digest"]))).select("run", F.least("n", "m").alias("same")).groupBy("run").agg(F.sum("same").alias("same"))
    of = other.groupBy("run", F.struct(key).alias("k")).agg(F.sum("n").alias("n"))
    held = base.groupBy(F.struct(key).alias("k")).agg(F.sum("n").alias("m"))
    both = of.join(held, "k", "left").groupBy("run").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("common"), F.sum("n").alias("n"))
    total = held.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("total"))  # one row
    j = both.join(same, "run", "left").na.fill(0, ["same"]).crossJoin(F.broadcast(total))
    return j.select("run", F.col("same").alias("identical"), (F.col("common") - F.col("same")).alias("different"), (F.col("total") - F.col("common")).alias("missing"), (F.col("n") - F.col("common")).alias("extra"))


def change_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: compared, semantic (rows on one side only, or with unequal ``semantic`` digests), detail_only (equal there, unequal in ``whole``)."""
    a, b = (df.select(key, F.struct("semantic", "whole").alias(n)) for df, n in ((before, "a"), (after, "b")))
    j = a.join(b, key, "full")
    same = F.col("a.semantic").eqNullSafe(F.col("b.semantic")) & F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.agg(F.count("*").alias("compared"), F.count_if(~same).alias("semantic"), F.count_if(same & ~F.col("a.whole").eqNullSafe(F.col("b.whole"))).alias("detail_only"))


def against_set(runs: DataFrame, group: list[str], variant: str, baseline) -> DataFrame:
    """By group and variant: repeats, ok, failed, seconds (median of the good ones), and how many repeats have a ``whole`` or ``semantic`` digest that no repeat of the baseline variant in the group has; null where the group has no baseline. ``detail_only`` is the difference."""
    base = runs.where(F.col(variant) == baseline)
    known = base.groupBy(*group).agg(F.lit(True).alias("based"))
    seen = lambda c: base.select(*group, c).distinct().withColumn(f"old_{c}", F.lit(True))
    j = runs.join(known, group, "left").join(seen("whole"), [*group, "whole"], "left").join(seen("semantic"), [*group, "semantic"], "left")
    new = lambda c: F.when(F.bool_or("based"), F.count_if(F.col(f"old_{c}").isNull()))
    good = F.col("status") == "ok"
    out = j.groupBy(*group, variant).agg(F.count("*").alias("repeats"), F.count_if(good).alias("ok"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"), F.percentile(F.when(good, F.col("seconds")), 0.5).alias("seconds"), new("whole").alias("differences"), new("semantic").alias("semantic_differences"))
    return out.withColumn("detail_only", F.col("differences") - F.col("semantic_differences"))
