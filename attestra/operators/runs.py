"""Measured runs: stages, sweeps, gates, orders of runs and comparisons of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.operators import ranking
from attestra.operators.ranking import beside, quantiles


def stage_totals(calls: DataFrame, *keys: str) -> DataFrame:
    """By stage (and role, if among keys): model calls, tensor batches, inputs, failures, seconds. calls: tensor_batch_sizes (array), submitted_batch_size, failure_count, model_seconds, wall_seconds (model seconds where null)."""
    batches = F.coalesce(F.size("tensor_batch_sizes"), F.lit(1))
    sizes = F.coalesce("tensor_batch_sizes", F.array().cast("array<int>"))
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum(batches).cast("long").alias("tensor_batches"), F.sum("submitted_batch_size").cast("long").alias("submitted"), F.max(F.array_max(sizes)).cast("long").alias("largest_batch"),
        F.sum("failure_count").cast("long").alias("failures"), F.sum("model_seconds").alias("model_seconds"), F.sum(F.coalesce("wall_seconds", "model_seconds")).alias("wall_seconds"),
    )


def proves_batching(calls: DataFrame, *keys: str) -> DataFrame:
    """Whether several inputs ever went through in one tensor."""
    return calls.groupBy(*keys).agg((F.sum("submitted_batch_size") > 1).alias("several"), (F.max(F.array_max("tensor_batch_sizes")) > 1).alias("batched"))


def shape_stats(items: DataFrame, ratio: Column, *keys: str) -> DataFrame:
    """Least, greatest and mean ratio of width to height, and the share of a padded batch that holds content."""
    return items.groupBy(*keys).agg(F.count("*").alias("n"), F.min(ratio).alias("low"), F.max(ratio).alias("high"), F.avg(ratio).alias("mean"), F.try_divide(F.sum(ratio), F.max(ratio) * F.count("*")).alias("efficiency"))


def line_counts(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines detected and recognised."""
    return lines.groupBy(*keys).agg(F.count("*").alias("detected"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("recognized"))


def batch_counts(items: DataFrame, *keys: str) -> DataFrame:
    ok = F.count_if(F.col("error").isNull())
    return items.groupBy(*keys).agg(F.count("*").alias("total"), ok.alias("succeeded"), (F.count("*") - ok).alias("failed"))


def broken_counts(counts: DataFrame) -> DataFrame:
    """Rows whose counts do not add up: there must be none."""
    return counts.where((F.col("total") != F.col("succeeded") + F.col("failed")) | (F.least("succeeded", "failed") < 0))


def resource_error(message: Column) -> Column:
    """Whether an error says that memory or another resource ran out."""
    return F.coalesce(F.lower(message).rlike("out of memory|resource exhausted|cannot allocate|bad alloc"), F.lit(False))


def cap_rows(values: DataFrame, value: str, limits: DataFrame, key: str) -> DataFrame:
    """By stage: how many documents are below, at and above its limit, and the share above. limits(key, limit): a few rows; stages without values have nulls."""
    v = F.col(value)
    n = limits.join(values, key, "left").groupBy(key, "limit").agg(F.count(v).alias("n"), F.count_if(v < F.col("limit")).alias("below"), F.count_if(v == F.col("limit")).alias("at"), F.count_if(v > F.col("limit")).alias("above"))
    some = F.col("n") > 0
    return n.select(key, "limit", *(F.when(some, F.col(c)).alias(c) for c in ("below", "at", "above")), F.try_divide("above", "n").alias("binding_rate"), some.alias("applicable"))


def sweep(rows: DataFrame, keys: list[str], *, medians: tuple = (), p90: tuple = (), p95: tuple = (), stdev: tuple = (), means: tuple = (), totals: tuple = (), most: tuple = (), least: tuple = (), every: tuple = (), some: tuple = ()) -> DataFrame:
    """The one summary that sweeps of settings share: by keys, the number of rows and the asked statistics of the named columns. Quantiles are exact and interpolated; a single row has deviation 0."""
    agg = [F.count("*").alias("runs")]
    for name, columns, f in (("stdev", stdev, lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))), ("mean", means, F.avg), ("total", totals, F.sum), ("max", most, F.max), ("min", least, F.min), ("all", every, F.bool_and), ("any", some, F.bool_or)):
        agg += [f(F.col(c)).alias(f"{name}_{c}") for c in columns]
    wanted = {f"{name}_{c}": (c, q) for name, columns, q in (("median", medians, 0.5), ("p90", p90, 0.9), ("p95", p95, 0.95)) for c in columns}
    per = rows.groupBy(*keys).agg(*agg)
    return beside(per, quantiles(rows, keys, wanted), keys) if wanted else per


def against_baseline(rows: DataFrame, baseline: DataFrame, key: str, value: str) -> DataFrame:
    """``ratio`` of the baseline's value to each row's; a key that the baseline lacks takes its first row (by key)."""
    base = baseline.select(key, F.col(value).alias("base"))
    first = base.agg(F.min_by("base", key).alias("first"))  # one row
    return rows.join(base, key, "left").crossJoin(F.broadcast(first)).withColumn("ratio", F.try_divide(F.coalesce("base", "first"), F.col(value))).drop("base", "first")


def with_totals(rows: DataFrame, facts: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Rows with aggregates of other facts under the same keys, added up before the join; without facts they are 0."""
    t = facts.groupBy(*keys).agg(*aggregates)
    new = [c for c in t.columns if c not in keys]
    return rows.join(t, keys, "left").na.fill(0, new)


def by_position(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two lists side by side, as far as the shorter one goes. Both have keys and ``position``."""
    return left.join(right, [*keys, "position"])


def clean(rows: DataFrame, baseline: DataFrame, key: str, same: tuple = (), no_more: tuple = (), no_less: tuple = ()) -> DataFrame:
    """``clean``: as good as the baseline of its key: equal, not above or not below it (by 1e-12) in the named columns, without failures."""
    names = [*same, *no_more, *no_less]
    j = rows.join(baseline.select(key, *(F.col(c).alias(f"base_{c}") for c in names)), key)
    b = lambda c: F.col(f"base_{c}")
    tests = [F.col(c) == b(c) for c in same] + [F.col(c) <= b(c) for c in no_more] + [F.col(c) >= b(c) - 1e-12 for c in no_less] + [F.col("failures") == 0]
    good = tests[0]
    for t in tests[1:]:
        good = good & t
    return j.withColumn("clean", good).drop(*(f"base_{c}" for c in names))


def boundary(rows: DataFrame, key: str, target: str) -> DataFrame:
    """By key, going down: the last clean target before the first that fails (``bad``, null if none does), and three targets between them to try next."""
    bad = rows.where("not clean").groupBy(key).agg(F.max(target).alias("bad"))
    j = rows.join(bad, key, "left")
    above = F.when(F.col("bad").isNull() | (F.col(target) > F.col("bad")), F.col(target))
    b = j.groupBy(key).agg(F.min(above).alias("good"), F.first("bad").alias("bad"))
    low = F.coalesce("bad", F.greatest(F.lit(20.0), F.col("good") - 10))
    return b.withColumn("next", F.transform(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), lambda s: F.round(F.col("good") - (F.col("good") - low) * s, 3)))


def diverse(rows: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """A sample of n rows that takes from each group in turn, in an order by digest of seed and key. The size is the feature."""
    depth = F.row_number().over(W.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key))
    return rows.withColumn("depth", depth).where(F.col("depth") <= n).orderBy("depth", group).limit(n)


def rotated(rows: DataFrame, position: str, n: int, offset: Column) -> DataFrame:
    """Positions of candidates turned round by an offset, so that none always runs first."""
    return rows.withColumn("turn", F.pmod(F.col(position) - offset, F.lit(n)))


def alternating(runs: DataFrame, document: str, number: str, candidate: str) -> DataFrame:
    """``turn``: documents of odd number run their candidates in the opposite order."""
    placed = ranking.running(runs, [document], [F.col(candidate)])
    turn = F.when(F.pmod(F.col(number), F.lit(2)) == 1, F.col("total") - F.col("upto") + 1).otherwise(F.col("upto"))
    return placed.withColumn("turn", turn.cast("int")).select(*(F.col(f"`{c}`") for c in runs.columns), "turn")


def by_type_rank(rows: DataFrame, kind: str, name: str, ranks: list[str]) -> DataFrame:
    """In the order of types as listed, then by lower-case name."""
    return rows.orderBy(F.array_position(F.array(*map(F.lit, ranks)), F.col(kind)), F.lower(name), name)


def fallback_state(false_accept: Column, fallback: Column, valid: Column) -> Column:
    return F.when(false_accept, "false accept").when(fallback, "fallback").when(valid, "correct").otherwise("unclassified")


def gate_quality(rows: DataFrame, *keys: str) -> DataFrame:
    """A check-digit gate: found and exact rates, how many pass it, how many of those are right, and how many wrong ones it lets through. Rows: found, exact, valid (null: not checked), seconds."""
    n, p = F.count("*"), F.count_if("valid")
    rates = rows.groupBy(*keys).agg(n.alias("n"), F.avg(F.col("found").cast("double")).alias("found_rate"), F.avg(F.col("exact").cast("double")).alias("exact_rate"), F.try_divide(p, n).alias("coverage"), F.try_divide(F.count_if(F.col("valid") & F.col("exact")), p).alias("precision"), F.try_divide(F.count_if(F.col("valid") & ~F.col("exact")), n).alias("wrong_accept_rate"), F.avg("seconds").alias("mean_seconds"))
    return beside(rates, quantiles(rows, [*keys], {"median_seconds": ("seconds", 0.5), "p95_seconds": ("seconds", 0.95)}), [*keys])


def first_of_signature(rows: DataFrame, keys: list[str], signature: str, order: str) -> DataFrame:
    """Targets that repeat the tensor shapes of a greater one are left out."""
    n = F.row_number().over(W.partitionBy(*keys, signature).orderBy(F.desc(order)))
    return rows.withColumn("n", n).where("n = 1").drop("n")


def settings_difference(old: DataFrame, new: DataFrame, expected: DataFrame) -> DataFrame:
    """setting, previous, now, classification: same, known (among ``expected``), changed, added or removed."""
    j = old.select("setting", F.col("value").alias("previous")).join(new.select("setting", F.col("value").alias("now")), "setting", "full").join(expected.select("setting", F.lit(True).alias("known")), "setting", "left")
    same = F.col("previous").eqNullSafe(F.col("now"))
    kind = F.when(same, "same").when(F.col("known"), "known").when(F.col("previous").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return j.select("setting", "previous", "now", kind.alias("classification"))


def progress(steps: DataFrame, *keys: str) -> DataFrame:
    """Annotation by document: steps done of all, and the first one that is not (by position)."""
    open_ = F.min(F.when(~F.col("done"), F.struct("position", "step")))
    return steps.groupBy(*keys).agg(F.count("*").alias("steps"), F.count_if("done").alias("done"), open_["step"].alias("next_step"))


def bad_states(rows: DataFrame) -> DataFrame:
    """Annotated fields that contradict their state: a value without text, or text where there is none."""
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    issue = F.when(~F.coalesce(F.col("state").isin("value", "empty", "unreadable"), F.lit(False)), "unknown state").when((F.col("state") == "value") & blank, "value without text").when((F.col("state") != "value") & ~blank, "text without value")
    return rows.withColumn("issue", issue).where("issue is not null")


def workload(configurations: DataFrame) -> DataFrame:
    """Requests that a set of configurations will send. Rows: warmups, repeats, documents, concurrency."""
    return configurations.agg(F.count("*").alias("configurations"), F.sum((F.col("warmups") + F.col("repeats")) * F.col("documents") * F.col("concurrency")).cast("long").alias("requests"))


def aligned(side: Column) -> Column:
    """The nearest multiple of 32, at least 32."""
    return F.greatest(F.floor(side / 32 + 0.5) * 32, F.lit(32)).cast("long")


def pixel_scale(percent: Column) -> Column:
    """Scale of each side for a share of the pixels."""
    return F.sqrt(percent / 100)


def first_record(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The first row of each key in an order that is unique; no group is sorted."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def stage_shares(rows: DataFrame, whole: str, stage: str, value: str) -> DataFrame:
    """``v`` (summed by stage), ``share`` of the whole."""
    g = rows.groupBy(whole, stage).agg(F.sum(value).alias("v"))
    return g.withColumn("share", F.try_divide(F.col("v"), F.sum("v").over(W.partitionBy(whole))))


def against_one(rows: DataFrame, key: str, base, value: str) -> DataFrame:
    """``speedup``: the value of one named row by each row's."""
    one = rows.where(F.col(key) == base).agg(F.max(value).alias("__base"))  # one row
    return rows.crossJoin(F.broadcast(one)).withColumn("speedup", F.try_divide("__base", value)).drop("__base")


def other_time(rows: DataFrame, key: str, stage: str, value: str, explained: tuple[str, ...]) -> DataFrame:
    """By key: what of all time the named stages leave, at least 0."""
    part = F.coalesce(F.sum(F.when(F.col(stage).isin(*explained), F.col(value))), F.lit(0.0))
    return rows.groupBy(key).agg(F.greatest(F.lit(0.0), F.sum(value) - part).alias("other"))


def hypothetical_calls(groups: DataFrame, n: str, caps: list[int], *keys: str) -> DataFrame:
    """By key and cap: calls that groups of n items would take at that many a call, and groups over it."""
    g = groups.select(*keys, n, F.explode(F.array(*(F.lit(c).cast("long") for c in caps))).alias("cap"))
    return g.groupBy(*keys, "cap").agg(F.sum(F.ceil(F.col(n) / F.col("cap"))).cast("long").alias("calls"), F.count_if(F.col(n) > F.col("cap")).alias("over_cap"))
