"""Nested stages of a trace: who runs inside whom, own time, time that no stage explains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(spans: DataFrame, trace: str) -> DataFrame:
    """``spans`` (trace, stage, start, end) with ``parent`` (the stage that encloses it most closely, null for none), ``level`` (0 for none) and ``own`` (its length less its direct children's).

    A trace's spans, sorted by start and then by later end, are folded over a stack of open
    ones; no pairs are made. Spans of one trace must be nested or apart; equal ones nest in
    the order of their stages. A trace has to fit a row, a long run is cut into traces first.
    """
    x = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("less"), "stage", "end")))
    rows = spans.groupBy(trace).agg(x.alias("x"))
    none = lambda fields: F.array().cast(f"array<struct<{fields}>>")
    empty = F.struct(none("i:int,end:double,stage:string,inside:double").alias("open"), none("name:string,level:int").alias("place"), none("i:int,inside:double").alias("done"))
    opened = lambda i, end, stage, inside: F.struct(i.alias("i"), end.alias("end"), stage.alias("stage"), inside.alias("inside"))
    closed = lambda some: F.transform(some, lambda o: F.struct(o["i"], o["inside"]))

    def step(a: Column, s: Column) -> Column:
        end, length = s["end"].cast("double"), (s["end"] - s["start"]).cast("double")
        around = lambda o: (o["end"] > s["start"]) & (o["end"] >= end)
        held = F.filter(a["open"], around)
        n = F.size(held)
        # the innermost open one is the parent: its children's time grows
        grown = F.transform(held, lambda o, j: opened(o["i"], o["end"], o["stage"], o["inside"] + F.when(j == n - 1, length).otherwise(0.0)))
        own = opened(F.size(a["place"]), end, s["stage"], F.lit(0.0))
        place = F.struct(F.try_element_at(held, F.lit(-1))["stage"].alias("name"), n.alias("level"))
        return F.struct(F.concat(grown, F.array(own)).alias("open"), F.concat(a["place"], F.array(place)).alias("place"), F.concat(a["done"], closed(F.filter(a["open"], lambda o: ~around(o)))).alias("done"))

    last = lambda a: F.struct(a["place"].alias("place"), F.array_sort(F.concat(a["done"], closed(a["open"]))).alias("done"))
    folded = rows.select(trace, "x", F.aggregate("x", empty, step, last).alias("f"))
    each = folded.select(trace, F.explode(F.arrays_zip("x", F.col("f.place").alias("place"), F.col("f.done").alias("done"))).alias("r"))
    return each.select(trace, F.col("r.x.stage").alias("stage"), F.col("r.x.start").alias("start"), F.col("r.x.end").alias("end"), F.col("r.place.name").alias("parent"), F.col("r.place.level").alias("level"), ((F.col("r.x.end") - F.col("r.x.start")).cast("double") - F.col("r.done.inside")).alias("own"))


def profile(measured: DataFrame, group: list[str]) -> DataFrame:
    """By group and metric: the median of repeats (0 where a repeat lacks it) and its percentage of the median total. measured: group columns, repeat, total, times (a map)."""
    names = measured.groupBy(*group).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("times"))))).alias("names"), F.percentile("total", 0.5).alias("total"))
    each = measured.drop("total").join(names, group).select(*group, "total", "times", F.explode("names").alias("metric"))
    out = each.groupBy(*group, "metric", "total").agg(F.percentile(F.coalesce(F.try_element_at("times", F.col("metric")).cast("double"), F.lit(0.0)), 0.5).alias("median"))
    return out.select(*group, "metric", "median", F.try_divide(100 * F.col("median"), F.col("total")).alias("percent"))


def unit_costs(stages: DataFrame) -> DataFrame:
    """Rows (seconds, calls, inputs, ...) with seconds_per_call and seconds_per_input; null where there were none."""
    return stages.withColumns({"seconds_per_call": F.try_divide(F.col("seconds").cast("double"), F.col("calls")), "seconds_per_input": F.try_divide(F.col("seconds").cast("double"), F.col("inputs"))})


def residual(spans: DataFrame, trace: str, total: DataFrame) -> DataFrame:
    """trace, explained (the spans that no other encloses), other: what of the total they leave, at least 0. Nested stages count once, in the stage around them."""
    top = nested(spans, trace).where("level = 0").groupBy(trace).agg(F.sum((F.col("end") - F.col("start")).cast("double")).alias("explained"))
    j = total.join(top, trace, "left").na.fill(0.0, ["explained"])
    return j.select(trace, "total", "explained", F.greatest(F.lit(0.0), F.col("total") - F.col("explained")).alias("other"))
