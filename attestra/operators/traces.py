"""Traces of calls and lines: tensor shapes, padding, crops with their lines, zones line by line, reports on fields and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.evaluation import ACCEPTED, transition


def call_shapes(calls: DataFrame, sources: str = "sources", inputs: str = "inputs", transformed: str = "transformed") -> DataFrame:
    """Statistics of each call's nested shapes (arrays of h, w): batch_size, largest sides, area of the sources, and of the padded inputs with the share that holds content; of calls whose inputs aren't known the share by ratios of width to height instead. No rows are unfolded."""
    area = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["h"].cast("long") * x["w"])
    side = lambda k: F.array_max(F.transform(sources, lambda x: x[k])).alias(f"max_{'height' if k == 'h' else 'width'}")
    ratios = F.transform(sources, lambda x: x["w"] / F.greatest(F.lit(1), x["h"]))
    known, padded = F.col(transformed), area(F.col(inputs))
    by_ratio = F.coalesce(F.try_divide(F.aggregate(ratios, F.lit(0.0), lambda a, r: a + r), F.array_max(ratios) * F.size(ratios)), F.lit(1.0))
    return calls.select(
        *(c for c in calls.columns if c not in (sources, inputs, transformed)), F.size(inputs).alias("batch_size"), side("h"), side("w"), area(F.col(sources)).alias("area"), F.when(known, padded).alias("padded_area"),
        F.when(known, F.try_divide(area(F.col(sources)).cast("double"), padded)).alias("efficiency"), F.when(~known, by_ratio).alias("ratio_efficiency"),
    )


def padding_report(crops: DataFrame, *groups: str) -> DataFrame:
    """By group: crops, useful and padded pixels and their ratio, batches, and how many batches have each size and how many crops each tensor shape (sorted ``size:count`` texts). crops: batch, useful, padded, tensor_h, tensor_w."""
    per_batch = crops.groupBy(*groups, "batch").agg(F.count("*").alias("n"), F.sum("useful").alias("useful"), F.sum("padded").alias("padded"))
    total = per_batch.groupBy(*groups).agg(F.sum("n").alias("crops"), F.sum("useful").alias("useful"), F.sum("padded").alias("padded"), F.count("*").alias("batches"))
    shown = lambda key, n: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, F.col(n)))), lambda x: F.concat(F.concat_ws("x", *(x[k].cast("string") for k in key)), F.lit(":"), x[n].cast("string"))), " ")
    sizes = per_batch.groupBy(*groups, "n").agg(F.count("*").alias("k")).groupBy(*groups).agg(shown(["n"], "k").alias("batch_sizes"))
    shapes = crops.groupBy(*groups, "tensor_h", "tensor_w").agg(F.count("*").alias("k")).groupBy(*groups).agg(shown(["tensor_h", "tensor_w"], "k").alias("shapes"))
    return total.join(sizes, list(groups)).join(shapes, list(groups)).withColumn("efficiency", F.try_divide(F.col("useful").cast("double"), F.col("padded")))


def with_lines(crops: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Crops with ``line_crops`` (structs of all other columns of lines, by line_index) and their number; none is an empty list."""
    fields = ["line_index", *(c for c in lines.columns if c not in (key, "line_index"))]
    held = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("line_crops"))
    n = F.coalesce(F.size("line_crops"), F.lit(0))
    return crops.join(held, key, "left").withColumn("line_crop_count", F.when(F.col("line_crops").isNull(), 0).otherwise(n))


def line_metrics(rows: DataFrame, expected: str, seen: str) -> DataFrame:
    """Rows with the metrics of two lists of lines: exact, line_rate (expected lines met at their place), line_errors (edits by line, a missing one empty), distance and char_rate of the joined texts. A missing list is empty."""
    none = F.array().cast("array<string>")
    e, a = F.coalesce(expected, none), F.coalesce(seen, none)
    pairs = F.slice(F.zip_with(e, a, lambda x, y: F.struct(x.alias("e"), F.coalesce(y, F.lit("")).alias("a"), y.isNotNull().alias("there"))), F.lit(1), F.size(e))
    met = F.size(F.filter(pairs, lambda p: p["there"] & (p["e"] == p["a"])))
    errors = F.aggregate(pairs, F.lit(0), lambda n, p: n + F.levenshtein(p["e"], p["a"]))
    te, ta = F.array_join(e, "\n"), F.array_join(a, "\n")
    distance = F.levenshtein(te, ta)
    return rows.withColumns({
        "exact": e == a, "exact_lines": met, "line_total": F.size(e), "line_rate": met / F.greatest(F.lit(1), F.size(e)), "line_errors": errors,
        "distance": distance, "char_rate": F.greatest(F.lit(0.0), 1 - distance / F.greatest(F.lit(1), F.char_length(te), F.char_length(ta))),
    })


def line_transitions(rows: DataFrame, truth: str, before: str, after: str, *groups: str) -> DataFrame:
    """By group: both_correct, regression, improvement, both_wrong over the truth's lines, by position in two runs; a missing line is empty. With what could be judged and the net change."""
    none = F.array().cast("array<string>")
    at = lambda c: F.coalesce(F.get(F.coalesce(c, none), F.col("i")), F.lit(""))
    each = rows.select(*groups, before, after, F.posexplode(truth).alias("i", "line"))
    tr = transition(F.col("line") == at(F.col(before)), F.col("line") == at(F.col(after)))
    n = each.groupBy(*groups).agg(*(F.count_if(tr == x).alias(x.lower()) for x in ("BOTH_CORRECT", "REGRESSION", "IMPROVEMENT", "BOTH_WRONG")), F.count("*").alias("evaluable"))
    return n.withColumn("net_change", F.col("improvement") - F.col("regression"))


def named_seconds(rows: DataFrame, times: str, names: tuple[str, ...], *groups: str) -> DataFrame:
    """By group: the sum of some stages of a map over rows that have one; what a row lacks is 0."""
    each = sum((F.coalesce(F.try_element_at(times, F.lit(n)).cast("double"), F.lit(0.0)) for n in names), F.lit(0.0))
    return rows.where(F.col(times).isNotNull()).groupBy(*groups).agg(F.sum(each).alias("seconds"))


def difficulty(documents: DataFrame, reference: str, keys: list[str], easy: float = 0.9, hard: float = 0.5) -> DataFrame:
    """Mean accuracy and number of documents by type, bucket (how the reference configuration did on the document) and configuration. documents: keys (the first is the type), configuration, accuracy."""
    x = F.col("accuracy")
    bucket = F.when(x >= easy, "easy").when(x < hard, "hard").otherwise("mixed")
    base = documents.where(F.col("configuration") == reference).groupBy(*keys).agg(F.max(x).alias("accuracy")).select(*keys, bucket.alias("bucket"))
    return documents.join(base, keys).groupBy(keys[0], "bucket", "configuration").agg(F.avg("accuracy").alias("mean"), F.countDistinct(F.struct(*keys)).alias("documents"))


def field_report(fields: DataFrame, document: str) -> DataFrame:
    """By document: configured fields, exact matches, names of matched and missing ones (sorted), sources of confidence. fields: document, field, expected, value, source."""
    names = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("field"))))
    exact = F.col("expected") == F.col("value")
    return fields.groupBy(document).agg(F.count("*").alias("configured"), F.count_if(exact).alias("exact_matches"), names(exact).alias("matched"), names(F.coalesce("value", F.lit("")) == "").alias("missing"), F.array_sort(F.collect_set("source")).alias("sources"))


def field_rows(requests: DataFrame) -> DataFrame:
    """Requests for fields with raw_exact, normalized_exact and status; a request without a result failed."""
    return requests.withColumns({"raw_exact": F.col("detected").eqNullSafe(F.col("expected")), "normalized_exact": F.coalesce(F.col("status") == "match", F.lit(False)), "status": F.coalesce("status", F.lit("request_failed"))})


def first_repeat(rows: DataFrame, *groups: str) -> DataFrame:
    """By group, of the first repeat only: fields, accepted ones, accuracy, hard failures."""
    s = F.col("status")
    n = rows.where("repeat = 1").groupBy(*groups).agg(F.count("*").alias("fields"), F.count_if(s.isin(*ACCEPTED)).alias("accepted"), F.count_if(s.isin("mismatch", "not_found")).alias("hard_failures"))
    return n.withColumn("accuracy", F.try_divide("accepted", "fields"))


def variant_changes(outputs: DataFrame, reference: str, keys: list[str]) -> DataFrame:
    """By variant, the reference's included: how many outputs (variant, keys, value) differ from the reference's, what one side lacks too."""
    base = outputs.where(F.col("variant") == reference).select(*keys, F.struct("value").alias("base"))
    variants = outputs.select("variant").distinct()
    every = variants.crossJoin(base)  # a few variants
    j = every.join(outputs.select("variant", *keys, F.struct("value").alias("own")), ["variant", *keys], "full")
    return j.groupBy("variant").agg(F.count_if(~F.coalesce(F.col("base.value"), F.lit("")).eqNullSafe(F.coalesce(F.col("own.value"), F.lit(""))) | (F.col("base").isNull() & F.col("own.value").isNotNull()) | (F.col("own").isNull() & F.col("base.value").isNotNull())).alias("changed"))


def role_batches(samples: DataFrame, split: bool, roles: tuple[str, ...] = ("visible", "mrz")) -> DataFrame:
    """``call``: the call a sample goes into, one for all or one for each role, in the order of roles; samples of other roles have none when split."""
    place = F.array_position(F.array(*map(F.lit, roles)), F.col("role"))
    return samples.withColumn("call", F.when(place > 0, place - 1) if split else F.lit(0).cast("long"))
