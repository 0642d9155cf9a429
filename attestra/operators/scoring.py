"""Scoring of detected values against annotated truth, and of runs against each other.

Truth rows have ``state`` (value, empty or unreadable) and ``value``; runs have
``document_id``, ``field`` and a detected value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.ranking import beside, quantiles

# Fields whose values must be right to the letter.
STRICT = "passport_number card_number pinfl personal_id license_number serial_number date_of_birth date_of_issue date_of_expiry birth_date issue_date expiry_date".split()
STRICT_PARTS = "number pinfl personal_id serial".split()
# Fixed value: a leading label, of any digits (so that it also takes the day off a dotted date).
_LABEL = r"(?i)^\s*(?:(?:\d+[A-Z]|[A-Z]\d*)[.)]|\d+[.)])\s*"


def scorable(truth: DataFrame) -> DataFrame:
    """Rows whose truth is known: a value, or known to be empty (then ``value`` is null)."""
    return truth.where(F.col("state").isin("value", "empty")).withColumn("value", F.when(F.col("state") == "value", F.col("value")))


def with_value(truth: DataFrame) -> DataFrame:
    """Rows whose truth is a value that is not empty."""
    return truth.where((F.col("state") == "value") & (F.coalesce(F.col("value").cast("string"), F.lit("")) != ""))


def measured(rows: DataFrame) -> DataFrame:
    """Successful rows of the measured phase."""
    return rows.where((F.col("phase") == "measured") & (F.col("status") == "ok"))


def strict(field: Column) -> Column:
    return field.isin(*STRICT)


def strict_by_name(field: Column) -> Column:
    """The older, wider rule: dates, and names with some word of an identifier."""
    return field.contains("date") | F.greatest(*(field.contains(p) for p in STRICT_PARTS))


def neutral(value: Column, field: Column) -> Column:
    """The evaluator's own normal form, which never asks the matcher: dates in ISO form (else their digits), identifiers without punctuation, other text by words."""
    text = F.upper(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), _LABEL, ""))
    identifier = field.isin(*STRICT) | F.greatest(*(field.contains(p) for p in STRICT_PARTS))
    whole = F.trim(text)
    packed = whole.rlike(r"^(\d{6}|\d{8})$")
    part = lambda i: F.when(packed, F.substring(whole, 2 * i + 1, 2 if i < 2 else 4)).otherwise(F.get(F.split(whole, "[./, -]+"), F.lit(i)))
    three = packed | (F.size(F.split(whole, "[./, -]+")) == 3)
    first = F.length(part(0)) == 4
    n = [part(i).try_cast("int") for i in range(3)]
    year = F.when(first, n[0]).otherwise(n[2] + F.when(n[2] < 100, 2000).otherwise(0))
    iso = F.format_string("%04d-%02d-%02d", year, n[1], F.when(first, n[2]).otherwise(n[0]))
    known = three & part(0).rlike(r"^\d+$") & part(1).rlike(r"^\d+$") & part(2).rlike(r"^\d+$")
    day = F.when(known, F.try_to_date(iso, "yyyy-MM-dd").cast("string"))
    words = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_ ]", " "), r"\s+", " "))
    return F.when(field.contains("date"), F.coalesce(day, F.regexp_replace(text, r"\P{Nd}", ""))).when(identifier, F.regexp_replace(text, r"[^\p{L}\p{N}]", "")).otherwise(words)


def neutral_status(expected: Column, detected: Column, field: Column) -> Column:
    return F.when(F.coalesce(detected, F.lit("")) == "", "not_found").when(neutral(expected, field) == neutral(detected, field), "correct").otherwise("incorrect")


def outcomes(rows: DataFrame, expected: str, seen: str, *groups: str) -> DataFrame:
    """Exact, missing and incorrect fields, and characters right of all (a field counts one at least); null is empty."""
    e, a = F.coalesce(F.col(expected), F.lit("")), F.coalesce(F.col(seen), F.lit(""))
    size = F.greatest(F.length(e), F.lit(1))
    total, right = F.sum(size).cast("long"), F.sum(size - F.levenshtein(e, a)).cast("long")
    return rows.groupBy(*groups).agg(F.count("*").alias("evaluated"), F.count_if(e == a).alias("exact"), F.count_if((e != a) & (a == "")).alias("missing"), F.count_if((e != a) & (a != "")).alias("incorrect"), right.alias("characters"), total.alias("character_total"))


def exact_documents(rows: DataFrame, expected: str, seen: str, document: str, *groups: str) -> DataFrame:
    """Documents whose every field is exact, of all."""
    same = F.coalesce(F.col(expected), F.lit("")) == F.coalesce(F.col(seen), F.lit(""))
    return rows.groupBy(*groups, document).agg(F.bool_and(same).alias("all")).groupBy(*groups).agg(F.count("*").alias("documents"), F.count_if("all").alias("exact_documents"))


def character_rates(rows: DataFrame, expected: str, seen: str, *groups: str) -> DataFrame:
    """Two more denominators of character accuracy: the longer of both texts (values only), and the expected length with errors cut off at it (upper case, without white space)."""
    e, a = F.coalesce(F.col(expected), F.lit("")), F.coalesce(F.col(seen), F.lit(""))
    longest = F.greatest(F.length(e), F.length(a))
    bare = lambda c: F.upper(F.regexp_replace(c, r"\s", ""))
    kept = F.greatest(F.length(bare(e)) - F.levenshtein(bare(e), bare(a)), F.lit(0))
    value = e != ""
    by_longest = 1 - F.sum(F.when(value, F.levenshtein(e, a))) / F.sum(F.when(value, longest))
    return rows.groupBy(*groups).agg(F.count_if(value).alias("fields"), by_longest.alias("by_longest"), (F.sum(kept) / F.sum(F.length(bare(e)))).alias("by_expected"))


def merged(scores: DataFrame, *groups: str) -> DataFrame:
    """Scores of several runs as one: counts are added up before dividing, so large runs weigh more."""
    c = ("evaluated", "exact", "characters", "character_total")
    m = scores.groupBy(*groups).agg(*(F.sum(x).cast("long").alias(x) for x in c))
    return m.select(*groups, *c, F.try_divide("exact", "evaluated").alias("exact_rate"), F.try_divide("characters", "character_total").alias("character_rate"))


def strict_audit(rows: DataFrame, *groups: str) -> DataFrame:
    """Of strict fields, by neutral status and what the matcher accepted: accepted rightly and wrongly, mismatches, not found. Rows: field, neutral_status, accepted."""
    s = F.col("neutral_status")
    return rows.where(strict(F.col("field"))).groupBy(*groups).agg(F.count("*").alias("fields"), F.count_if(s == "correct").alias("correct_accepted"), F.count_if(F.col("accepted") & (s != "correct")).alias("incorrect_accepted"), F.count_if(s == "incorrect").alias("mismatch"), F.count_if(s == "not_found").alias("not_found"))


def request_accuracy(rows: DataFrame, group: str) -> DataFrame:
    """By group and overall (null group): truth fields, evaluated ones, failed requests, statuses, accuracy, coverage and scores. Rows: status, request_status, score, raw_exact."""
    ok = (F.col("request_status") == "ok") & F.col("status").isin("match", "likely_match", "mismatch", "not_found")
    n = lambda s: F.count_if(ok & (F.col("status") == s))
    score, done = F.when(ok, F.col("score")), F.count_if(ok)
    return rows.rollup(group).agg(
        F.count("*").alias("total"), done.alias("evaluated"), (F.count("*") - done).alias("failed"), F.count_if(ok & F.col("raw_exact")).alias("raw_exact"), *(n(s).alias(s) for s in ("match", "likely_match", "mismatch", "not_found")),
        F.try_divide(n("match") + n("likely_match"), done).alias("accuracy"), F.try_divide(done, F.count("*")).alias("coverage"), F.avg(score).alias("mean_score"), F.min(score).alias("low_score"), F.max(score).alias("high_score"),
    )


def request_summary(rows: DataFrame, group: str, phases: list[str], *measures: str) -> DataFrame:
    """By group and overall: requests, successes and failures of each phase, and medians of measures over the successful ones."""
    out, values = [F.grouping_id().alias("__level")], {}
    for p in phases:
        mine, good = F.col("phase") == p, (F.col("phase") == p) & (F.col("status") == "ok")
        out += [F.count_if(mine).alias(f"{p}_requests"), F.count_if(good).alias(f"{p}_succeeded"), F.count_if(mine & ~good).alias(f"{p}_failed")]
        values |= {f"median_{p}_{m}": F.when(good, F.col(m)) for m in measures}
    if not values:
        return rows.rollup(group).agg(*out).drop("__level")
    v = rows.select(group, *(c.alias(name) for name, c in values.items()))
    wanted = {name: (name, 0.5) for name in values}
    by_group = quantiles(v, [group], wanted).withColumn("__level", F.lit(0).cast("long"))
    overall = quantiles(v, [], wanted).select(F.lit(None).cast(v.schema[group].dataType).alias(group), "*", F.lit(1).cast("long").alias("__level"))
    return beside(rows.rollup(group).agg(*out), by_group.unionByName(overall), [group, "__level"]).drop("__level")


def paired(baseline: DataFrame, candidate: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two runs by document and field: ``before`` and ``after``; what only one of them has goes."""
    return baseline.select(*keys, F.col(value).alias("before")).join(candidate.select(*keys, F.col(value).alias("after")), keys)


def winner(pairs: DataFrame, *groups: str) -> DataFrame:
    """Which of two runs is right: both, one, or none. Rows: before and after as booleans."""
    b, a = F.col("before"), F.col("after")
    return pairs.groupBy(*groups, F.when(b & a, "both").when(b, "baseline only").when(a, "candidate only").otherwise("none").alias("winner")).agg(F.count("*").alias("fields"))


def line_pairs(expected: DataFrame, seen: DataFrame, document: str) -> DataFrame:
    """Expected and seen lines by position (document, position, text): characters right of each expected line; a missing one is empty."""
    j = expected.select(document, "position", F.col("text").alias("e")).join(seen.select(document, "position", F.col("text").alias("a")), [document, "position"], "left")
    a = F.coalesce("a", F.lit(""))
    return j.groupBy(document).agg(F.count("*").alias("lines"), F.count_if(F.col("e") == a).alias("line_exact"), F.sum(F.length("e")).cast("long").alias("character_total"), F.sum(F.length("e") - F.levenshtein("e", a)).cast("long").alias("characters"))


def field_sets(expected: DataFrame, seen: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Fields that are missing, extra (also under unexpected names) or both there, by group."""
    j = expected.select(*keys, F.lit(True).alias("e")).join(seen.select(*keys, F.lit(True).alias("a")), keys, "full")
    return j.groupBy(by).agg(F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"), F.count_if(F.col("e") & F.col("a")).alias("both"))


def failure_concentration(rows: DataFrame, *groups: str) -> DataFrame:
    """Failures by type and field; fields without any are left out."""
    bad = F.count_if(~F.col("status").isin("match", "likely_match"))
    return rows.groupBy(*groups).agg(F.count("*").alias("fields"), bad.alias("failures"), (bad / F.count("*")).alias("failure_rate")).where("failures > 0")


def known_failures(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Listed cases of two runs with the likely cause. rows: before and after, statuses of the evaluator."""
    b, a = F.col("before") == "correct", F.col("after") == "correct"
    return rows.join(listed.select(*keys).distinct(), keys, "left_semi").withColumn("cause", F.when(b & ~a, "association").when(a & ~b, "localization").otherwise("recognition or image quality"))


def zone_success(rows: DataFrame, *groups: str) -> DataFrame:
    """By group: documents, those whose zone was parsed and those whose checks (an array of flags, null without a zone) all passed, as shares; null without documents."""
    parsed = F.count_if(F.coalesce(F.size("checks"), F.lit(0)) > 0)
    valid = F.count_if((F.size("checks") > 0) & F.forall("checks", lambda c: c))
    n = rows.groupBy(*groups).agg(F.count("*").alias("documents"), parsed.alias("parsed"), valid.alias("valid"))
    return n.select(*groups, "documents", F.try_divide("parsed", "documents").alias("parser_success"), F.try_divide("valid", "documents").alias("validation_success"))
