"""The older search for a machine-readable zone: pieces of one row merged, candidates scored, the best combination of lines taken."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.columns import bound
from attestra.operators.tasks import spread

#: A row's pieces lie within this share of a line's height; a candidate's least length and share of a zone's characters; candidates looked at.
ROW, LEAST, SHARE, MOST = 0.65, 15, 0.65, 12
_LINE = "array<struct<text:string,score:double,x1:double,y1:double,x2:double,y2:double>>"


def _line(x: Column) -> Column:
    return F.struct(x["text"].alias("text"), *(x[c].cast("double").alias(c) for c in ("score", "x1", "y1", "x2", "y2")))


def _cy(x: Column) -> Column:
    return (x["y1"] + x["y2"]) / 2


def _height(x: Column) -> Column:
    return x["y2"] - x["y1"]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _median(values: Column) -> Column:
    v, n = F.sort_array(values), F.size(values)
    at = lambda i: F.get(v, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def rows_of_pieces(lines: Column) -> Column:
    """Lines (an array) clustered into rows, first fit in order of their centres: a line joins the first row whose mean centre is near enough for the taller of it and the row's median. Each row is read from left to right; its score is weighted by the texts' lengths."""
    order = F.array_sort(F.transform(lines, lambda x, i: F.struct(_cy(x).alias("cy"), i.alias("i"), x.alias("x"))))
    empty = F.array().cast(f"array<{_LINE}>")

    def step(rows: Column, s: Column) -> Column:
        x = s["x"]
        near = lambda r: F.abs(s["cy"] - _sum(F.transform(r, _cy)) / F.size(r)) <= F.greatest(_median(F.transform(r, _height)), _height(x)) * ROW
        joined = lambda k: F.transform(rows, lambda r, i: F.when(i + 1 == k, F.concat(r, F.array(x))).otherwise(r))
        return bound(F.array_position(F.transform(rows, near), True), lambda k: F.when(k > 0, joined(k)).otherwise(F.concat(rows, F.array(F.array(x)))))

    def merged(row: Column) -> Column:
        row = F.transform(F.array_sort(F.transform(row, lambda x, i: F.struct(x["x1"].alias("x1"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
        weight = lambda x: F.greatest(F.char_length(x["text"]), F.lit(1)).cast("double")
        side = lambda pick, c: pick(F.transform(row, lambda x: x[c])).alias(c)
        score = _sum(F.transform(row, lambda x: x["score"] * weight(x))) / _sum(F.transform(row, weight))
        return F.struct(F.array_join(F.transform(row, lambda x: x["text"]), "").alias("text"), score.alias("score"), side(F.array_min, "x1"), side(F.array_min, "y1"), side(F.array_max, "x2"), side(F.array_max, "y2"))

    return F.transform(F.aggregate(order, empty, step), merged)


def zone_share(text: Column) -> Column:
    """Share of a text's characters that a zone may have; 0 for an empty one."""
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(r"[<A-Z\p{Nd}]")).cast("double"), F.char_length(text)), F.lit(0.0))


def candidate_score(x: Column, length: Column, width: Column, height: Column) -> Column:
    """How much a line looks like a zone's line of a length: that, its characters, a filler, a wide box, a low place."""
    near = F.greatest(F.lit(0.0), 1.0 - F.abs(F.char_length(x["text"]) - length) / F.greatest(F.lit(1), length))
    return 5.0 * near + 3.0 * zone_share(x["text"]) + F.when(F.contains(x["text"], F.lit("<")), 0.5).otherwise(0.0) + 0.5 * F.least(F.lit(1.0), (x["x2"] - x["x1"]) / F.greatest(F.lit(1.0), width * 0.5)) + 0.25 * F.least(F.lit(1.0), _cy(x) / F.greatest(F.lit(1.0), height))


def _choices(count: Column, n: Column) -> Column:
    """Sets of ``count`` (1 to 3) of the first n numbers, in order."""
    of = lambda k: F.array(*(F.array(*map(F.lit, c)) for c in combinations(range(MOST), k)))
    every = F.when(count == 1, of(1)).when(count == 2, of(2)).when(count == 3, of(3))
    return F.filter(every, lambda c: F.array_max(c) < n)


def search(samples: DataFrame) -> DataFrame:
    """sample, lines (texts from top to bottom) and score of the best zone; both null without one.

    samples: sample, lines (array of text, score, x1, y1, x2, y2), lengths (of the zone's
    lines, 1 to 3 of them), width, height. Candidates are the lines and their rows; of the
    twelve that score best, every set of as many as the zone has is tried whose lines lie
    apart, and the first of the best wins. A picture is one row; pictures are spread over all
    cores first, as a small file of them comes in one split.
    """
    samples = spread(samples)
    lines = F.transform("lines", _line)
    fit = lambda x: (F.char_length(x["text"]) >= LEAST) & (zone_share(x["text"]) >= SHARE)
    s = samples.withColumn("lines", F.coalesce(lines, F.array().cast(_LINE)))
    s = s.withColumn("found", F.filter(F.concat("lines", rows_of_pieces(F.col("lines"))), fit)).withColumn("usual", F.floor(_median(F.transform("lengths", lambda v: v.cast("double")))))
    ranked = F.array_sort(F.transform("found", lambda x, i: F.struct((-candidate_score(x, F.col("usual"), F.col("width"), F.col("height"))).alias("s"), i.alias("i"), x.alias("x"))))
    s = s.withColumn("best", F.transform(F.slice(ranked, 1, MOST), lambda r: r["x"])).withColumn("count", F.size("lengths"))

    def tried(choice: Column) -> Column:
        return F.transform(F.array_sort(F.transform(choice, lambda i: F.struct(_cy(F.get("best", i)).alias("cy"), i.alias("i"), F.get("best", i).alias("x")))), lambda p: p["x"])

    def apart(t: Column) -> Column:
        gaps = F.transform(t, lambda x, i: (i == 0) | (F.abs(_cy(x) - _cy(F.get(t, i - 1))) >= 0.25 * F.greatest(_height(F.get(t, i - 1)), _height(x))))
        return F.forall(gaps, lambda ok: F.coalesce(ok, F.lit(True)))

    def rated(t: Column, k: Column) -> Column:
        return F.struct((-_sum(F.transform(t, lambda x, i: candidate_score(x, F.get("lengths", i), F.col("width"), F.col("height"))))).alias("s"), k.alias("k"), t.alias("t"))

    sets = F.filter(F.transform(_choices(F.col("count"), F.size("best")), tried), apart)
    top = s.withColumn("sets", sets).withColumn("top", F.array_min(F.transform("sets", lambda t, k: rated(t, k)))["t"])
    return top.select("sample", F.transform("top", lambda x: x["text"]).alias("lines"), (_sum(F.transform("top", lambda x: x["score"])) / F.size("top")).alias("score"))
