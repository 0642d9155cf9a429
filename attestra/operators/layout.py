"""Lines, boxes and regions: plain arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def text_lines(docs: DataFrame, keep_blank: bool = False) -> DataFrame:
    """doc_id, line_pos (before blank lines go), text."""
    df = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_pos", "text"))
    return df if keep_blank else df.where(F.trim("text") != "")


def region_table(spark: SparkSession, rois: list[tuple], width: int, height: int) -> DataFrame:
    """field, order, x1, y1, x2, y2 in pixels, of configured regions (name, order, and a rectangle in shares of the page). Halves round to even; a region keeps at least one pixel, inside the page."""
    df = spark.createDataFrame([(n, o, *map(float, r)) for n, o, *r in rois], "field string, order int, l double, t double, r double, b double")
    valid = (F.col("l") >= 0) & (F.col("t") >= 0) & (F.col("l") < F.col("r")) & (F.col("t") < F.col("b")) & (F.col("r") <= 1) & (F.col("b") <= 1)
    df = df.withColumn("ok", F.when(valid, True).otherwise(F.raise_error(F.concat(F.lit("region out of range: "), "field")).cast("boolean"))).where("ok")
    near = lambda c, n: F.least(F.greatest(F.rint(F.col(c) * n), F.lit(0.0)), F.lit(n - 1.0))
    far = lambda c, n, low: F.greatest(F.least(F.rint(F.col(c) * n), F.lit(float(n))), low + 1)
    x, y = near("l", width), near("t", height)
    return df.select("field", "order", x.alias("x1"), y.alias("y1"), far("r", width, x).alias("x2"), far("b", height, y).alias("y2"))


def _regions(tokens: DataFrame, rois: list[tuple], width: int, height: int) -> Column:
    """The configured regions as one literal array: a page has a few."""
    rows = region_table(tokens.sparkSession, rois, width, height).orderBy("order").collect()
    return F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in ("field", "order", "x1", "y1", "x2", "y2"))) for r in rows))


def first_region(tokens: DataFrame, rois: list[tuple], width: int, height: int) -> DataFrame:
    """``field``: the first region, in configured order, that holds the token's centre; null for none. rois: name, position, x1, y1, x2, y2."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    holding = F.filter(_regions(tokens, rois, width, height), lambda r: cx.between(r["x1"], r["x2"]) & cy.between(r["y1"], r["y2"]))
    return tokens.withColumn("field", F.get(holding, F.lit(0))["field"])


def in_any_region(lines: DataFrame, rois: list[tuple] | None, width: int, height: int) -> DataFrame:
    """Lines whose centre lies in some region; all of them where no regions are set."""
    return first_region(lines, rois, width, height).where("field is not null").drop("field") if rois else lines


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of box a's area that lies in box b."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x1", "x2") * side("y1", "y2") / ((a["x2"] - a["x1"]) * (a["y2"] - a["y1"]))


def best_overlap(tokens: DataFrame, rois: list[tuple], width: int, height: int, least: float) -> DataFrame:
    """``field`` and ``share``: the region that covers most of the token, the first of equals; tokens under ``least`` go."""
    box = {k: F.col(k) for k in ("x1", "y1", "x2", "y2")}
    shares = F.transform(_regions(tokens, rois, width, height), lambda r: F.struct(overlap(box, {k: r[k] for k in box}).alias("share"), (-r["order"]).alias("order"), r["field"].alias("field")))
    best = F.array_max(shares)
    return tokens.withColumn("best", best).where(F.col("best.share") >= least).select("*", F.col("best.field").alias("field"), F.col("best.share").alias("share")).drop("best")


def evidence(tokens: DataFrame, *keys: str) -> DataFrame:
    """Mean score (null scores ignored) and the box around all tokens."""
    return tokens.groupBy(*keys).agg(F.avg("score").alias("score"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def compatible(above: Column, below: Column, gap: float = 3.0, align: float = 0.35) -> Column:
    """Whether two boxes (structs, the upper first) can belong to one value."""
    height = F.greatest(F.lit(1.0), above["y2"] - above["y1"], below["y2"] - below["y1"])
    lap = F.least(above["x2"], below["x2"]) > F.greatest(above["x1"], below["x1"])
    left = F.abs(above["x1"] - below["x1"]) <= align * F.greatest(above["x2"] - above["x1"], below["x2"] - below["x1"], F.lit(1.0))
    return (below["y1"] - above["y2"] <= gap * height) & (lap | left)


def reading_text(tokens: DataFrame, *keys: str) -> DataFrame:
    """Tokens of a field joined in (center_y, x1) order."""
    order = F.array_sort(F.collect_list(F.struct("center_y", "x1", "text")))
    return tokens.where(F.col("text") != "").groupBy(*keys).agg(F.array_join(F.transform(order, lambda x: x["text"]), " ").alias("text"))


def polygon_box(polygon: Column) -> Column:
    """The box around a polygon (array of x, y); null for none."""
    side = lambda pick, c: pick(F.transform(polygon, lambda p: p[c].cast("double")))
    box = F.struct(side(F.array_min, "x").alias("x1"), side(F.array_min, "y").alias("y1"), side(F.array_max, "x").alias("x2"), side(F.array_max, "y").alias("y2"))
    return F.when(F.size(polygon) > 0, box)


def page_order(lines: DataFrame, *page: str) -> DataFrame:
    """``place`` of each line of a page, by the mean height of its polygon, then by its left end; lines of one place follow their polygons and texts."""
    mean_y, left = F.aggregate("polygon", F.lit(0.0), lambda a, p: a + p["y"]) / F.size("polygon"), F.array_min(F.transform("polygon", lambda p: p["x"]))
    return lines.withColumn("place", F.row_number().over(W.partitionBy(*page).orderBy(mean_y, left, "polygon", "text")) - 1)


def unit_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """A pixel box in shares of the page, its corners in order and inside it."""
    clamp = lambda v: F.least(F.greatest(v.cast("double"), F.lit(0.0)), F.lit(1.0))
    ends = lambda a, b, n: (clamp(F.least(a, b) / n), clamp(F.greatest(a, b) / n))
    (l, r), (t, b) = ends(x1, x2, width), ends(y1, y2, height)
    return F.struct(l.alias("x1"), t.alias("y1"), r.alias("x2"), b.alias("y2"))
