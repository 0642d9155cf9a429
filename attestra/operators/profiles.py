"""Promotion of annotated samples to layout profiles: boxes projected onto the canonical page, grouped by layout, and what differs from the profiles in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import geometry as g

# Fixed value: names that annotators gave a field, and the field's own.
ALIASES = {"sec": "sex"}


def _renamed(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in ALIASES.items() for x in p)), name), name)


def canonical(samples: DataFrame) -> DataFrame:
    """Samples (corners as shares of the source, data_crop, fields as a map of rectangles in shares of data_crop, original_width, original_height, canonical_width, canonical_height, coordinate_space) with ``crop`` and ``rois``: as they are where the space is canonical, else projected through the page's perspective. Degenerate corners make them null."""
    source, target = (F.col("original_width"), F.col("original_height")), (F.col("canonical_width"), F.col("canonical_height"))
    page = F.transform("corners", lambda p: g.point(p["x"] * source[0], p["y"] * source[1]))
    sheet = F.array(g.point(0, 0), g.point(target[0], 0), g.point(target[0], target[1]), g.point(0, target[1]))
    s = samples.withColumn("m", g.between(page, sheet)).withColumn("done", F.coalesce(F.col("coordinate_space") == "canonical", F.lit(False)))
    s = s.withColumn("crop", F.when(F.col("done"), g.absolute(F.struct(*(F.lit(float(v)).alias(k) for k, v in (("x1", 0), ("y1", 0), ("x2", 1), ("y2", 1)))), F.col("data_crop"))).otherwise(g.projected(F.col("data_crop"), F.col("m"), source, target)))
    moved = lambda r: g.relative(g.projected(g.absolute(r, F.col("data_crop")), F.col("m"), source, target), F.col("crop"))
    plain = lambda r: F.struct(*(r[k].cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")))
    return s.withColumn("rois", F.transform_values("fields", lambda k, r: F.when(F.col("done"), plain(r)).otherwise(moved(r)))).drop("m", "done")


def promoted(samples: DataFrame, current: DataFrame) -> DataFrame:
    """layout, region, field, required, crop, roi: the boxes of complete samples. The region is the side, or ``data_page`` without one; of several samples of a side the last (by key) counts. current: layout, field, required of the profiles in use; a new field is not required."""
    done = samples.where("status = 'complete'").withColumn("region", F.coalesce("side", F.lit("data_page")))
    last = done.groupBy("layout", "region").agg(F.max_by(F.struct(*samples.columns), "key").alias("s"))  # only these are projected
    last = canonical(last.select(F.col("region").alias("shown"), "s.*")).groupBy("layout", F.col("shown").alias("region")).agg(F.max_by(F.struct("crop", "rois"), "key").alias("s"))
    each = last.select("layout", "region", F.col("s.crop").alias("crop"), F.explode("s.rois").alias("name", "roi")).withColumn("field", _renamed(F.col("name")))
    need = current.groupBy("layout", "field").agg(F.bool_or("required").alias("required"))
    return each.join(need, ["layout", "field"], "left").select("layout", "region", "field", F.coalesce("required", F.lit(False)).alias("required"), "crop", "roi")


def anchors(samples: DataFrame) -> DataFrame:
    """layout, page_corners: where a page lies in its zone's frame, from the first complete sample (by key) that has a zone and page corners."""
    a = samples.where("status = 'complete' and zone is not null and page_corners is not null")
    first = a.groupBy("layout").agg(F.min_by(F.struct("zone", "page_corners"), "key").alias("s"))
    return first.select("layout", g.to_frame(F.col("s.zone"), F.col("s.page_corners")).alias("page_corners"))


def drift(planned: DataFrame, current: DataFrame) -> DataFrame:
    """Boxes on one side only, as whole rows: ``side`` is ``planned`` or ``current``. Both have the columns of ``promoted``."""
    shape = lambda df: df.select("layout", "region", "field", "required", F.to_json("crop").alias("crop"), F.to_json("roi").alias("roi"))
    a, b = shape(planned), shape(current)
    return a.exceptAll(b).withColumn("side", F.lit("planned")).unionByName(b.exceptAll(a).withColumn("side", F.lit("current")))


def drifted_layouts(planned: DataFrame, current: DataFrame) -> DataFrame:
    """Layouts whose profile would change, with the number of boxes that differ."""
    return drift(planned, current).groupBy("layout").agg(F.countDistinct("region", "field").alias("boxes"))
