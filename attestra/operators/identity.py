"""Identity documents: licence records, required fields, confidence, field results, sides of a card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.operators.tasks import spread

# Names of annotated boxes on licences, and the fields they feed.
ALIASES = {
    "name": "given_names", "place_of_birth": "birth_place", "date_of_birth": "birth_date", "date_of_issue": "issue_date", "date_of_expiry": "expiry_date", "place_of_issue": "issued_place",
    "id_number": "personal_id", "id_number_2": "license_number", "place_of_living": "address", "types": "categories",
}
# The fields of a licence.
LICENCE = "surname given_names patronymic birth_place birth_date issue_date expiry_date issued_place personal_id license_number address categories serial_number".split()
# Fixed value: a date with the day first.
BIRTH_DATE = r"(?<!\d)(?:0?[1-9]|[12]\d|3[01])[./-](?:0?[1-9]|1[0-2])[./-]\d{4}(?!\d)"


def canonical(field: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, field), field)


def birth_line(value: Column) -> tuple[Column, Column]:
    """(place, date) of a line that holds both; without a date all of it is the place."""
    date = F.regexp_extract(value, f"({BIRTH_DATE})", 1)
    place = F.when(date == "", value).otherwise(F.rtrim(F.call_function("substring_index", value, date, F.lit(1))))
    return place, F.when(date != "", date)


def licence_records(tokens: DataFrame) -> DataFrame:
    """One row for each document with the fields of its licence. tokens: doc_id, box, box_pos (order of the boxes), token (its number in the document), text, center_y, x1. A token that several boxes hold counts for the first; boxes of one field are read together, from top to bottom and left to right."""
    first = W.partitionBy("doc_id", "token").orderBy("box_pos")
    t = spread(tokens, "doc_id").withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("field", canonical(F.col("box"))).where(F.coalesce("text", F.lit("")) != "")
    order = F.array_sort(F.collect_list(F.struct("center_y", "x1", "token", "text")))
    raw = t.groupBy("doc_id", "field").agg(F.array_join(F.transform(order, lambda x: x["text"]), " ").alias("raw"))
    wide = raw.groupBy("doc_id").pivot("field", LICENCE).agg(F.first("raw"))
    place, date = birth_line(F.col("birth_place"))
    wide = wide.withColumns({"birth_place": place, "birth_date": F.coalesce("birth_date", date)})
    return wide.select("doc_id", *(F.when(F.col(c) != "", F.col(c)).alias(c) for c in LICENCE))


def required(fields: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id, status, missing: required fields without a value. fields(doc_id, document_type, field, value); profile(document_type, field, field_pos, required)."""
    need = profile.where("required").select("document_type", "field", "field_pos")
    docs = fields.select("doc_id", "document_type").distinct().join(need, "document_type", "left")
    seen = fields.where(F.coalesce("value", F.lit("")) != "").select("doc_id", "field", F.lit(True).alias("there"))
    gap = F.when(F.col("field").isNotNull() & F.col("there").isNull(), F.struct("field_pos", "field"))
    j = docs.join(seen, ["doc_id", "field"], "left").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(gap)), lambda x: x["field"]).alias("missing"))
    return j.select("doc_id", F.when(F.size("missing") > 0, "warning").otherwise("passed").alias("status"), F.array_join("missing", ", ").alias("missing"))


def field_results(fields: DataFrame, evidence: DataFrame, profile: DataFrame) -> DataFrame:
    """Every field of a document's profile with its value, raw text, confidence and box; null where nothing was read."""
    docs = fields.select("doc_id", "document_type").distinct().join(profile.select("document_type", "field", "region", "field_pos"), "document_type")
    return docs.join(fields.drop("document_type"), ["doc_id", "field"], "left").join(evidence, ["doc_id", "field"], "left")


def document_confidence(regions: DataFrame, document: str) -> DataFrame:
    """The least confidence of a document's regions; null if any is unknown."""
    return regions.groupBy(document).agg(F.when(F.count_if(F.col("confidence").isNull()) == 0, F.min("confidence")).alias("confidence"))


def swapped_sides(sides: DataFrame) -> DataFrame:
    """Cards whose pictures look like the other side's: doc_id, side (as given), seen (as recognised). Swapped if both are seen and each is the other; otherwise a mismatch of one side is a warning."""
    other = F.count_if(F.col("seen") != F.col("side"))
    known = F.count_if(F.col("seen").isNotNull())
    return sides.groupBy("doc_id").agg(F.when((known == 2) & (other == 2), "swapped").when(other > 0, "one side differs").when(known < 2, "not seen").otherwise("passed").alias("status"))


def double_ownership(front: DataFrame, back: DataFrame) -> DataFrame:
    """Fields that both sides of one card claim: an error each."""
    return front.select("document_type", "field").intersect(back.select("document_type", "field"))


def profile_issues(profile: DataFrame, rois: DataFrame) -> DataFrame:
    """What is wrong with layout profiles: names that repeat, fields without a region, regions without a field, rectangles outside the page."""
    key = ["document_type", "field"]
    rule = lambda name, df: df.select(F.lit(name).alias("issue"), *key)
    bad = ~((F.col("x1") >= 0) & (F.col("x1") < F.col("x2")) & (F.col("x2") <= 1) & (F.col("y1") >= 0) & (F.col("y1") < F.col("y2")) & (F.col("y2") <= 1))
    return rule("repeated field", profile.groupBy(*key).count().where("count > 1")).unionByName(rule("no region", profile.join(rois, key, "left_anti").distinct())).unionByName(rule("no field", rois.join(profile, key, "left_anti").distinct())).unionByName(rule("bad rectangle", rois.where(bad)))
