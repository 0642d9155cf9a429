"""Validation of labelled datasets and layout profiles: registries of rules, one issue table.

An annotation is a JSON text read as VARIANT, so a wrong type somewhere breaks one rule and
not the row. A rule looks at one annotation and gives the details of what it finds; all rules
are one projection. What needs other rows (pictures, documents found, ids that repeat) is a
join or a grouping beside it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.tasks import spread
from attestra.sources.dataset import ROLES

# The fields of each type of document, shapes of machine-readable zones (lines, width), statuses, states.
FIELDS = {
    "passport": "type country_code passport_number surname name patronymic nationality date_of_birth sex place_of_birth date_of_issue date_of_expiry authority".split(),
    "id_card": "surname name patronymic date_of_birth date_of_issue date_of_expiry sex citizenship card_number pinfl place_of_birth place_of_issue".split(),
    "driving_license": "surname given_names patronymic birth_place birth_date issue_date expiry_date issued_place personal_id license_number address categories serial_number".split(),
}
ZONES = {"passport": (2, 44), "id_card": (3, 30)}
STATUSES = ("complete", "in_progress", "skipped")
STATES = ("value", "empty", "unreadable")


def kind(value: Column, path: str = "$") -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ... of a part of a VARIANT; VOID for JSON null, null where there is none."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, path, "variant")), "^[A-Z]+", 0)


def _text(value: Column, path: str = "$") -> Column:
    return F.when(kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def _object(value: Column, path: str = "$") -> Column:
    return F.when(kind(value, path) == "OBJECT", F.try_variant_get(value, path, "map<string,variant>"))


def _per_type(table: dict, default=None) -> Column:
    """The entry of a table by document_type."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.try_element_at(F.create_map(*pairs), F.col("document_type"))


def _entries(value: Column, path: str, entry: Callable[[Column], Column]) -> Column:
    """An object's entries as a map of plain structs."""
    return F.transform_values(_object(value, path), lambda k, x: entry(x))


def _list(value: Column, path: str) -> Column:
    return F.when(kind(value, path) == "ARRAY", F.try_variant_get(value, path, "array<variant>"))


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """``file`` and some columns, each evaluated once for a row however many filters and rules read it: no expression is moved through a generator."""
    return df.select("file", F.inline(F.array(F.struct(*columns))))


def parsed(annotations: DataFrame) -> DataFrame:
    """Annotations as plain columns: file, whole (a JSON object), id, document_type, shown_type (of any kind), images and hashes (maps to text, null for other kinds), fields (map to state and kind of value), status, notes_kind, zone_kind, lines_kind, lines (null where no text)."""
    v = F.try_parse_json("text")
    a = _once(annotations, v.alias("v")).withColumn("v", F.when(kind(F.col("v")) == "OBJECT", F.col("v")))
    v = F.col("v")
    text = lambda x: F.struct(_text(x).alias("text"))
    field = lambda x: F.struct(_text(x, "$.state").alias("state"), F.coalesce(kind(x, "$.value"), F.lit("VOID")).alias("kind"))
    return _once(
        a, v.isNotNull().alias("whole"), F.nullif(_text(v, "$.id"), F.lit("")).alias("id"), _text(v, "$.document_type").alias("document_type"), F.try_variant_get(v, "$.document_type", "string").alias("shown_type"),
        _entries(v, "$.images", text).alias("images"), _entries(v, "$.image_sha256", text).alias("hashes"), _entries(v, "$.fields", field).alias("fields"), _text(v, "$.status").alias("status"),
        kind(v, "$.notes").alias("notes_kind"), kind(v, "$.mrz").alias("zone_kind"), kind(v, "$.mrz.lines").alias("lines_kind"), F.transform(_list(v, "$.mrz.lines"), lambda x: _text(x)).alias("lines"),
    )


class Rule(NamedTuple):
    """``details`` of an annotation: an array with one entry for each thing that is wrong."""

    issue: str
    details: Callable[[], Column]




def _named(rule: Rule) -> Column:
    details = F.coalesce(rule.details(), F.array().cast("array<string>"))
    return F.transform(details, lambda x: F.struct(F.lit(rule.issue).alias("issue"), x.alias("detail")))


def _if(condition: Column, detail: Column | None = None) -> Column:
    detail = F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit("null"))
    return F.when(F.coalesce(condition, F.lit(False)), F.array(detail)).otherwise(F.array().cast("array<string>"))


def _keys(c: str) -> Column:
    return F.array_sort(F.map_keys(c))


def _listed(values: Column) -> Column:
    values = F.coalesce(values, F.array().cast("array<string>"))
    return _if(F.size(values) > 0, F.array_join(F.array_sort(values), ", "))


def _field_rule(wrong: Callable[[Column], Column]) -> Callable[[], Column]:
    """Names of the fields whose entry (state, kind of value) is wrong."""

    def details() -> Column:
        names = F.transform(F.filter(F.map_entries("fields"), lambda e: F.coalesce(wrong(e["value"]), F.lit(False))), lambda e: e["key"])
        return F.coalesce(names, F.array().cast("array<string>"))

    return details


def _known_state(field: Column) -> Column:
    return F.coalesce(field["state"].isin(*STATES), F.lit(False))


def _odd_lines() -> Column:
    return F.coalesce((F.col("zone_kind") == "OBJECT") & (F.col("lines_kind") != "ARRAY"), F.lit(False))


def _n_lines() -> Column:
    return F.coalesce(F.size("lines"), F.lit(0))


def _zone(per_line: Callable[[Column, Column], Column]) -> Callable[[], Column]:
    """A rule on the lines of a zone, for types that have one: the numbers of those that are wrong."""

    def details() -> Column:
        width = _per_type(ZONES)[1]
        wrong = F.filter(F.transform("lines", lambda x, i: F.when(F.coalesce(per_line(x, width), F.lit(False)), (i + 1).cast("string"))), lambda x: x.isNotNull())
        return F.when(width.isNotNull(), wrong)

    return details


def _stem() -> Column:
    return F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", "")


def _folder() -> Column:
    return F.substring_index(F.substring_index("file", "/", -2), "/", 1)


#: Rules on annotations that have an id and a known type.
RULES = (
    Rule("path does not match", lambda: _if((_stem() != F.col("id")) | (_folder() != F.col("document_type")))),
    Rule("invalid picture roles", lambda: _if(~F.coalesce(_keys("images") == F.array_sort(_per_type(ROLES)), F.lit(False)))),
    Rule("invalid hash roles", lambda: _if(~F.coalesce(_keys("hashes") == F.array_sort(_per_type(ROLES)), F.lit(False)))),
    Rule("fields are no object", lambda: _if(F.col("fields").isNull())),
    Rule("unknown fields", lambda: _listed(F.array_except(F.map_keys("fields"), _per_type(FIELDS)))),
    Rule("missing fields", lambda: _listed(F.array_except(_per_type(FIELDS), F.coalesce(F.map_keys("fields"), F.array().cast("array<string>"))))),
    Rule("invalid state", _field_rule(lambda e: ~_known_state(e))),
    Rule("value is no text", _field_rule(lambda e: (e["state"] == "value") & (e["kind"] != "STRING"))),
    Rule("value without state", _field_rule(lambda e: _known_state(e) & (e["state"] != "value") & (e["kind"] != "VOID"))),
    Rule("invalid status", lambda: _if(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.col("status"))),
    Rule("incomplete", lambda: _if(~F.col("status").eqNullSafe("complete"), F.col("status"))),
    Rule("missing notes", lambda: _if(F.col("status").eqNullSafe("complete") & ~F.col("notes_kind").eqNullSafe("STRING"))),
    Rule("zone lines are no list", lambda: _if(_per_type(ZONES).isNotNull() & _odd_lines())),
    Rule("number of zone lines", lambda: _if(~_odd_lines() & (_n_lines() != _per_type(ZONES)[0]), _n_lines())),
    Rule("unreadable zone line", _zone(lambda x, width: x.isNull())),
    Rule("width of zone line", _zone(lambda x, width: F.char_length(x) != width)),
    Rule("characters of zone line", _zone(lambda x, width: (x != "") & ~x.rlike("^[A-Z0-9<]+$"))),
    Rule("zone not allowed", lambda: _if(_per_type(ZONES).isNull() & F.col("zone_kind").isNotNull())),
)


def inside(path: Column) -> Column:
    """A relative path without . and .. parts; null if it leads out of the folder."""
    step = lambda at, p: F.when(at.isNull() | (p == "") | (p == "."), at).when(p != "..", F.concat(at, F.array(p))).when(F.size(at) > 0, F.slice(at, F.lit(1), F.size(at) - 1))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(~path.startswith("/"), F.array_join(parts, "/"))


def annotation_issues(annotations: DataFrame, documents: DataFrame, digests: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """issue, file (the annotation; null for documents without one), detail. annotations(file, text), documents(document_type, id, images) as discovered, digests(file, sha256)."""
    a = parsed(annotations)
    known = F.coalesce(F.col("document_type").isin(*ROLES), F.lit(False))
    row = lambda df, issue, detail: df.select(F.lit(issue).alias("issue"), "file", detail.cast("string").alias("detail"))
    first = F.when(~F.col("whole"), F.struct(F.lit("malformed").alias("issue"), F.lit("").alias("detail")))
    first = first.when(F.col("id").isNull(), F.struct(F.lit("missing id").alias("issue"), F.lit("").alias("detail")))
    first = first.when(~known, F.struct(F.lit("invalid type").alias("issue"), F.coalesce("shown_type", F.lit("null")).alias("detail")))
    good = a.where(F.col("id").isNotNull() & known)
    each = F.concat(*map(_named, rules))
    every = F.when(first.isNotNull(), F.array(first)).otherwise(each)
    out = [a.select("file", F.explode(every).alias("x")).select("x.issue", "file", "x.detail")]

    right = F.coalesce(_keys("images") == F.array_sort(_per_type(ROLES)), F.lit(False))
    declared = F.coalesce(_keys("hashes") == F.array_sort(_per_type(ROLES)), F.lit(False))
    light = good.select("file", "document_type", "id", F.when(right, F.col("images")).alias("images"), F.when(declared, F.col("hashes")).alias("hashes"))
    plain = F.transform_values("images", lambda k, x: x["text"])
    found = light.join(documents.select("document_type", "id", F.col("images").alias("there")), ["document_type", "id"])
    entries = lambda c: F.array_sort(F.map_entries(c))
    same = entries(F.coalesce(plain, F.create_map().cast("map<string,string>"))) == entries("there")
    out.append(row(found.where(~F.coalesce(same, F.lit(False))), "pictures differ from those found", F.lit("")))

    pics = light.where("images is not null").select("file", F.explode("images").alias("role", "picture"), "hashes")
    pics = pics.select("file", "role", F.col("picture.text").alias("path"), F.try_element_at("hashes", F.col("role"))["text"].alias("declared"))
    pics = pics.withColumn("at", inside(F.col("path")))
    seen = pics.join(digests.select(F.col("file").alias("at"), "sha256"), "at", "left")
    issue = F.when(F.col("path").isNull(), "picture path is no text").when(F.col("at").isNull(), "picture outside the dataset").when(F.col("sha256").isNull(), "missing picture").when(~F.col("declared").eqNullSafe(F.col("sha256")), "changed digest")
    out.append(seen.select(issue.alias("issue"), "file", F.coalesce("path", "role").alias("detail")).where("issue is not null"))

    again = a.where("id is not null").groupBy("id").count().where("count > 1").withColumn("file", F.lit(None).cast("string"))
    out.append(row(again, "repeated id", F.col("id")))
    bare = documents.select("document_type", "id").join(good.select("document_type", "id"), ["document_type", "id"], "left_anti").withColumn("file", F.lit(None).cast("string"))
    out.append(row(bare, "not annotated", F.concat_ws("/", "document_type", "id")))
    return reduce(DataFrame.unionByName, out)


# ---- layout profiles ----


def _rectangle_is_odd(v: Column) -> Column:
    side = {k: F.try_variant_get(v, f"$.{k}", "double") for k in ("x1", "y1", "x2", "y2")}
    fits = (side["x1"] >= 0) & (side["x1"] < side["x2"]) & (side["x2"] <= 1) & (side["y1"] >= 0) & (side["y1"] < side["y2"]) & (side["y2"] <= 1)
    return ~F.coalesce((kind(v) == "OBJECT") & fits, F.lit(False))


def _number(v: Column) -> Column:
    return F.coalesce(kind(v).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.lit(False))


def _odd_corner(c: Column) -> Column:
    xy = F.try_variant_get(c, "$", "array<variant>")
    return ~F.coalesce((kind(c) == "ARRAY") & (F.size(xy) == 2) & F.forall(xy, _number), F.lit(False))


def parsed_profiles(profiles: DataFrame) -> DataFrame:
    """Layout profiles as plain columns: file, whole (a JSON object), version, layout_kind, metadata_kind, width, height (null unless whole numbers), regions (name, odd, boxes_kind), rois (region, name, odd), owned (region, name, required), has_anchor, strategy, corners (whether each is odd)."""
    v = F.try_parse_json("text")
    p = _once(profiles, v.alias("v")).withColumn("v", F.when(kind(F.col("v")) == "OBJECT", F.col("v")))
    v = F.col("v")
    size = lambda c: F.when(kind(v, f"$.canonical_size.{c}") == "BIGINT", F.try_variant_get(v, f"$.canonical_size.{c}", "long"))
    region = lambda e: F.struct(e["key"].alias("name"), _rectangle_is_odd(F.try_variant_get(e["value"], "$.data_crop", "variant")).alias("odd"), kind(e["value"], "$.field_rois").alias("boxes_kind"))
    none = F.array().cast("array<struct<region:string,name:string,odd:boolean>>")
    boxes = lambda e: F.coalesce(F.transform(F.map_entries(_object(e["value"], "$.field_rois")), lambda b: F.struct(e["key"].alias("region"), b["key"].alias("name"), _rectangle_is_odd(b["value"]).alias("odd"))), none)
    owned = lambda f: F.struct(_text(f, "$.region").alias("region"), F.nullif(_text(f, "$.name"), F.lit("")).alias("name"), kind(f, "$.required").alias("required"))
    anchor = "$.document_localization"
    p = p.withColumn("entries", F.map_entries(_object(v, "$.regions")))
    return _once(
        p, v.isNotNull().alias("whole"), F.try_variant_get(v, "$.version", "double").alias("version"), kind(v, "$.layout").alias("layout_kind"), kind(v, "$.sample_metadata").alias("metadata_kind"), size("width").alias("width"), size("height").alias("height"),
        F.transform("entries", region).alias("regions"), F.flatten(F.transform("entries", boxes)).alias("rois"), F.transform(_list(v, "$.fields"), owned).alias("owned"),
        F.coalesce(kind(v, anchor) != "VOID", F.lit(False)).alias("has_anchor"), _text(v, f"{anchor}.strategy").alias("strategy"), F.transform(_list(v, f"{anchor}.page_corners_relative_to_mrz_width"), _odd_corner).alias("corners"),
    )


def _names(array: str, wrong: Callable[[Column], Column], shown: Callable[[Column], Column] = lambda x: x["name"]) -> Callable[[], Column]:
    return lambda: F.transform(F.filter(array, lambda x: F.coalesce(wrong(x), F.lit(False))), shown)


def _claims(f: Column, r: Column) -> Column:
    return r["name"].eqNullSafe(f["name"]) & r["region"].eqNullSafe(f["region"])


_FULL = lambda r: F.concat_ws("/", r["region"], r["name"])

#: Rules on layout profiles, each with its details.
PROFILE_RULES = (
    Rule("version or layout", lambda: _if(~F.coalesce((F.col("version") == 1) & (F.col("layout_kind") == "STRING"), F.lit(False)))),
    Rule("no sample metadata", lambda: _if(~F.col("metadata_kind").eqNullSafe("OBJECT"))),
    Rule("canonical size", lambda: _if(~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)))),
    Rule("no regions or fields", lambda: _if(F.coalesce(F.size("regions") <= 0, F.lit(True)) | F.coalesce(F.size("owned") <= 0, F.lit(True)))),
    Rule("region rectangle", _names("regions", lambda r: r["odd"])),
    Rule("region without boxes", _names("regions", lambda r: ~r["boxes_kind"].eqNullSafe("OBJECT"))),
    Rule("box rectangle", _names("rois", lambda r: r["odd"], _FULL)),
    Rule("field without a name", _names("owned", lambda f: f["name"].isNull(), lambda f: F.coalesce(f["region"], F.lit("null")))),
    Rule("field owned twice", lambda: F.array_distinct(_names("owned", lambda f: F.size(F.filter("owned", lambda g: g["name"] == f["name"])) > 1)())),
    Rule("required is no flag", _names("owned", lambda f: f["name"].isNotNull() & ~f["required"].eqNullSafe("BOOLEAN"))),
    Rule("field outside its region", _names("owned", lambda f: f["name"].isNotNull() & ~F.coalesce(F.exists("rois", lambda r: _claims(f, r)), F.lit(False)))),
    Rule("box without a field", _names("rois", lambda r: ~F.coalesce(F.exists("owned", lambda f: _claims(f, r)), F.lit(False)), _FULL)),
    Rule("page anchor", lambda: _if(F.col("has_anchor") & ~F.coalesce((F.col("strategy") == "mrz_anchor") & (F.size("corners") == 4), F.lit(False)))),
    Rule("anchor corners", lambda: _if((F.size("corners") == 4) & F.exists("corners", lambda odd: odd))),
)


def layout_issues(profiles: DataFrame, rules: tuple[Rule, ...] = PROFILE_RULES) -> DataFrame:
    """issue, file, detail of layout profiles (file, text as JSON): every rule, not the first that fails. Boxes belong to a region; a field must own one of its own region's."""
    p = parsed_profiles(spread(profiles))
    bad = p.where("not whole").select(F.lit("malformed").alias("issue"), "file", F.lit("").alias("detail"))
    each = F.concat(*map(_named, rules))
    return bad.unionByName(p.where("whole").select("file", F.explode(each).alias("x")).select("x.issue", "file", "x.detail"))
