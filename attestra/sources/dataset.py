"""Labelled datasets in a folder: files by listing, documents by the grammar of their paths, annotations as VARIANT, labels with a manifest.

    <type>/<id>.<image>            a document of one picture
    <type>/<id>/<side>.<image>     a document of several
    annotations/**/*.json          what was noted down about it

A listing reads no file's bytes; digests read each once, on the executors. Spark's reader
skips files without any byte.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What counts as a picture, and the pictures of each type of document (in the order of reports).
EXTENSIONS = ("jpg", "jpeg", "png", "webp")
ROLES = {"passport": ("image",), "id_card": ("front", "back"), "driving_license": ("image",)}


def _bare(path: str | Column) -> str | Column:
    """A path without its scheme."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*:/+"
    return re.sub(pattern, "/", path) if isinstance(path, str) else F.regexp_replace(path, pattern, "/")


def _files(spark: SparkSession, root: str) -> DataFrame:
    start = len(_bare(root).rstrip("/")) + 2
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return f.withColumn("file", F.substr(_bare(F.col("path")), F.lit(start)))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """file (its path from the root on), length."""
    return _files(spark, root).select("file", "length")


def digests(spark: SparkSession, root: str) -> DataFrame:
    """file, sha256 of every picture."""
    f = _files(spark, root).where(F.lower(F.col("file")).rlike(r"\.(" + "|".join(EXTENSIONS) + ")$"))
    return f.select("file", F.sha2("content", 256).alias("sha256"))


def annotations(spark: SparkSession, root: str) -> DataFrame:
    """file, text of every annotation, broken ones too."""
    f = _files(spark, root).where(F.col("file").rlike(r"^annotations/.*\.json$"))
    return f.select("file", F.decode("content", "utf-8").alias("text"))


def _pictures(files: DataFrame) -> DataFrame:
    """document_type, id, name (below the type), file and stem of the pictures of known types."""
    p = F.split("file", "/")
    f = files.select("file", p.alias("p")).where(F.col("p")[0].isin(*ROLES) & F.lower(F.element_at("p", -1)).rlike(r".\.(" + "|".join(EXTENSIONS) + ")$"))
    return f.withColumn("stem", F.regexp_replace(F.element_at("p", -1), r"\.[^.]*$", "")).withColumn("document_type", F.col("p")[0])


def discovered(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: document_type, id, images by role; problems: issue, document_type, id, detail).

    Problems: a second picture for an id, a side missing or given twice, an id that two
    types have. Documents sort by ``place`` and lower-cased id.
    """
    single = [k for k, roles in ROLES.items() if len(roles) == 1]
    several = {k: roles for k, roles in ROLES.items() if len(roles) > 1}
    pics = _pictures(files)
    turn = F.row_number().over(W.partitionBy("document_type", "stem").orderBy(F.lower("file"), "file"))
    ones = pics.where(F.col("document_type").isin(single) & (F.size("p") == 2)).withColumn("turn", turn)
    problem = lambda df, issue, detail=None: df.select(F.lit(issue).alias("issue"), "document_type", "id", (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))
    twice = problem(ones.where("turn > 1").withColumnRenamed("stem", "id"), "duplicate id")
    docs = ones.where("turn = 1").select("document_type", F.col("stem").alias("id"), F.create_map(F.lit(ROLES[single[0]][0]), "file").alias("images"))
    for kind, roles in several.items():
        at = files.select("file", F.split("file", "/").alias("p")).where((F.col("p")[0] == kind) & (F.size("p") >= 3)).select(F.col("p")[1].alias("id")).distinct()
        seen = pics.where((F.col("document_type") == kind) & (F.size("p") == 3)).select(F.col("p")[1].alias("id"), F.lower("stem").alias("role"), "file")
        each = at.join(seen.where(F.col("role").isin(*roles)), "id", "left").groupBy("id").agg(*(F.count_if(F.col("role") == r).alias(f"n_{r}") for r in roles), F.array_sort(F.collect_list(F.when(F.col("role").isNotNull(), F.struct("role", "file")))).alias("found"))
        each = each.withColumn("document_type", F.lit(kind))
        for r in roles:
            twice = twice.unionByName(problem(each.where(F.col(f"n_{r}") != 1), "missing or duplicate side", F.concat(F.when(F.col(f"n_{r}") == 0, "missing ").otherwise("duplicate "), F.lit(r))))
        whole = each.where(" and ".join(f"n_{r} = 1" for r in roles))
        docs = docs.unionByName(whole.select("document_type", "id", F.map_from_entries("found").alias("images")))
    clash = docs.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("document_type")), ", ").alias("types")).where("n > 1").withColumn("document_type", F.lit(None).cast("string"))
    place = F.array_position(F.array(*map(F.lit, ROLES)), F.col("document_type"))
    return docs.withColumn("place", place), twice.unionByName(problem(clash, "duplicate logical id", F.col("types")))


def labelled_samples(manifest: DataFrame, labels: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, problems) of a manifest (line, image, label_id, source_image, variant, augmentation types as an array) with labels (label_id, lines) and the files there are. A line without its label or picture is a problem, not a sample; a missing variant is ``unknown``, a line without augmentation ``original``."""
    own = F.coalesce(F.nullif("label_id", F.lit("")), F.nullif("source_image", F.lit("")))
    m = manifest.withColumn("label", own).withColumn("variant", F.coalesce("variant", F.lit("unknown")))
    m = m.withColumn("augmentation", F.when(F.size("augmentation") > 0, F.col("augmentation")).otherwise(F.when(F.col("augmentation").isNull(), F.array(F.lit("original"))).otherwise(F.array(F.lit("augmented")))))
    known = labels.where(F.size("lines") > 0).select(F.col("label_id").alias("label"), "lines")
    j = m.join(known, "label", "left").join(files.select(F.col("file").alias("image"), F.lit(True).alias("there")), "image", "left")
    issue = F.when(F.col("lines").isNull(), "label not found").when(F.col("there").isNull(), "missing picture")
    j = j.withColumn("issue", issue)
    empty = labels.where(F.coalesce(F.size("lines"), F.lit(0)) <= 0).select(F.lit(None).cast("long").alias("line"), F.lit("empty label").alias("issue"), F.col("label_id").alias("detail"))
    problems = j.where("issue is not null").select(F.col("line").cast("long").alias("line"), "issue", F.when(F.col("issue") == "missing picture", F.col("image")).otherwise(F.col("label")).alias("detail")).unionByName(empty)
    return j.where("issue is null").select("line", "image", F.col("label").alias("label_id"), "lines", "variant", "augmentation"), problems


def inventory(spark: SparkSession, root: str, formats: tuple[str, ...] = ("json", "jsonl", "csv")) -> DataFrame:
    """file, format, length of the artifacts under a folder; nothing is read but the listing."""
    kind = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    return listing(spark, root).withColumn("format", kind).where(kind.isin(*formats)).select("file", "format", "length")


def inputs(files: DataFrame, layouts: DataFrame, extensions: tuple[str, ...] = ("bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp")) -> tuple[DataFrame, DataFrame]:
    """(samples: place, layout, document_type, side, key, file; problems: layout, detail) of pictures to annotate.

    layouts: place, layout, document_type, input_directory, pair_sides (null for single
    pictures). A paired layout has a folder for each pair with exactly one picture for each
    side. Samples sort by place, lower-cased name of the folder or file, and side.
    """
    picture = F.lower("name").rlike(r".\.(" + "|".join(extensions) + ")$")
    f = files.select("file", F.split("file", "/").alias("p")).select("file", F.col("p")[0].alias("input_directory"), F.when(F.size("p") == 3, F.col("p")[1]).alias("pair"), F.element_at("p", -1).alias("name"), F.size("p").alias("deep"))
    f = f.join(layouts, "input_directory")
    single = f.where("pair_sides is null and deep = 2").where(picture)
    one = single.select("place", "layout", "document_type", F.lit(None).cast("string").alias("side"), F.concat_ws(":", "document_type", "name").alias("key"), "file", F.lower("name").alias("order"))
    both = f.where("pair_sides is not null")
    loose = both.where("deep = 2").select("layout", F.concat(F.lit("not in a folder of its own: "), F.col("name")).alias("detail"))
    pairs = both.where("deep = 3")
    sides = pairs.select("layout", "document_type", "place", "pair", F.explode("pair_sides").alias("side")).distinct()
    stem = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    seen = pairs.where(picture).select("layout", "pair", stem.alias("side"), "file")
    each = sides.join(seen, ["layout", "pair", "side"], "left").groupBy("place", "layout", "document_type", "pair", "side").agg(F.count("file").alias("n"), F.min("file").alias("file"))
    good = each.where("n = 1").select("place", "layout", "document_type", "side", F.concat_ws(":", "document_type", "pair", "side").alias("key"), "file", F.lower("pair").alias("order"))
    bad = each.where("n <> 1").select("layout", F.concat_ws(" ", F.when(F.col("n") == 0, "missing").otherwise("duplicate"), F.col("side"), F.lit("in"), F.col("pair")).alias("detail"))
    return one.unionByName(good), loose.unionByName(bad)


def in_report_order(documents: DataFrame) -> DataFrame:
    """By type, in the order of reports, then by lower-cased id; ``place`` is the type's."""
    return documents.orderBy("place", F.lower("id"), "id")
