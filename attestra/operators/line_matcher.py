"""The older matcher, for comparing the two: whole lines and pairs of lines only, no labels, shapes or zones.

An assignment is exact: the best sum over all ways to give fields disjoint lines, from all lines that
reach the least ratio (``functions.assignment``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from attestra.functions import text as tx
from attestra.functions.assignment import assigned
from attestra.functions.similarity import ratio
from attestra.operators import tasks


def line_kind(field: Column, value: Column) -> Column:
    shape = value.rlike(r"^\d{1,4}[./ -]\d{1,2}[./ -]\d{1,4}$") | (field.rlike(tx.DATE_NAME) & value.rlike(r"^(\d{6}|\d{8})$"))
    digits = F.length(F.regexp_replace(value, r"\P{Nd}", ""))
    mixed = (digits >= 2) & value.rlike(r"\p{L}")
    return F.when(shape, "date").when(field.rlike(tx.ID_NAME) | mixed, "identifier").when(field.rlike(tx.NAME_NAME), "name").otherwise("text")


def line_candidates(lines: DataFrame) -> DataFrame:
    """doc_id, cand_pos, text, used (line positions): each line, and two neighbours of one source."""
    source = F.col("source") if "source" in lines.columns else F.lit(None).cast("string")
    df = lines.select(F.col("doc_id").cast("string"), F.col("line_pos").cast("int"), F.trim("text").alias("text"), source.alias("source"))
    w = W.partitionBy("doc_id").orderBy("line_pos")
    df = df.withColumn("n", F.lead(F.struct("line_pos", "text", "source")).over(w))
    one = df.where("text <> ''").select("doc_id", F.col("line_pos").cast("long").alias("cand_pos"), "text", F.array("line_pos").alias("used"))
    pair = df.where((F.col("text") != "") & (F.col("n.text") != "") & F.col("source").eqNullSafe(F.col("n.source")))
    return one.unionByName(pair.select("doc_id", (F.col("line_pos") + F.lit(1 << 40)).alias("cand_pos"), F.concat_ws(" ", "text", "n.text").alias("text"), F.array("line_pos", "n.line_pos").alias("used")))


@F.arrow_udf(ST.ArrayType(ST.IntegerType()))
def _assigned(rows: pa.Array) -> pa.Array:
    """Places of the options that a document's fields get; options come by field, the best first."""
    out = []
    for row in (x.as_py() for x in rows):
        fields: dict[int, list] = {}
        for i, (pos, lost, used) in enumerate(zip(row["field_pos"], row["lost"], row["used"], strict=True)):
            fields.setdefault(pos, []).append((i, (-lost, tuple(used))))
        picked = assigned([[o for _, o in some] for some in fields.values()])
        out.append([some[k][0] for some, k in zip(fields.values(), picked, strict=True) if k >= 0])
    return pa.array(out, pa.list_(pa.int32()))


def verify(lines: DataFrame, expected: DataFrame, least: float = 0.35) -> DataFrame:
    """doc_id, field_pos, field, expected, detected, score, status."""
    n = tasks.tasks_of(lines, "text", 1 << 20)
    lines, expected = (df.withColumn("doc_id", F.col("doc_id").cast("string")).repartition(n, "doc_id") for df in (lines, expected))
    fields = expected.select(F.col("doc_id").cast("string"), F.col("field_pos").cast("int"), "field", F.trim(F.col("expected").cast("string")).alias("expected"))
    fields = fields.withColumn("kind", line_kind(F.col("field"), F.col("expected"))).withColumn("target", tx.normal(F.col("expected"), F.col("kind"), label=False))
    cands = line_candidates(lines)
    kinds = fields.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    forms = cands.join(kinds.hint("shuffle_hash"), "doc_id").select("doc_id", "cand_pos", "used", "text", F.explode("kinds").alias("kind"))
    forms = forms.withColumn("found", tx.normal(F.col("text"), F.col("kind"), label=False)).drop("text").where("found <> ''")
    pairs = fields.where("target <> ''").select("doc_id", "field_pos", "kind", "target").join(forms, ["doc_id", "kind"])
    a, b = F.length("target"), F.length("found")
    pairs = pairs.where(2 * F.least(a, b) >= (least - 1e-9) * (a + b))  # no ratio is above that of the shorter text found whole
    option = F.struct("field_pos", (-F.col("score")).alias("lost"), "cand_pos", "used")
    pairs = pairs.withColumn("score", ratio("target", "found")).groupBy("doc_id").agg(F.collect_list(F.when(F.col("score") >= least, option)).alias("options"))
    pairs = pairs.repartition(n, "doc_id").withColumn("options", F.array_sort("options"))  # all of them: a cap would change the best choice
    picked = _assigned(F.struct(*(F.col(f"options.{c}").alias(c) for c in ("field_pos", "lost", "used"))))
    chosen = pairs.withColumn("picked", picked).select("doc_id", F.explode_outer(F.transform("picked", lambda i: F.get("options", i))).alias("o")).select("doc_id", "o.field_pos", "o.cand_pos", (-F.col("o.lost")).alias("score"))
    got = chosen.join(cands.select("doc_id", "cand_pos", "text"), ["doc_id", "cand_pos"]).drop("cand_pos")
    out = fields.join(got, ["doc_id", "field_pos"], "left").withColumn("found", tx.normal(F.col("text"), F.col("kind"), label=False))
    return out.select("doc_id", "field_pos", "field", "expected", F.col("text").alias("detected"), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), tx.status(F.col("target"), F.col("found"), F.col("score"), F.col("kind")).alias("status"))
