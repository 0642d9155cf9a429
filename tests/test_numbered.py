"""Numbered fields and raw zones: each rule's case."""

import pytest
from pyspark.sql import functions as F

from attestra.functions import numbered as N

WIDE = [
    ("surname", " 1 . -  HOLM  BERG ", ("HOLM BERG", None)), ("surname", "2. HOLM", ("2. HOLM", None)), ("surname", "1.", (None, None)), ("comment", "1. HOLM", ("1. HOLM", None)),
    ("issue_date", "4A 3/7/2015 x", ("03.07.2015", None)), ("issue_date", "4a 3.7.15", (None, None)), ("expiry_date", "4 b:12-11-2031", ("12.11.2031", None)), ("issue_date", "13.7.20155", (None, None)),
    ("personal_id", "4d. 12 a34", ("1234", None)), ("personal_id", "4d", (None, None)), ("license_number", "5. ab-12é", ("AB12", None)), ("serial_number", "5. ab", ("5AB", None)), ("categories", "9. b,  c", ("B, C", None)),
    ("birth_place_and_date", "3. NORD  KREIS 3.4.1987 rest 5.5.1999", ("NORD KREIS", "03.04.1987")), ("birth_place_and_date", "3. 3.4.1987", (None, "03.04.1987")), ("birth_place_and_date", "NORD", ("NORD", None)), ("surname", "", (None, None)), ("surname", None, (None, None)),
]
NARROW = [("surname", "1. HOLM", "HOLM"), ("surname", " 1. HOLM", "1. HOLM"), ("surname", "1.", None), ("issue_date", "4A 3. 7. 2015", "3.7.2015"), ("license_number", "5 ab-1", "AB1"), ("license_number", "5 --", ""), ("comment", "1.  a", "1. a"), ("comment", " ", None), ("surname", None, None)]


def test_wide(spark):
    df = spark.createDataFrame([(i, f, v) for i, (f, v, _) in enumerate(WIDE)], "i int, f string, v string").select("i", N.wide_value(F.col("f"), F.col("v")).alias("g")).orderBy("i")
    got = [tuple(r.g) for r in df.collect()]
    assert got == [w for *_, w in WIDE]


def test_narrow(spark):
    df = spark.createDataFrame([(i, f, v) for i, (f, v, _) in enumerate(NARROW)], "i int, f string, v string").select("i", N.narrow_value(F.col("f"), F.col("v")).alias("g")).orderBy("i")
    assert [r.g for r in df.collect()] == [w for *_, w in NARROW]


@pytest.mark.parametrize("box, inside", [((10, 10, 30, 30), True), ((0, 0, 19, 19), False), ((100, 0, 100, 30), True), ((100, 0, 102, 30), False)])
def test_centre(spark, box, inside):
    pair = spark.range(1).select(*(F.struct(*(F.lit(float(v)).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), vs, strict=True))).alias(n) for n, vs in (("b", box), ("r", (0.1, 0.1, 0.5049, 0.9)))))
    assert pair.select(N.centre_inside(F.col("b"), F.col("r"), 200, 100).alias("x")).first().x is inside


def test_zone_shape(spark):
    raw = [(0, f" {'A' * 44} \r\n\n{'B' * 44}"), (1, "A" * 44), (2, f"{'A' * 44}\n{'B' * 43}"), (3, None), (4, "")]
    got = {r.i: r.z for r in spark.createDataFrame(raw, "i int, v string").select("i", N.zone_shape(F.col("v")).alias("z")).collect()}
    assert [(got[i].line_count, got[i].looks_like_td3) for i in range(5)] == [(2, True), (1, False), (2, False), (0, False), (0, False)]
    assert [(x.text, x.length) for x in got[2].lines] == [("A" * 44, 44), ("B" * 43, 43)]
