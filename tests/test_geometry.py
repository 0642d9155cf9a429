"""Perspective maps against the eight equations, frames and projected boxes round trip."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.functions import geometry as g
from attestra.operators import profiles

Q = "array<struct<x:double,y:double>>"


def solved(a, b):
    rows = [r for (x, y), (u, v) in zip(a, b, strict=True) for r in ([x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y])]
    return np.append(np.linalg.solve(np.array(rows, float), np.array([c for p in b for c in p], float)), 1).reshape(3, 3)


def moved(m, p):
    x, y, w = m @ np.array([*p, 1.0])
    return x / w, y / w


def quad(r, size=1000):
    jitter = lambda: r.uniform(-0.2, 0.2) * size
    return [(x * size + jitter(), y * size + jitter()) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]


def test_maps_against_equations_and_round_trip(spark):
    r = random.Random(2)
    rows = [(i, quad(r), quad(r, 50), [(r.uniform(0, 900), r.uniform(0, 900)) for _ in range(5)]) for i in range(50)]
    df = spark.createDataFrame(rows, f"i int, a {Q}, b {Q}, p {Q}").withColumn("m", g.between(F.col("a"), F.col("b"))).withColumn("q", g.applied(F.col("m"), F.col("p"))).withColumn("back", g.applied(g.between(F.col("b"), F.col("a")), F.col("q")))
    for x in df.collect():
        m = solved([tuple(c) for c in x.a], [tuple(c) for c in x.b])
        for p, q, back in zip(x.p, x.q, x.back, strict=True):
            assert np.allclose(moved(m, p), q, rtol=1e-7, atol=1e-7) and np.allclose(p, back, rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("bad", [[(0, 0), (1, 0), (2, 0), (3, 0)], [(0, 0), (0, 0), (0, 0), (0, 0)], [(0, 0), (1, 1), (2, 2), (0, 5)], [(0, 0), (1, 0), (1, 1)], [], None, [(5, 0), (1, 0), (3, 0), (2, 7)]])
def test_degenerate_corners_are_null(spark, bad):
    good = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    bad = bad and [(float(x), float(y)) for x, y in bad]
    x = spark.createDataFrame([(bad, good)], f"a {Q}, b {Q}").select(g.between(F.col("a"), F.col("b")).alias("m"), g.applied(g.between(F.col("b"), F.col("a")), F.col("b")).alias("q"), g.valid_corners(F.col("a")).alias("ok")).first()
    assert (x.m, x.q, x.ok) == (None, None, False)


def test_corners(spark):
    r = random.Random(3)
    shapes = [quad(r) for _ in range(20)]
    rows = [(s, r.sample(s, 4)) for s in shapes]
    for x in spark.createDataFrame(rows, f"s {Q}, p {Q}").select("s", g.corners(F.col("p")).alias("c")).collect():
        assert x.c == x.s
    square = [(0.1, 0.1), (0.9, 0.2), (0.8, 0.9), (0.2, 0.8)]
    cases = [(square, True), (square[::-1], True), ([square[i] for i in (0, 2, 1, 3)], False), ([(0.1, 0.1)] * 4, False), ([(1.1, 0.1), *square[1:]], False), ([(0.5, 0.5), (0.501, 0.5), (0.501, 0.501), (0.5, 0.501)], False)]
    assert [x.ok for x in spark.createDataFrame(cases, f"c {Q}, want boolean").select(g.valid_corners(F.col("c")).alias("ok")).collect()] == [w for _, w in cases]


def test_frames_round_trip(spark):
    r = random.Random(4)
    rows = [(quad(r, 300), quad(r)) for _ in range(30)] + [([(0.0, 0.0), (4.0, 3.0), (4.0, 3.0), (0.0, 0.0)], [(1.0, 2.0)]), ([(1.0, 1.0)] * 4, [(1.0, 2.0)])]
    df = spark.createDataFrame(rows, f"z {Q}, p {Q}").withColumn("at", g.to_frame(F.col("z"), F.col("p")))
    got = df.select("z", "p", "at", g.from_frame(F.col("z"), F.col("at")).alias("back"), g.from_zone(F.col("z"), F.expr("array(struct(0d as x, 0d as y), struct(1d as x, 0d as y), struct(1d as x, 1d as y), struct(0d as x, 1d as y))")).alias("own")).collect()
    for x in got[:-2]:
        assert np.allclose([tuple(p) for p in x.p], [tuple(p) for p in x.back], atol=1e-9) and np.allclose([tuple(p) for p in x.z], [tuple(p) for p in x.own], atol=1e-9)
        (x0, y0), (x1, y1) = x.z[0], x.z[1]
        assert np.isclose(x.at[0].x, np.dot([x.p[0].x - x0, x.p[0].y - y0], [x1 - x0, y1 - y0]) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))
    assert got[-1].at is None and got[-1].back is None and got[-2].own is None
    assert np.isclose(got[-2].at[0].y, (-1 * 3 + 2 * 4) / 5 / 5)


R = "struct<x1:double,y1:double,x2:double,y2:double>"
SAMPLE = f"key string, layout string, side string, status string, coordinate_space string, corners {Q}, data_crop {R}, fields map<string,{R}>, original_width int, original_height int, canonical_width int, canonical_height int, zone {Q}, page_corners {Q}"


def test_promotion_and_drift(spark):
    whole, crop, box = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], (0.2, 0.2, 0.6, 0.6), (0.0, 0.0, 0.5, 1.0)
    half = [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5)]
    sample = lambda **k: tuple(({"key": "k", "layout": "card", "side": "front", "status": "complete", "coordinate_space": None, "corners": whole, "data_crop": crop, "fields": {"sec": box, "name": crop}, "original_width": 200, "original_height": 100, "canonical_width": 400, "canonical_height": 300, "zone": None, "page_corners": None} | k).values())
    rows = [sample(), sample(key="a", fields={"name": box}), sample(side="back", corners=half, data_crop=(0.1, 0.1, 0.3, 0.3)), sample(layout="pass", side=None, coordinate_space="canonical", fields={"x": box}, zone=[(0.0, 0.0), (10.0, 0.0), (10.0, 2.0), (0.0, 2.0)], page_corners=[(0.0, -10.0), (10.0, 0.0)]), sample(layout="pass", key="z", status="open")]
    samples = spark.createDataFrame(rows, SAMPLE)
    current = spark.createDataFrame([("card", "sex", True), ("card", "name", False)], "layout string, field string, required boolean")
    planned = profiles.promoted(samples, current)
    got = {(x.layout, x.region, x.field): (x.required, tuple(np.round(x.crop, 9)), tuple(np.round(x.roi, 9))) for x in planned.collect()}
    assert got == {("card", "front", "sex"): (True, crop, box), ("card", "front", "name"): (False, crop, crop), ("card", "back", "sex"): (True, crop, box), ("card", "back", "name"): (False, crop, crop), ("pass", "data_page", "x"): (False, crop, box)}
    assert [(x.layout, [tuple(p) for p in x.page_corners]) for x in profiles.anchors(samples).collect()] == [("pass", [(0.0, -1.0), (1.0, 0.0)])]
    assert profiles.drift(planned, planned).count() == 0
    less = planned.where("field <> 'x'").withColumn("required", F.col("field") == "name")
    assert {(x.layout, x.boxes) for x in profiles.drifted_layouts(planned, less).collect()} == {("card", 4), ("pass", 1)}
    assert profiles.drift(planned, less).groupBy("side").count().orderBy("side").collect() == [("current", 4), ("planned", 5)]
