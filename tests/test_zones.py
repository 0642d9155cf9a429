"""Zone lines and blocks, paired boxes, corners."""

from pyspark.sql import functions as F

from attestra.operators import zones

TD3 = ["P<UTOHOLM<<INGA<MAJ" + "<" * 25, "K7204419<3UTO8805142F3009303" + "<" * 16]


def test_lines_and_blocks(spark):
    rows = [("s", TD3[0][:20], 0.9, 0, 100, 10), ("s", TD3[0][20:], 0.7, 200, 103, 10), ("s", TD3[1], 0.8, 0, 130, 10), ("s", "SHORT", 0.8, 0, 10, 10), ("s", "?", 0.8, 0, 50, 10), ("s", "A" * 26, 0.8, 0, 20, 10), ("t", "none", 0.5, 0, 1, 1)]
    got = zones.zone_lines(spark.createDataFrame(rows, "sample_id string, text string, score double, x1 int, center_y int, height int"))
    lines = got.orderBy("line_no").collect()
    assert [r.text for r in lines] == ["A" * 26, *TD3]
    assert abs(lines[1].confidence - (0.9 * 20 + 0.7 * 24) / 44) < 1e-9
    assert [r.lines for r in zones.zone_blocks(got, (2,)).collect()] == [TD3]


def test_boxes_and_corners(spark):
    box = "image string, pos int, x double, y double, height double"
    a = spark.createDataFrame([("i", 0, 0.0, 0.0, 10.0), ("i", 1, 100.0, 0.0, 10.0), ("j", 0, 0.0, 0.0, 1.0)], box)
    b = spark.createDataFrame([("i", 0, 3.0, 0.0, 10.0), ("i", 1, 4.0, 0.0, 10.0)], box)
    assert {(r.image, r.l, r.r) for r in zones.paired_boxes(a, b).collect()} == {("i", 0, 0), ("i", 1, None), ("j", 0, None)}
    p = spark.createDataFrame([([(10.0, 10.0), (0.0, 0.0), (10.0, 0.0), (0.0, 10.0)],)], "p array<struct<x:double,y:double>>").withColumn("o", zones.ordered_corners(F.col("p")))
    r = p.select("o", zones.convex(F.col("o")).alias("good"), zones.convex(F.col("p")).alias("bad")).first()
    assert [(q.x, q.y) for q in r.o] == [(0, 0), (10, 0), (10, 10), (0, 10)] and r.good and not r.bad


def test_check_digits_of_three_shapes(spark):
    from attestra.functions import mrz

    # fixed values: the specimens of ICAO 9303
    td3 = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]
    td2 = ["I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<", "D231458907UTO7408122F1204159<<<<<<<6"]
    td1 = ["I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<"]
    odd = [[td3[0], td3[1].replace("7408", "7409")], [td3[0], td3[1].replace("UTO7", "UTO?")], td3[:1], [], None]
    df = spark.createDataFrame([(i, z) for i, z in enumerate([td3, td2, td1, *odd])], "i int, z array<string>")
    got = [r["v"] for r in df.select("i", mrz.digits_valid(df["z"]).alias("v")).orderBy("i").collect()]
    assert got == [True, True, True, False, False, None, None, None]
