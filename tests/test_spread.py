"""Dear work on the rows of a small file is spread over tasks, and documents are read few times."""

from pyspark.sql import functions as F

from attestra.operators import identity, snapshots, zones
from attestra.operators.tasks import spread


def test_spread(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= 32


def test_zone_queries_and_profiles_run_in_many_tasks(spark):
    from attestra.plans import queries as q

    for name in ("zone_coordinates", "page_coordinates"):
        assert q.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 32
    assert q._td3(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 32


def test_zone_lines_of_odd_tokens(spark):
    rows = [("a", "B" * 10, 0.5, 20.0, 100.0, 10.0), ("a", "A" * 10, 1.0, 1.0, 103.0, 10.0), ("a", "C" * 25, 0.9, 1.0, 140.0, 10.0), ("a", "short", 0.9, 1.0, 300.0, 10.0), ("b", "D" * 20, 0.25, None, 5.0, None)]
    t = spark.createDataFrame(rows, "sample_id string, text string, score double, x1 double, center_y double, height double")
    out = zones.zone_lines(t)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0, "A" * 10 + "B" * 10, 0.75, 101.5), ("a", 1, "C" * 25, 0.9, 140.0), ("b", 0, "D" * 20, 0.25, 5.0)]


def test_licence_tokens_move_once(spark):
    t = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("surname").alias("box"), F.lit(0).alias("box_pos"), F.lit(1).alias("token"), F.lit("X").alias("text"), F.lit(1.0).alias("center_y"), F.lit(1.0).alias("x1"))
    out = identity.licence_records(t)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.surname for r in out.collect()} == {"X"}


def test_graded_digests_are_two_digests(spark):
    rows = spark.createDataFrame([(1, '{"a":{"t":1,"c":2},"b":[1,"x"]}'), (2, "{"), (3, "{}"), (4, '{"a":{"t":5}}')], "k int, text string")
    got = {r.k: (r.semantic, r.whole) for r in snapshots.graded_digests(rows, ["k"], "text", (r"^a\.t$",), (r"\.c$",)).collect()}
    one = lambda *p: {r.k: r.digest for r in snapshots.digests(rows, ["k"], "text", p).collect()}
    semantic, whole = one(r"^a\.t$", r"\.c$"), one(r"^a\.t$")
    assert got == {k: (semantic[k], whole[k]) for k in semantic}
