"""Running totals and quantiles in small slices against pandas."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestra.operators import ranking

SCHEMA = "g string, x double, id long, upto string, key long"


def made(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(r.choice(["a"] * 8 + ["b", "c", None]), r.choice([None, float(r.randrange(20)), r.random()]), i, "kept", i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("size", [1, 5, 10**6])
def test_running_numbers_every_group_in_order(spark, size):
    rows, df = made(spark, 400)
    got = {r["id"]: (r["n"], r["all"]) for r in ranking.running(df.drop("upto"), ["g"], [F.col("x"), F.col("id")], slice_rows=size).select("id", F.col("upto").alias("n"), F.col("total").alias("all")).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        want |= {r[2]: (i + 1, len(mine)) for i, r in enumerate(mine)}
    assert got == want


def test_running_cuts_large_groups(spark):
    _, df = made(spark, 400)
    whole = ranking.running(df.drop("upto"), [], [F.col("id")], F.col("key"), slice_rows=7).select("id", "upto", "total", "key").toPandas().sort_values("id")
    assert (whole["upto"] == whole["key"].cumsum()).all() and (whole["total"] == whole["key"].sum()).all()


@pytest.mark.parametrize("size", [20, 100_000])
def test_quantiles(spark, size):
    rows, df = made(spark, 500, seed=2)
    df = df.unionByName(spark.createDataFrame([("none", None, -1, "", 0)], SCHEMA))
    got = {r["g"]: r for r in ranking.quantiles(df, ["g"], {"m": ("x", 0.5), "p": ("x", 0.93), "k": ("key", 0.25)}, size).collect()}
    groups = {r[0] for r in rows}
    for g in groups:
        x, key = (pd.Series([r[i] for r in rows if r[0] == g], dtype="float64").dropna() for i in (1, 4))
        assert got[g]["m"] == pytest.approx(x.quantile(0.5)) and got[g]["p"] == pytest.approx(x.quantile(0.93)) and got[g]["k"] == pytest.approx(key.quantile(0.25))
    upper = {r["g"]: r["upper_median"] for r in ranking.upper_median(df, ["g"], "x", size).collect()}
    assert all(upper[g] == sorted(r[1] for r in rows if r[0] == g and r[1] is not None)[sum(r[0] == g and r[1] is not None for r in rows) // 2] for g in groups)
    assert got["none"]["m"] is None and len(got) == len(groups) + 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA).drop("upto")
    assert not ranking.running(df, ["g"], [F.col("id")]).collect() and not ranking.quantiles(df, ["g"], {"m": ("x", 0.5)}).collect()


@pytest.mark.parametrize("strict", [False, True])
def test_frontier_of_parts_is_that_of_the_group(spark, monkeypatch, strict):
    """Costs dealt into few and into many parts, ties and nulls among them, against comparing all pairs."""
    from attestra.operators import evaluation

    r = random.Random(9)
    rows = [(r.choice("aaab"), r.choice([float(r.randrange(12)), r.random() * 12]), r.choice([None, float(r.randrange(12)), r.random() * 12]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, cost double, gain double, id long")
    real = [x for x in rows if x[2] is not None]
    worse = lambda x, y: (y[1] < x[1] and y[2] > x[2]) if strict else (y[1] <= x[1] and y[2] >= x[2] and (y[1] < x[1] or y[2] > x[2]))
    want = sorted(x[3] for x in real if not any(y[0] == x[0] and worse(x, y) for y in real))
    for parts in (1, 7, 1024):
        monkeypatch.setattr(evaluation, "PARTS", parts)
        got = evaluation.pareto(df, "g", "cost", "gain", strict)
        assert got.columns == df.columns and sorted(x.id for x in got.where("gain is not null").collect()) == want


def test_alternating(spark):
    from attestra.operators import runs

    df = spark.createDataFrame([(d, n, f"c{i:03d}") for d, n in (("x", 0), ("y", 1)) for i in range(40)], "d string, n long, c string")
    got = {(x.d, x.c): x.turn for x in runs.alternating(df, "d", "n", "c").collect()}
    assert all(got["x", f"c{i:03d}"] == i + 1 and got["y", f"c{i:03d}"] == 40 - i for i in range(40))
