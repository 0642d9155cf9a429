"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm._shared import written


def _least(pairs: DataFrame) -> DataFrame:
    """Every (v, u) with the smallest of v and its neighbours; minima are partial before the shuffle, and the join back can be split."""
    m = pairs.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    return pairs.join(m, "v")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (a, b): the smallest id that is reachable.

    Loops and repeated edges are ignored; no edges give no rows. Each round is a
    written table, so that no lineage grows and a lost executor costs one round.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    e, before = written(e, "edges"), None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _least(both).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        small = _least(large)
        e = written(small.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(small.select("v", F.col("m").alias("u"))).where("v <> u").distinct(), "edges")
    # stars now: every vertex but the smallest points to it
    return e.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("component")).unionByName(e.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
