"""Zone lines from recognised tokens, and boxes paired between two detectors.

Both are order-dependent inside one image, whose rows are few; they run per
image on Arrow groups, and everything around them is relational.
"""

from __future__ import annotations

import statistics

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.functions.mrz import fragment
from attestra.operators.tasks import spread


def zone_lines(tokens: DataFrame) -> DataFrame:
    """Rows of tokens joined from left to right: sample_id, line_no, text, confidence (weighted by length), center_y.

    tokens(sample_id, text, score, x1, center_y, height). A token joins the row whose mean centre is nearest, if that is within
    0.7 of the median height (5 pixels at least); rows of under 20 characters go.
    """

    def cluster(sample: str, tokens: list[tuple]) -> list[tuple]:
        heights = [k[3] for k in tokens if k[3] == k[3]]
        limit = max(5.0, statistics.median(heights) * 0.7) if heights else 5.0
        rows: list[list] = []
        means: list[float] = []
        for tok in sorted(tokens, key=lambda k: (k[2] != k[2], k[2], k[1] != k[1], k[1])):
            near = min(range(len(rows)), key=lambda i: abs(tok[2] - means[i]), default=None)
            if near is None or not abs(tok[2] - means[near]) <= limit:
                near = len(rows)
                rows.append([])
                means.append(0.0)
            rows[near].append(tok)
            means[near] = sum(k[2] for k in rows[near]) / len(rows[near])
        out = []
        for r, mean in zip(rows, means, strict=True):
            r.sort(key=lambda k: k[1])
            text = "".join(k[4] for k in r)
            if len(text) >= 20:
                weights = [max(1, len(k[4])) for k in r]
                out.append((sample, len(out), text, sum(k[0] * w for k, w in zip(r, weights, strict=True)) / sum(weights), mean))
        return out

    def lines(batches):
        for pdf in batches:  # many samples at once
            out = [x for sample, *columns in pdf.itertuples(index=False) for x in cluster(sample, list(zip(*(c.tolist() for c in columns), strict=True)))]
            yield pd.DataFrame(out, columns=["sample_id", "line_no", "text", "confidence", "center_y"])

    parts = ("score", "x1", "center_y", "height", "fragment")
    df = tokens.withColumn("fragment", fragment(F.col("text"))).where("fragment <> ''")
    df = df.select(F.col("sample_id").cast("string"), "fragment", *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in parts[:4]))
    whole = spread(df, "sample_id").groupBy("sample_id").agg(F.collect_list(F.struct(*parts)).alias("t")).select("sample_id", *(F.col(f"t.{c}").alias(c) for c in parts))
    return whole.mapInPandas(lines, "sample_id string, line_no int, text string, confidence double, center_y double")


def zone_blocks(lines: DataFrame, counts: tuple[int, ...]) -> DataFrame:
    """The best block of consecutive lines of 24 to 50 characters for each sample; of equal ones the first, counts in the given order."""
    n = F.length("text")
    df = lines.where(n.between(24, 50)).withColumn("low", F.max("center_y").over(W.partitionBy("sample_id")))
    found = None
    for order, count in enumerate(counts):
        w = W.partitionBy("sample_id").orderBy("line_no").rowsBetween(0, count - 1)
        block = df.withColumn("block", F.collect_list(F.struct("text", "center_y", "line_no")).over(w)).where(F.size("block") == count)
        sizes = F.transform("block", lambda x: F.length(x["text"]))
        close = lambda k: F.least(*(F.abs(k - v) for v in (30, 36, 44)))
        add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
        score = add(F.transform(sizes, lambda k: F.greatest(F.lit(0.0), 1 - close(k) / 12)))
        score = score + add(F.transform("block", lambda x: F.when(x["text"].contains("<"), 0.4).otherwise(0.0)))
        score = score + 0.75 * (1 - F.least(F.lit(1.0), (F.array_max(sizes) - F.array_min(sizes)) / 12))
        score = score + 0.15 * add(F.transform("block", lambda x: x["center_y"])) / F.greatest(F.lit(1.0), F.col("low"))
        part = block.select("sample_id", "block", score.alias("score"), F.lit(order).alias("count_order"), "line_no")
        found = part if found is None else found.unionByName(part)
    best = W.partitionBy("sample_id").orderBy(F.desc("score"), "count_order", "line_no")
    return found.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("sample_id", F.transform("block", lambda x: x["text"]).alias("lines"), "score")


def paired_boxes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Greedy pairs by centre: each left box, in order, takes the first free right box within max(5, 1.5 times the larger height). Rows: image, l, r (null: none).

    left, right: image, pos, x, y, height.
    """

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free = b.sort_values("pos").to_dict("records")
        out = []
        for x in a.sort_values("pos").itertuples():
            hit = next((i for i, y in enumerate(free) if ((x.x - y["x"]) ** 2 + (x.y - y["y"]) ** 2) ** 0.5 <= max(5.0, 1.5 * max(x.height, y["height"]))), None)
            out.append((x.image, x.pos, None if hit is None else free.pop(hit)["pos"]))
        return pd.DataFrame(out, columns=["image", "l", "r"]).astype({"r": "Int32"})

    cols = [F.col("image").cast("string"), F.col("pos").cast("int"), *(F.col(c).cast("double") for c in ("x", "y", "height"))]
    return left.select(*cols).groupBy("image").cogroup(right.select(*cols).groupBy("image")).applyInPandas(match, "image string, l int, r int")


def ordered_corners(points: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left, by sums and differences of their coordinates."""
    by = lambda f: F.array_sort(F.transform(points, lambda p: F.struct(f(p).alias("k"), p.alias("p"))))
    total, slope = by(lambda p: p["x"] + p["y"]), by(lambda p: p["y"] - p["x"])
    return F.array(total[0]["p"], slope[0]["p"], total[3]["p"], slope[3]["p"])


def convex(points: Column) -> Column:
    """Whether four points in order turn one way only, with an area."""
    p = lambda i: F.get(points, F.lit(i % 4))
    cross = [(p(i + 1)["x"] - p(i)["x"]) * (p(i + 2)["y"] - p(i + 1)["y"]) - (p(i + 1)["y"] - p(i)["y"]) * (p(i + 2)["x"] - p(i + 1)["x"]) for i in range(4)]
    return (F.least(*cross) > 0) | (F.greatest(*cross) < 0)
