"""The search for a zone against a direct evaluation on random pictures."""

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from attestra.operators import zone_search as z


def share(t):
    return sum(c == "<" or c.isdigit() or "A" <= c <= "Z" for c in t) / len(t) if t else 0.0


def cy(x):
    return (x[3] + x[5]) / 2


def rows(lines):
    out = []
    for x in sorted(lines, key=cy):
        for r in out:
            if abs(cy(x) - sum(map(cy, r)) / len(r)) <= max(statistics.median(y[5] - y[3] for y in r), x[5] - x[3]) * 0.65:
                r.append(x)
                break
        else:
            out.append([x])
    merged = []
    for r in out:
        r = sorted(r, key=lambda x: x[2])
        w = [max(1, len(x[0])) for x in r]
        merged.append(("".join(x[0] for x in r), sum(x[1] * k for x, k in zip(r, w, strict=True)) / sum(w), min(x[2] for x in r), min(x[3] for x in r), max(x[4] for x in r), max(x[5] for x in r)))
    return merged


def score(x, n, width, height):
    return 5 * max(0, 1 - abs(len(x[0]) - n) / max(1, n)) + 3 * share(x[0]) + (0.5 if "<" in x[0] else 0) + 0.5 * min(1, (x[4] - x[2]) / max(1, width * 0.5)) + 0.25 * min(1, cy(x) / max(1, height))


def search(lines, lengths, width, height):
    found = [x for x in [*lines, *rows(lines)] if len(x[0]) >= 15 and share(x[0]) >= 0.65]
    usual = int(statistics.median(lengths))
    found = sorted(found, key=lambda x: -score(x, usual, width, height))[:12]
    best = None
    for c in itertools.combinations(found, len(lengths)):
        c = sorted(c, key=cy)
        if all(abs(cy(b) - cy(a)) >= 0.25 * max(a[5] - a[3], b[5] - b[3]) for a, b in itertools.pairwise(c)):
            s = sum(score(x, n, width, height) for x, n in zip(c, lengths, strict=True))
            if best is None or s > best[0] + 1e-9:
                best = (s, c)
    return best and ([x[0] for x in best[1]], sum(x[1] for x in best[1]) / len(best[1]))


def picture(r):
    lines = []
    for row in range(r.randint(0, 6)):
        y, x = 40.0 * row + r.uniform(0, 30), 0.0
        for _ in range(r.randint(1, 3)):
            n, h = r.choice([5, 15, 22, 30, 44]), r.uniform(8, 30)
            lines.append(("".join(r.choice("AB<<19" if r.random() < 0.9 else "a é") for _ in range(n)), round(r.random(), 3), x, y + r.uniform(-4, 4), x + n * 5, y + h))
            x += n * 5 + r.uniform(0, 9)
    r.shuffle(lines)
    return lines


@pytest.mark.parametrize("lengths", [[44, 44], [30, 30, 30], [36]])
def test_search_against_brute_force(spark, lengths):
    r = random.Random(len(lengths))
    pictures = [picture(r) for _ in range(60)] + [[], None]
    line = "array<struct<text:string,score:double,x1:double,y1:double,x2:double,y2:double>>"
    df = spark.createDataFrame([(i, p, lengths, 400, 300) for i, p in enumerate(pictures)], f"sample int, lines {line}, lengths array<int>, width int, height int")
    for x in z.search(df).collect():
        want = search(pictures[x.sample] or [], lengths, 400, 300)
        assert (x.lines, x.score and round(x.score, 9)) == ((want[0], round(want[1], 9)) if want else (None, None))
    for x in df.where(F.size("lines") > 0).select("sample", z.rows_of_pieces(F.col("lines")).alias("rows")).collect():
        assert [(q.text, round(q.score, 9), *q[2:]) for q in x.rows] == [(q[0], round(q[1], 9), *q[2:]) for q in rows(pictures[x.sample])]
