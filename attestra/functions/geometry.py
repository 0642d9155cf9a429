"""Points and frames as columns: corners in order, perspective maps of four points, frames along a zone's long edge, projected rectangles.

Points are structs (x, y) of doubles, quadrilaterals arrays of four in the order top left,
top right, bottom right, bottom left; rectangles structs (x1, y1, x2, y2) in shares of
their page. What is degenerate (three corners in line, no area, a point at infinity) is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.columns import bound

_NEAR = 1e-12


def point(x: Column | float, y: Column | float) -> Column:
    c = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return F.struct(c(x).alias("x"), c(y).alias("y"))


def corners(points: Column) -> Column:
    """Four points in order: least and greatest sum of x and y, least and greatest y - x; the first of equals."""
    at = lambda f: F.array_min(F.transform(points, lambda p, i: F.struct(f(p).alias("v"), i.alias("i"), p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))
    total, lean = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    found = (at(total), at(lambda p: -total(p)), at(lean), at(lambda p: -lean(p)))
    tl, br, tr, bl = (F.struct(f["x"].alias("x"), f["y"].alias("y")) for f in found)
    return F.when(F.size(points) == 4, F.array(tl, tr, br, bl))


def valid_corners(points: Column) -> Column:
    """Whether four points of the unit square make a convex quadrilateral of some area (over 0.0001), in one turn around it."""
    p = lambda i: F.get(points, F.lit(i % 4))
    turn = lambda i: (p(i + 1)["x"] - p(i)["x"]) * (p(i + 2)["y"] - p(i + 1)["y"]) - (p(i + 1)["y"] - p(i)["y"]) * (p(i + 2)["x"] - p(i + 1)["x"])
    turns = [turn(i) for i in range(4)]
    area = sum((p(i)["x"] * p(i + 1)["y"] - p(i + 1)["x"] * p(i)["y"] for i in range(4)), F.lit(0.0)) / 2
    inside = F.forall(points, lambda q: q["x"].between(0, 1) & q["y"].between(0, 1))
    return F.coalesce((F.size(points) == 4) & inside & (F.size(F.array_distinct(points)) == 4) & ((F.least(*turns) >= 0) | (F.greatest(*turns) <= 0)) & (F.abs(area) >= 0.0001), F.lit(False))


def from_square(quad: Column) -> Column:
    """The perspective map (nine numbers by row) that takes the unit square's corners to a quadrilateral's: the eight equations of four points, solved for these corners."""

    def solved(q: Column) -> Column:
        (x0, y0), (x1, y1), (x2, y2), (x3, y3) = ((F.get(q, F.lit(i))["x"], F.get(q, F.lit(i))["y"]) for i in range(4))
        ax, bx, ay, by = x1 - x2, x3 - x2, y1 - y2, y3 - y2
        sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
        den = ax * by - bx * ay
        g, h = F.try_divide(sx * by - bx * sy, den), F.try_divide(ax * sy - sx * ay, den)
        return F.array(x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h, F.lit(1.0))

    size = bound(quad, lambda q: F.array_max(F.transform(q, lambda p: F.greatest(F.abs(p["x"] - F.get(q, F.lit(0))["x"]), F.abs(p["y"] - F.get(q, F.lit(0))["y"])))))
    return bound(F.struct(solved(quad).alias("m"), size.alias("size")), lambda s: F.when((F.size(quad) == 4) & (F.abs(determinant(s["m"])) > _NEAR * s["size"] * s["size"]), s["m"]))


def _e(m: Column, i: int) -> Column:
    return F.get(m, F.lit(i))


def determinant(m: Column) -> Column:
    a, b, c, d, e, f, g, h, i = (_e(m, k) for k in range(9))
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def inverse(m: Column) -> Column:
    """The inverse of a perspective map, up to a factor: its adjugate."""

    def adjugate(m: Column) -> Column:
        a, b, c, d, e, f, g, h, i = (_e(m, k) for k in range(9))
        return F.array(e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)

    return bound(m, lambda m: F.when(m.isNotNull(), adjugate(m)))


def product(m: Column, n: Column) -> Column:
    """The map that does n, then m."""
    rows = lambda s: F.array(*(sum((_e(s["m"], 3 * r + k) * _e(s["n"], 3 * k + c) for k in range(1, 3)), _e(s["m"], 3 * r) * _e(s["n"], c)) for r in range(3) for c in range(3)))
    return bound(F.struct(m.alias("m"), n.alias("n")), lambda s: F.when(s["m"].isNotNull() & s["n"].isNotNull(), rows(s)))


def between(source: Column, target: Column) -> Column:
    """The perspective map from one quadrilateral to another; null if either is degenerate."""
    return product(from_square(target), inverse(from_square(source)))


def applied(m: Column, points: Column) -> Column:
    """Points under a map; null where one lies at infinity or the map is null."""

    def one(m: Column, p: Column) -> Column:
        w = _e(m, 6) * p["x"] + _e(m, 7) * p["y"] + _e(m, 8)
        return point(F.try_divide(_e(m, 0) * p["x"] + _e(m, 1) * p["y"] + _e(m, 2), w), F.try_divide(_e(m, 3) * p["x"] + _e(m, 4) * p["y"] + _e(m, 5), w))

    moved = bound(m, lambda m: F.when(m.isNotNull(), F.transform(points, lambda p: one(m, p))))
    return bound(moved, lambda q: F.when(~F.exists(q, lambda p: p["x"].isNull()), q))


def frame(zone: Column) -> Column:
    """A zone's frame: origin (its top left), x and y (unit vectors along its top edge and across it), scale (the top edge's length). Null without an edge."""

    def made(q: Column) -> Column:
        p = lambda i, c: F.get(q, F.lit(i))[c]
        ex, ey = p(1, "x") - p(0, "x"), p(1, "y") - p(0, "y")
        scale = F.sqrt(ex * ex + ey * ey)
        x, y = F.try_divide(ex, scale), F.try_divide(ey, scale)
        dx, dy = ((p(3, c) - p(0, c) + p(2, c) - p(1, c)) / 2 for c in ("x", "y"))
        along = dx * x + dy * y
        ox, oy = dx - along * x, dy - along * y
        length = F.sqrt(ox * ox + oy * oy)
        across = point(F.when(length > 0, ox / length).otherwise(-y), F.when(length > 0, oy / length).otherwise(x))
        return F.when(scale > 0, F.struct(F.get(q, F.lit(0)).alias("origin"), point(x, y).alias("x"), across.alias("y"), scale.alias("scale")))

    return bound(corners(zone), made)


def to_frame(zone: Column, points: Column) -> Column:
    """Points in a zone's frame, in lengths of its top edge."""

    def one(f: Column, p: Column) -> Column:
        dx, dy = p["x"] - f["origin"]["x"], p["y"] - f["origin"]["y"]
        return point((dx * f["x"]["x"] + dy * f["x"]["y"]) / f["scale"], (dx * f["y"]["x"] + dy * f["y"]["y"]) / f["scale"])

    return bound(frame(zone), lambda f: F.when(f.isNotNull(), F.transform(points, lambda p: one(f, p))))


def from_frame(zone: Column, points: Column) -> Column:
    """The inverse of ``to_frame``."""
    one = lambda f, p: point(*(f["origin"][c] + f["scale"] * (p["x"] * f["x"][c] + p["y"] * f["y"][c]) for c in ("x", "y")))
    return bound(frame(zone), lambda f: F.when(f.isNotNull(), F.transform(points, lambda p: one(f, p))))


def from_zone(zone: Column, points: Column) -> Column:
    """Points given in a zone's own square (0, 0 to 1, 1), in the picture: perspective included."""
    return applied(from_square(corners(zone)), points)


def rectangle_corners(r: Column, width: Column, height: Column) -> Column:
    p = lambda x, y: point(r[x] * width, r[y] * height)
    return F.array(p("x1", "y1"), p("x2", "y1"), p("x2", "y2"), p("x1", "y2"))


def bounds(points: Column, width: Column, height: Column) -> Column:
    """The rectangle around points, in shares of a page."""
    side = lambda pick, c, n: pick(F.transform(points, lambda p: p[c])) / n
    box = F.struct(side(F.array_min, "x", width).alias("x1"), side(F.array_min, "y", height).alias("y1"), side(F.array_max, "x", width).alias("x2"), side(F.array_max, "y", height).alias("y2"))
    return F.when(points.isNotNull(), box)


def relative(r: Column, crop: Column) -> Column:
    """A rectangle in shares of another one; null if that has no size."""
    w, h = crop["x2"] - crop["x1"], crop["y2"] - crop["y1"]
    return F.when((w != 0) & (h != 0), F.struct(*(F.try_divide(r[f"{c}{i}"] - crop[f"{c}1"], n).alias(f"{c}{i}") for i in (1, 2) for c, n in (("x", w), ("y", h)))))


def absolute(r: Column, crop: Column) -> Column:
    """The inverse of ``relative``."""
    return F.struct(*((crop[f"{c}1"] + r[f"{c}{i}"] * (crop[f"{c}2"] - crop[f"{c}1"])).alias(f"{c}{i}") for i in (1, 2) for c in "xy"))


def projected(r: Column, m: Column, source: tuple[Column, Column], target: tuple[Column, Column]) -> Column:
    """The rectangle around what a map makes of a rectangle; both in shares of their pages."""
    return bounds(applied(m, rectangle_corners(r, *source)), *target)
