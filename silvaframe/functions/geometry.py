"""Circles and boxes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = (x1 - x2).cast("double"), (y1 - y2).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def lens_area(r1: Column, r2: Column, d: Column) -> Column:
    """Common area of two discs: none if apart, the smaller disc if contained. Arguments of acos are clamped."""
    r1, r2 = r1.cast("double"), r2.cast("double")
    cos = lambda a, b: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (d * d + a * a - b * b) / (2.0 * d * a)))
    heron = F.greatest(F.lit(0.0), (-d + r1 + r2) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2))
    small = F.least(r1, r2)
    lens = r1 * r1 * F.acos(cos(r1, r2)) + r2 * r2 * F.acos(cos(r2, r1)) - 0.5 * F.sqrt(heron)
    return F.when(d >= r1 + r2, 0.0).when(d <= F.abs(r1 - r2), math.pi * small * small).otherwise(lens)


LENS_SQL = """CASE WHEN {d} >= {r1} + {r2} THEN 0.0::DOUBLE WHEN {d} <= abs({r1} - {r2}) THEN pi() * least({r1}, {r2}) * least({r1}, {r2})
 ELSE {r1} * {r1} * acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({d} * {d} + {r1} * {r1} - {r2} * {r2}) / (2.0::DOUBLE * {d} * {r1}))))
    + {r2} * {r2} * acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({d} * {d} + {r2} * {r2} - {r1} * {r1}) / (2.0::DOUBLE * {d} * {r2}))))
    - 0.5::DOUBLE * sqrt(greatest(0.0::DOUBLE, (-{d} + {r1} + {r2}) * ({d} + {r1} - {r2}) * ({d} - {r1} + {r2}) * ({d} + {r1} + {r2}))) END"""
DIST_SQL = "sqrt((({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))::DOUBLE)"


def box_intersection(a: tuple, b: tuple) -> Column:
    """Common area of boxes (x1, y1, x2, y2)."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), (w * h).cast("double")).otherwise(0.0)


def box_iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of boxes; a box counts as one pixel at least."""
    area = lambda q: F.greatest(F.lit(1.0), ((q[2] - q[0]) * (q[3] - q[1])).cast("double"))
    both = box_intersection(a, b)
    return both / (area(a) + area(b) - both)


def circularity(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * math.pi * area / (perimeter * perimeter)).otherwise(0.0)


def aspect(width: Column, height: Column) -> Column:
    return F.greatest(width, height) / F.greatest(F.lit(1), F.least(width, height))


def shoelace(points: Column) -> Column:
    """Area of a polygon given as array<struct<x, y>>."""
    n = F.size(points)
    turn = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0.0),
        lambda acc, i: acc + (F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"]),
    )
    return F.when(n >= 3, F.abs(turn) / 2).otherwise(0.0)


def in_polygon(points: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: whether a ray to the right crosses the polygon an odd number of times."""
    n = F.size(points)

    def crosses(i: Column) -> Column:
        a, b = F.get(points, i), F.get(points, (i + n - 1) % n)
        over = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"]
        return F.when(over & (x < at), 1).otherwise(0)

    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crosses(i)) % 2 == 1).otherwise(False)


def contour_json(points: Column) -> Column:
    """A contour as compact JSON, [[x,y],...]; null for fewer than three points."""
    return F.when(F.size(points) >= 3, F.to_json(F.transform(points, lambda p: F.array(p["x"], p["y"]))))


def parse_contour(text: Column) -> Column:
    """array<struct<x, y>> from JSON; null for what is no list of three points or more."""
    rows = F.from_json(text, "array<array<int>>")
    ok = (F.size(rows) >= 3) & F.forall(rows, lambda r: F.size(r) == 2)
    return F.when(ok, F.transform(rows, lambda r: F.struct(r[0].alias("x"), r[1].alias("y"))))
