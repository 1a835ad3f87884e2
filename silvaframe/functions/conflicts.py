"""When two detections are the same object: one predicate for each family of detections."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from silvaframe.functions.geometry import box_iou, distance, lens_area

Row = Callable[[str], Column]


def _pair(p: Row, q: Row):
    d = distance(p("x"), p("y"), q("x"), q("y"))
    r1, r2 = p("radius").cast("double"), q("radius").cast("double")
    return d, r1, r2, F.least(r1, r2), F.greatest(r1, r2)


def _shares(r1: Column, r2: Column, d: Column, small: Column, need: Column) -> Column:
    """The common area is at least `need` (null: not looked at) of the smaller disc: worked out once for a pair, and last."""
    return need.isNotNull() & (lens_area(r1, r2, d) >= need * (math.pi * small * small))


def overlap(threshold: float):
    """The common area is at least `threshold` of the smaller disc."""

    def rule(p: Row, q: Row) -> Column:
        d, r1, r2, small, _ = _pair(p, q)
        return (small > 0) & (lens_area(r1, r2, d) >= threshold * (math.pi * small * small))

    return rule


def pool(threshold: float = 0.74):
    """Centres close for the radius, or much in common at some distance."""

    def rule(p: Row, q: Row) -> Column:
        d, r1, r2, small, large = _pair(p, q)
        near = lambda least, share: d <= F.greatest(F.lit(least), small * share)
        # a share of the larger disc is one of the smaller disc, times the areas' ratio
        ratio = (large * large) / F.when(small > 0, small * small)
        either = lambda a, b: F.least(F.lit(a), b * ratio)
        need = F.least(
            F.when(near(5.0, 0.50), 0.38),
            F.when(near(10.0, 0.85), either(threshold, threshold * 0.70)),
            F.when(near(6.0, 0.55), either(threshold * 0.65, threshold * 0.50)),
        )
        return (small > 0) & (near(3.0, 0.25) | _shares(r1, r2, d, small, need))

    return rule


def dense(factor: float = 1.80, least_overlap: float = 0.10, least_ratio: float = 0.35):
    """Radii of like size, and centres within a crown's core or one disc nearly inside the other."""

    def rule(p: Row, q: Row) -> Column:
        d, r1, r2, small, large = _pair(p, q)
        need = F.least(F.when(d + small <= large * 1.08, max(least_overlap, 0.35)), F.when(d <= F.greatest(F.lit(10.0), small * factor), least_overlap))
        return (small > 0) & (small >= least_ratio * large) & ((d <= F.greatest(F.lit(7.0), small * 0.82)) | _shares(r1, r2, d, small, need))

    return rule


def boxes(iou: float = 0.45, factor: float = 1.25, least_ratio: float = 0.40):
    """Boxes x1..y2 overlap, or centres are close for radii of like size; the second test is off at factor 0."""

    def rule(p: Row, q: Row) -> Column:
        corners = lambda r: tuple(r(c) for c in ("x1", "y1", "x2", "y2"))
        found = box_iou(corners(p), corners(q)) >= iou
        if factor > 0:
            d, _, _, small, large = _pair(p, q)
            found = found | ((small > 0) & (small >= least_ratio * large) & (d <= F.greatest(F.lit(8.0), small * factor)))
        return found

    return rule


def same_circle(least: float, share: float, threshold: float):
    """Centres within max(least, share of the smaller radius), or enough of the smaller disc in common."""

    def rule(p: Row, q: Row) -> Column:
        d, r1, r2, small, _ = _pair(p, q)
        small = F.greatest(F.lit(1.0), small)
        return (d <= F.greatest(F.lit(least), small * share)) | (lens_area(r1, r2, d) >= threshold * (math.pi * small * small))

    return rule


def proximity(factor: float = 0.72):
    """Centres within max(6, factor x the smaller radius)."""

    def rule(p: Row, q: Row) -> Column:
        d, _, _, small, _ = _pair(p, q)
        return d <= F.greatest(F.lit(6.0), small * factor)

    return rule
