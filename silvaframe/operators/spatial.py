"""Pairs of nearby rows by grid cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: conflict(p, q): p and q give the columns of either row by name.
Conflict = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def grid_pairs(
    left: DataFrame, right: DataFrame, on: list[str], cell: Column | float, condition: Conflict, how: str = "inner", keep: tuple[list[str] | None, list[str] | None] = (None, None), reach: Callable[[Callable[[str], Column]], Column] | None = None
) -> DataFrame:
    """Pairs (p: struct of left, q: struct of right) that meet `condition`.

    reach: how far a row goes from its place in x and in y; rows whose squares of that reach do not touch must not meet the
    condition. Both sides are copied to the cells that their squares touch, and a pair counts in the one cell that holds the
    lower corner of what the squares share. So any `cell` gives the same pairs, and a row of wide reach only adds copies of itself.
    Without reach (as `how` other than inner asks for) pairs may be `cell` apart at most: the left side keeps its own cell, the right one is copied to the
    nine cells around it. The join is an equi-join on (on, cell x, cell y) with the condition as its residue. Dense groups are
    split by their cells; nothing is broadcast unless the planner finds a side small. keep: the columns that p and q carry
    besides those that the condition and the reach read; all where None.
    """
    read = (set(), set())
    condition(*[lambda c, names=names: names.add(c) or F.col(c) for names in read])
    for names in read if reach else ():
        reach(lambda c, names=names: names.add(c) or F.col(c))
    left, right = (df if some is None else df.select(*dict.fromkeys([*on, "x", "y", *some, *sorted(names)])) for df, some, names in zip((left, right), keep, read))
    keys = [*on, "_cx", "_cy"]
    if reach:
        def filed(df: DataFrame, name: str) -> DataFrame:
            r = reach(lambda c: F.col(f"{name}.{c}"))
            at = lambda c, d: F.floor((F.col(f"{name}.{c}") + d * r) / cell).cast("long")
            out = df.select(*on, F.struct("*").alias(name)).withColumn("_cx", F.explode(F.sequence(at("x", -1), at("x", 1))))
            return out.withColumn("_cy", F.explode(F.sequence(at("y", -1), at("y", 1))))

        p, q = filed(left, "p"), filed(right, "q")
    else:
        of = lambda c, d: F.floor(F.col(c) / cell + d).cast("long")
        near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
        p = left.select(*on, of("x", 0).alias("_cx"), of("y", 0).alias("_cy"), F.struct("*").alias("p"))
        q = right.select(*on, F.struct("*").alias("q")).withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
        q = q.select(*on, (F.floor(F.col("q.x") / cell).cast("long") + F.col("_dx")).alias("_cx"), (F.floor(F.col("q.y") / cell).cast("long") + F.col("_dy")).alias("_cy"), "q")
    a, b = p.alias("a"), q.alias("b")
    of_p, of_q = (lambda c: F.col(f"a.p.{c}")), (lambda c: F.col(f"b.q.{c}"))
    match = condition(of_p, of_q)
    if reach:
        low = lambda c: F.floor(F.greatest(of_p(c) - reach(of_p), of_q(c) - reach(of_q)) / cell)
        match = (low("x") == F.col("a._cx")) & (low("y") == F.col("a._cy")) & match
    for k in keys:
        match = (F.col(f"a.{k}") == F.col(f"b.{k}")) & match
    out = a.join(b, match, how)
    return out.select("a.p", "b.q") if how in ("inner", "left") else out.select("p")


def point_pairs(
    points: DataFrame, shapes: DataFrame, on: list[str], cell: float, condition: Conflict, reach: Callable[[Callable[[str], Column]], Column], keep: tuple[list[str], list[str]] = ([], [])
) -> DataFrame:
    """Pairs (on, p: struct of a point, q: struct of a shape) that meet `condition`, which must not hold farther from a shape's place, in x or in y, than it reaches.

    A shape moves once: it is filed in the cell of its place, on a grid whose cells are twice as wide as it reaches or more (2 x `cell`, doubled
    as often as needed). Points, taken to be the fewer rows, are copied to the four cells around them on each grid that is in use, of which
    the planner is told by a table of a row for each. So any `cell` gives the same pairs. p and q carry their places, what the condition reads, and `keep`.
    """
    read = (set(), set())
    condition(*[lambda c, names=names: names.add(c) or F.col(c) for names in read])
    carried = [[*dict.fromkeys(["x", "y", *some, *sorted(names)])] for some, names in zip(keep, read)]
    side = 2.0 * cell * F.pow(F.lit(2.0), F.col("_grid"))
    level = F.ceil(F.least(F.greatest(F.log2(F.col("_reach") / cell), F.lit(0.0)), F.lit(60.0))).cast("int")
    q = shapes.withColumn("_reach", reach(F.col).cast("double") * (1 + 1e-9)).withColumn("_grid", level)
    at = lambda c, d: F.floor((F.col(c) + d * side) / side)
    b = q.select(*on, "_grid", at("x", 0.0).alias("_cx"), at("y", 0.0).alias("_cy"), F.struct(*carried[1], "_reach").alias("q")).alias("b")
    a = points.join(F.broadcast(q.select("_grid").distinct())).withColumn("_cx", F.explode(F.sequence(at("x", -0.5), at("x", 0.5))))
    a = a.withColumn("_cy", F.explode(F.sequence(at("y", -0.5), at("y", 0.5)))).select(*on, "_grid", "_cx", "_cy", F.struct(*carried[0]).alias("p")).alias("a")
    near = lambda c: F.abs(F.col(f"a.p.{c}") - F.col(f"b.q.{c}")) <= F.col("b.q._reach")
    match = near("x") & near("y") & condition(lambda c: F.col(f"a.p.{c}"), lambda c: F.col(f"b.q.{c}"))
    for k in (*on, "_grid", "_cx", "_cy"):
        match = (F.col(f"a.{k}") == F.col(f"b.{k}")) & match
    return a.join(b, match).select(*[f"a.{k}" for k in on], "a.p", "b.q")


def disc_reach(row: Callable[[str], Column]) -> Column:
    """Discs in conflict overlap, or their centres are no farther apart than 12 pixels."""
    return F.greatest(row("radius").cast("double"), F.lit(6.0))


def box_reach(row: Callable[[str], Column]) -> Column:
    """Boxes in conflict overlap, or the centres of their discs are no farther apart than 12 pixels."""
    return F.greatest(disc_reach(row), row("x2") - row("x"), row("x") - row("x1"), row("y2") - row("y"), row("y") - row("y1"))


def widest(df: DataFrame, factor: float, least: float) -> float:
    """A cell side that no conflict exceeds: the larger of `least` and factor x the largest radius, plus 2."""
    r = df.agg(F.max("radius")).first()[0] or 0
    return float(max(least, factor * r) + 2)
