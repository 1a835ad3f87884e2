"""Greedy suppression: a row stays if it conflicts with no better row that stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaframe.operators.spatial import Conflict, disc_reach, grid_pairs
from silvaframe.plans.scratch import stage

#: Rows of a group up to which the group is folded within one row of a DataFrame.
FOLD = 512


def _fold(df: DataFrame, conflict: Conflict, by: str, reach) -> DataFrame:
    """Groups of a checked size: sort the group's rows and scan them, all inside one aggregation. Of most pairs the reach tells that they are too far apart."""
    apart = lambda p, q, c: F.abs(p(c) - q(c)) > reach(p) + reach(q)
    meets = lambda p, q: F.when(apart(p, q, "x") | apart(p, q, "y"), False).otherwise(conflict(p, q))
    rows = F.array_sort(F.collect_list(F.struct("_rank", F.struct(*[c for c in df.columns if c != "_rank"]).alias("row"))))
    kind = df.drop("_rank").schema.simpleString().removeprefix("struct<").removesuffix(">")
    empty = F.array().cast(f"array<struct<{kind}>>")
    of = lambda r: lambda c: r[c]
    kept = F.aggregate(rows, empty, lambda acc, v: F.when(F.exists(acc, lambda e: meets(of(v["row"]), of(e))), acc).otherwise(F.array_append(acc, v["row"])))
    return df.groupBy(by).agg(kept.alias("kept")).select(F.inline("kept"))


def _fixpoint(df: DataFrame, conflict: Conflict, by: str, cell: float, reach) -> DataFrame:
    """Groups of any size: conflict edges by a grid join, then rounds. A row without a better rival left
    stays; rows with a better one that stays go. The rounds needed grow with the log of a group at most
    as a rule; every round is written and reread."""
    better = lambda p, q: (q("_rank") < p("_rank")) & conflict(p, q)
    pairs = grid_pairs(df, df, [by], cell, better, keep=(["_rank"], ["_rank"]), reach=reach)
    edges = stage(pairs.select(F.col("p._rank").alias("worse"), F.col("q._rank").alias("better"), F.col(f"p.{by}").alias("g")), "edges")
    gone = None
    while True:
        free = edges.select("g", F.col("better").alias("r")).join(edges.select("g", F.col("worse").alias("r")), ["g", "r"], "left_anti").distinct()
        beaten = stage(edges.join(free.withColumnRenamed("r", "better"), ["g", "better"], "left_semi").select("g", F.col("worse").alias("r")).distinct(), "beaten")
        gone = beaten if gone is None else gone.unionByName(beaten)
        edges = edges.join(beaten.withColumnRenamed("r", "worse"), ["g", "worse"], "left_anti").join(beaten.withColumnRenamed("r", "better"), ["g", "better"], "left_anti")
        edges = stage(edges, "edges")
        if not edges.limit(1).count():
            break
    return df.join(gone.select(F.col("g").alias(by), F.col("r").alias("_rank")), [by, "_rank"], "left_anti")


def suppress(df: DataFrame, rank: list[Column], conflict: Conflict, cell: float, by: str = "image_id", strategy: str = "auto", reach=disc_reach) -> DataFrame:
    """The rows of df that greedy suppression keeps, with all their columns.

    `rank` sorts ascending, best first, and has to be total within a group (end it with the row's
    number). reach tells how far a row's conflicts go (`grid_pairs`); `cell` only decides how many copies a row has, not
    which rows stay. The input is written once. strategy: fold for groups of at most FOLD rows, which is counted; fixpoint for any; auto takes
    either for each group by its size.
    """
    df = stage(df, "suppress")
    ranked = df.withColumn("_rank", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(rank)]))
    if strategy == "auto":
        sizes = df.groupBy(by).count()
        large = stage(sizes.where(F.col("count") > FOLD).select(by), "large")
        if large.limit(1).count():
            small = _fold(ranked.join(large, by, "left_anti").select(*ranked.columns), conflict, by, reach)
            return small.select(*df.columns).unionByName(_fixpoint(ranked.join(large, by, "left_semi"), conflict, by, cell, reach).select(*df.columns))
        strategy = "fold"
    out = _fold(ranked, conflict, by, reach) if strategy == "fold" else _fixpoint(ranked, conflict, by, cell, reach)
    return out.select(*df.columns)


def first_suppressor(df: DataFrame, kept: DataFrame, rank: list[Column], conflict: Conflict, cell: float, by: str = "image_id", reach=disc_reach) -> DataFrame:
    """Rows of df that are not kept, with the best kept row in conflict: duplicate_of_x, _y, _radius."""
    ranked = lambda d: d.withColumn("_rank", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(rank)]))
    gone = ranked(df).join(kept.select(by, "idx"), [by, "idx"], "left_anti")
    pairs = grid_pairs(gone, ranked(kept), [by], cell, lambda p, q: (q("_rank") < p("_rank")) & conflict(p, q), keep=(None, ["_rank", "radius"]), reach=reach)
    first = pairs.groupBy("p").agg(F.min(F.struct("q._rank", "q.x", "q.y", "q.radius")).alias("q"))
    return first.select(*[F.col(f"p.{c}") for c in df.columns], F.col("q.x").alias("duplicate_of_x"), F.col("q.y").alias("duplicate_of_y"), F.col("q.radius").alias("duplicate_of_radius"))


def renumber(df: DataFrame, by: str = "image_id", out: str = "id") -> DataFrame:
    """Numbers rows from 1 by (y, x), ties by idx."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy("y", "x", "idx")))
