"""Candidate rows from component statistics, presets, and pools of candidates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silvaframe.functions import conflicts, rules
from silvaframe.functions.geometry import aspect, circularity
from silvaframe.operators.spatial import widest
from silvaframe.operators.suppress import renumber, suppress

#: Shape limits by preset: circularity, fill, area and radius from and to.
PRESETS = [("precision", 0.60, 0.45, 120.0, 3000.0, 10, 50), ("balanced", 0.45, 0.35, 90.0, 3500.0, 8, 55), ("recall", 0.25, 0.22, 60.0, 4100.0, 6, 60)]


def preset_table(spark: SparkSession, presets: list[tuple] = PRESETS) -> DataFrame:
    return spark.createDataFrame(presets, "preset string, circ double, fill double, low double, high double, r_low int, r_high int")


def by_preset(df: DataFrame, presets: DataFrame) -> DataFrame:
    """Rows under each preset whose limits they meet. The presets are a handful of rows, written out above."""
    ok = (F.col("circularity") >= F.col("circ")) & (F.col("fill_ratio") >= F.col("fill")) & F.col("area_px").between(F.col("low"), F.col("high")) & F.col("radius").between(F.col("r_low"), F.col("r_high"))
    return df.join(F.broadcast(presets), ok)


def from_components(df: DataFrame, area: tuple, circ: float, fill: float, ratio: float, scale: float | None, radius: tuple) -> DataFrame:
    """Components that look like crowns, with radius_out; cheap tests first.

    With a scale the radius is that of the enclosing circle, scaled; without one it follows from the
    peak of the distance field and the area. Rounding is half to even.
    """
    df = df.where(F.col("area_px").between(*area)).where("perimeter > 0").withColumn("circ", circularity(F.col("area_px"), F.col("perimeter"))).where(F.col("circ") >= circ)
    df = df.where("enclosing > 0").withColumn("fill", F.col("area_px") / (math.pi * F.col("enclosing") * F.col("enclosing"))).where(F.col("fill") >= fill)
    df = df.where(aspect(F.col("bw"), F.col("bh")) <= ratio)
    if scale is not None:
        r = scale * F.col("enclosing")
    else:
        r = F.least(0.95 * F.col("enclosing"), F.greatest(1.70 * F.col("peak") + 3, 0.95 * F.sqrt(F.col("area_px") / math.pi), F.lit(float(radius[0]))))
    return df.withColumn("radius_out", F.bround(r, 0).cast("int")).where(F.col("radius_out").between(*radius))


def original(df: DataFrame, width: int, height: int, least_area: float, circ: float) -> DataFrame:
    """The first detector's rule: limits follow the image's size, numbers are cut rather than rounded."""
    ok = (F.col("area_px") >= least_area) & (F.col("area_px") <= 0.02 * width * height) & (circularity(F.col("area_px"), F.col("perimeter")) >= circ)
    out = df.where(ok).withColumn("radius_out", F.col("enclosing").cast("int"))
    return out.where((F.col("radius_out") >= 4) & (F.col("enclosing") <= 0.08 * min(width, height)))


def ensemble(parts: list[DataFrame], threshold: float) -> DataFrame:
    """The union of candidate lists, deduplicated by quality and renumbered."""
    pool = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    pool = pool.withColumn("quality", rules.quality(F.col("source"), F.col("circularity"), F.col("fill_ratio"), F.lit(None).cast("double"), F.col("radius"), F.col("area_px")))
    return renumber(suppress(pool, [-F.col("quality"), F.col("idx")], conflicts.pool(threshold), widest(pool, 2.0, 10)))


def rescale(df: DataFrame, sx: float, sy: float) -> DataFrame:
    """Coordinates of a scaled image: radii by the mean factor, areas by the product, half to even."""
    mean = (sx + sy) / 2
    return df.withColumns(
        {
            "x": F.bround(F.col("x") * sx, 0).cast("int"),
            "y": F.bround(F.col("y") * sy, 0).cast("int"),
            "radius": F.bround(F.col("radius") * mean, 0).cast("int"),
            "area_px": F.bround(F.col("area_px") * (sx * sy), 2),
        }
    )


def batches(df: DataFrame, size: int, by: str = "image_id") -> DataFrame:
    """Adds position (from 1, by idx) and batch (from 0) of `size` rows."""
    at = F.row_number().over(Window.partitionBy(by).orderBy("idx"))
    return df.withColumn("position", at).withColumn("batch", F.expr(f"int((position - 1) div {size})"))
