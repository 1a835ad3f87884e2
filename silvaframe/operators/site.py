"""Analysis of a site from its pixels and trees: cover, deserts, carbon, waste regions, fire points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaframe.functions import rules
from silvaframe.operators import raster
from silvaframe.plans.scratch import stage

# Labels of what is found.
WASTE, FIRE = "疑似垃圾/堆放", "疑似火点"


@dataclass(frozen=True)
class Limits:
    """Which components of the masks are looked at, and from which score on they are reported.

    Areas are pixels, shares are of the image. For waste: margin to the border, longest side by shortest, shares of
    vegetation and bare soil, and the edge density or spread of colour of which one has to be reached.
    """

    waste_least: int = 180
    waste_share: tuple[float, float] = (0.00012, 0.010)
    margin: int = 3
    aspect: float = 3.2
    vegetation: float = 0.08
    bare: float = 0.52
    edge: float = 0.09
    colour: float = 24.0
    waste_cap: float = 0.95
    waste_top: int = 8
    fire_least: int = 14
    fire_share: float = 0.006
    pad: int = 12
    fire_cap: float = 0.96
    fire_top: int = 6
    cut: float = 0.72


def planes(pixels: DataFrame, edge: Column | None = None) -> DataFrame:
    """A row per pixel, written once: b, g, r, v and the masks vegetation, bare, anomaly, fire (cleaned), smoke and edge.

    edge: the answer of an edge detector, where there is one.
    """
    raw = raster.colour(pixels).withColumns(
        {"vegetation": raster.vegetation(), "bare": raster.bare_soil(), "anomaly": raster.colour_anomaly(), "fire": raster.fire_core(), "smoke": raster.smoke_like(), "edge": F.lit(False) if edge is None else edge}
    )
    raw = raw.select("image_id", "x", "y", "b", "g", "r", "v", "smoke", "edge", "vegetation", "bare", "anomaly", "fire")
    k3, k5, k7 = raster.square(3), raster.ellipse(5), raster.ellipse(7)
    opened = lambda k: [("e", k), ("d", k)]
    return stage(raster.morphed(raw, {"vegetation": opened(k5), "bare": opened(k5), "anomaly": [("d", k7), ("e", k7), *opened(k5)], "fire": opened(k3)}), "planes")


def sizes(planes: DataFrame) -> DataFrame:
    return planes.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count(F.lit(1)).alias("total"))


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k surest of each image, ties by label."""
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("confidence"), "component"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def waste_regions(planes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(image_id, place, label, x, y, w, h, area_px, confidence, edge_density, color_std): components of odd colour that look like waste."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    on = raster.components(planes, "anomaly").withColumn("bright", F.col("v") > 170)
    c = on.groupBy("image_id", F.col("label").alias("component")).agg(
        F.count(F.lit(1)).alias("area_px"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
        share("vegetation").alias("veg"), share("bare").alias("bare"), share("edge").alias("edges"), share("bright").alias("lit"), ((F.stddev_pop("b") + F.stddev_pop("g") + F.stddev_pop("r")) / 3).alias("spread"),
    )
    low, high = F.greatest(F.lit(limits.waste_least), F.floor(F.col("total") * limits.waste_share[0])), F.floor(F.col("total") * limits.waste_share[1])
    m = limits.margin
    c = c.join(sizes(planes), "image_id").withColumn("high", high).where(F.col("area_px").between(low, high))
    c = c.where((F.col("x") > m) & (F.col("y") > m) & (F.col("x") + F.col("w") < F.col("width") - m) & (F.col("y") + F.col("h") < F.col("height") - m))
    c = c.where(F.greatest("w", "h") / F.least("w", "h") <= limits.aspect).where((F.col("veg") <= limits.vegetation) & (F.col("bare") <= limits.bare))
    c = c.where((F.col("edges") >= limits.edge) | (F.col("spread") >= limits.colour))
    score = rules.waste_score(F.col("edges"), F.col("spread"), F.col("area_px") / (F.col("w") * F.col("h")), F.col("lit"), F.col("area_px"), F.col("high"), F.col("bare"))
    c = c.withColumn("score", score).where(F.col("score") >= limits.cut).withColumn("confidence", F.bround(F.least(F.lit(limits.waste_cap), "score"), 2))
    return _top(c, limits.waste_top).select("image_id", "place", F.lit(WASTE).alias("label"), "x", "y", "w", "h", "area_px", "confidence", F.bround("edges", 3).alias("edge_density"), F.bround("spread", 1).alias("color_std"))


def fire_points(planes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(image_id, place, label, x, y, radius, area_px, confidence, smoke_ratio): bright red components with smoke around them counted in."""
    on = raster.components(planes, "fire").withColumn("red", F.col("r") - F.greatest("g", "b"))
    c = on.groupBy("image_id", F.col("label").alias("component")).agg(
        F.count(F.lit(1)).alias("area_px"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("red").alias("red"), F.avg("v").alias("hot"),
    )
    c = c.join(sizes(planes), "image_id").where((F.col("area_px") >= limits.fire_least) & (F.col("area_px") <= F.col("total") * limits.fire_share))
    pad = F.greatest(F.lit(limits.pad), 2 * F.greatest(F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1))
    c = c.withColumn("pad", pad).withColumns({
        "hx1": F.greatest(F.lit(0), F.col("x1") - F.col("pad")), "hx2": F.least("width", F.col("x2") + 1 + F.col("pad")), "hy1": F.greatest(F.lit(0), F.col("y1") - F.col("pad")), "hy2": F.least("height", F.col("y2") + 1 + F.col("pad")),
    })
    c = stage(c, "fires")
    # smoke of each row of a halo by prefix sums: two places are looked up for each row, whatever the halo's width
    row = Window.partitionBy("image_id", "y").orderBy("x")
    upto = planes.select("image_id", "y", F.col("x").alias("at"), F.sum(F.col("smoke").cast("int")).over(row).alias("upto"))
    sides = F.array(F.struct((F.col("hx1") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("hx2") - 1).alias("at"), F.lit(1).alias("sign")))
    ends = c.withColumn("y", F.explode(F.sequence("hy1", F.col("hy2") - 1))).withColumn("e", F.explode(sides)).select("image_id", "component", "y", "e.at", "e.sign")
    smoke = ends.join(upto.hint("merge"), ["image_id", "y", "at"]).groupBy("image_id", "component").agg(F.sum(F.col("sign") * F.col("upto")).alias("smoke"))
    ratio = F.coalesce("smoke", F.lit(0)) / ((F.col("hx2") - F.col("hx1")) * (F.col("hy2") - F.col("hy1")))
    c = c.join(smoke, ["image_id", "component"], "left").withColumn("smoke_ratio", ratio)
    c = c.withColumn("score", rules.fire_confidence(F.col("red"), F.col("hot"), F.col("area_px"), F.col("smoke_ratio"))).where(F.col("score") >= limits.cut)
    c = c.withColumn("confidence", F.bround(F.least(F.lit(limits.fire_cap), "score"), 2)).withColumn("radius", rules.fire_radius(F.col("area_px")))
    return _top(c, limits.fire_top).select("image_id", "place", F.lit(FIRE).alias("label"), "x", "y", "radius", "area_px", "confidence", F.bround("smoke_ratio", 3).alias("smoke_ratio"))


def summary(planes: DataFrame, trees: DataFrame, cell: int, metres: float = 0.10) -> DataFrame:
    """A row per image: size, trees, cover of vegetation, canopy and bare soil in per cent, desert level, carbon, dominant species.

    trees (image_id, idx, cx, cy, radius, species): the canopy is the union of their discs, whose radius is `cell` at most.
    """
    under = raster.in_discs(planes.select(*raster.PIXEL), trees.select("image_id", "idx", "cx", "cy", F.greatest(F.lit(1), "radius").alias("radius")), cell)
    canopy = under.select(*raster.PIXEL).distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("canopy"))
    kinds = trees.groupBy("image_id", "species").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    kinds = kinds.groupBy("image_id").agg(F.sum("n").alias("tree_count"), F.max_by("species", F.struct("n", -F.col("first"))).alias("dominant_species"))
    area = planes.groupBy("image_id").agg(F.count_if("vegetation").alias("veg"), F.count_if("bare").alias("soil"))
    out = sizes(planes).join(area, "image_id").join(canopy, "image_id", "left").join(kinds, "image_id", "left")
    pct = lambda c: F.coalesce(c, F.lit(0)) / F.col("total") * 100.0
    hectares = rules.green_hectares(F.col("veg"), metres)
    return out.select(
        "image_id",
        F.col("width").alias("image_width"),
        F.col("height").alias("image_height"),
        F.coalesce("tree_count", F.lit(0)).alias("tree_count"),
        F.bround(pct(F.col("veg")), 2).alias("vegetation_cover_pct"),
        F.bround(F.least(F.lit(100.0), pct(F.col("canopy"))), 2).alias("canopy_cover_pct"),
        F.bround(pct(F.col("soil")), 2).alias("bare_soil_pct"),
        rules.desert_level(pct(F.col("soil")), pct(F.col("veg"))).alias("desertification_level"),
        F.bround(hectares * 18.0, 2).alias("carbon_stock_tco2e"),
        F.bround(hectares * 6.0, 2).alias("annual_sink_tco2e"),
        F.coalesce("dominant_species", F.lit("--")).alias("dominant_species"),
    )
