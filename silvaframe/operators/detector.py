"""Detectors: from an image's pixels over masks, crowns and shapes to numbered detections; refinement by crown cores."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaframe.functions import conflicts, rules
from silvaframe.operators import candidates, field, raster, shape
from silvaframe.operators.raster import PIXEL
from silvaframe.operators.spatial import widest
from silvaframe.operators.suppress import renumber, suppress
from silvaframe.plans.scratch import stage

#: Between the numbers of candidates of one stage and of the next: more than any image has pixels.
STAGE = 10**13
PART = ("image_id", "label", "part")
#: Side of the squares in which pixels meet discs: about as wide as crowns, so that most pixels that meet a disc lie in it.
CELL = 16


def measured(labelled: DataFrame, heights: DataFrame | None, area: tuple[float, float]) -> DataFrame:
    """(image_id, label, area_px, perimeter, enclosing, bw, bh, cx, cy, peak): the shape of each region whose area lies within bounds.

    A region that is in several pieces counts by the one of the largest contour. The centre is the centroid of
    the contour, or that of the enclosing circle where there is none. peak: the largest height in the region.
    """
    lab = stage(raster.components(labelled.select("image_id", F.col("label").alias("region"), "x", "y").withColumn("_on", F.lit(True)), "_on", ("image_id", "region")).select("image_id", F.col("region").alias("label"), F.col("label").alias("part"), "x", "y"), "parts")
    stats = shape.contour_stats(lab, shape.contours(lab, PART), PART)
    largest = Window.partitionBy("image_id", "label").orderBy(F.desc("area"), "part")
    stats = stage(stats.withColumn("_n", F.row_number().over(largest)).where("_n = 1").where(F.col("area").between(*area)).drop("_n"), "stats")
    round_ = shape.enclosing_circles(shape.hulls(lab.join(stats.select(*PART).hint("merge"), list(PART), "left_semi"), PART), PART)
    out = stats.join(round_.hint("merge"), list(PART)).select("image_id", "label", F.col("area").alias("area_px"), "perimeter", F.col("er").alias("enclosing"), F.col("w").alias("bw"), F.col("h").alias("bh"), F.coalesce("cx", "ex").alias("cx"), F.coalesce("cy", "ey").alias("cy"), "ex", "ey")
    if heights is None:
        return out
    peak = labelled.join(heights.hint("merge"), PIXEL).groupBy("image_id", "label").agg(F.max("distance").alias("peak"))
    return out.join(peak.hint("merge"), ["image_id", "label"])


@dataclass(frozen=True)
class Rule:
    """What a region has to be like to count as a crown. scale: of the enclosing circle; without it the radius follows from peak and area."""

    area: tuple[float, float] = (150, 7500)
    circularity: float = 0.12
    fill: float = 0.22
    radius: tuple[int, int] = (8, 58)
    aspect: float = 2.7
    scale: float | None = None


def detections(labelled: DataFrame, heights: DataFrame | None, rule: Rule, source: str, stage_no: int = 0) -> DataFrame:
    """(image_id, idx, x, y, radius, area_px, circularity, fill_ratio, peak_radius, source); idx is in order of the regions' first pixels."""
    found = candidates.from_components(measured(labelled, heights, rule.area), rule.area, rule.circularity, rule.fill, rule.aspect, rule.scale, rule.radius)
    whole = lambda c: F.bround(c, 0).cast("int").alias(c[-1])
    peak = F.bround("peak", 2) if heights is not None else F.lit(None).cast("double")
    return found.select("image_id", (F.col("label") + stage_no * STAGE).alias("idx"), whole("cx"), whole("cy"), F.col("radius_out").alias("radius"), F.bround("area_px", 2).alias("area_px"), F.bround("circ", 3).alias("circularity"), F.bround("fill", 3).alias("fill_ratio"), peak.alias("peak_radius"), F.lit(source).alias("source"))


def _cleaned(pixels: DataFrame, mask: Column, steps: list[tuple[str, int]]) -> DataFrame:
    """(image_id, x, y, mask) after opening and closing by elliptic kernels."""
    todo = [(step, raster.ellipse(size)) for kind, size in steps for step in ("ed" if kind == "open" else "de")]
    return stage(raster.morphed(pixels.select(*PIXEL, F.coalesce(mask, F.lit(False)).alias("mask")), {"mask": todo}), "mask")


def tree_mask(pixels: DataFrame, s: int = 25, v: int = 40, exg: int = 10) -> DataFrame:
    return _cleaned(pixels, raster.tree_mask(s, v, exg), [("open", 3), ("close", 3)])


def overlapping_gone(found: DataFrame, threshold: float) -> DataFrame:
    found = stage(found, "detections")
    return suppress(found, [-F.col("area_px"), -F.col("radius"), F.col("idx")], conflicts.overlap(threshold), widest(found, 2.0, 10))


def pooled(found: DataFrame, threshold: float) -> DataFrame:
    """One detection of each crown, by quality, in order of quality: idx is its place."""
    green = F.col("green_ratio") if "green_ratio" in found.columns else F.lit(None).cast("double")
    found = stage(found.withColumn("_quality", rules.quality(F.col("source"), F.col("circularity"), F.col("fill_ratio"), green, F.col("radius"), F.col("area_px"))), "pool")
    kept = suppress(found, [-F.col("_quality"), F.col("idx")], conflicts.pool(threshold), widest(found, 2.0, 10))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("_quality"), "idx"))
    return stage(kept.withColumn("idx", place.cast("long")).drop("_quality"), "pool")


@dataclass(frozen=True)
class Reference:
    """Settings of the detector by peaks: mask, peak distance, rule and overlap from which the smaller one goes."""

    s: int = 30
    v: int = 40
    exg: int = 14
    peak_distance: int = 16
    rule: Rule = Rule()
    overlap: float = 0.72


# The looser settings that fill in what the first ones miss, and those for what is left over.
RECALL = Reference(26, 36, 10, 12, Rule(area=(120, 6800), circularity=0.08, fill=0.16, radius=(6, 62)), 0.70)
RESIDUAL = Rule(area=(300, 4500), circularity=0.14, fill=0.28, radius=(8, 52))


def reference(pixels: DataFrame, settings: Reference = Reference(), source: str = "reference", stage_no: int = 0) -> tuple[DataFrame, DataFrame]:
    """(detections with id by position, mask) of coloured pixels: crowns split at the peaks of their distance field, radius from peak and area."""
    mask = tree_mask(pixels, settings.s, settings.v, settings.exg)
    labelled, heights = field.crowns(mask, "mask", settings.peak_distance)
    return renumber(overlapping_gone(detections(labelled, heights, settings.rule, source, stage_no), settings.overlap)), mask


def residual(mask: DataFrame, found: DataFrame, stage_no: int) -> DataFrame:
    """Detections on what of the mask lies under no disc found so far, opened and closed."""
    discs = found.select("image_id", "idx", F.col("x").alias("cx"), F.col("y").alias("cy"), F.greatest(F.lit(2), "radius").alias("radius"))
    under = raster.in_discs(mask.where("mask").select(*PIXEL), discs, CELL).select(*PIXEL).distinct().withColumn("_under", F.lit(True))
    rest = mask.join(under.hint("merge"), PIXEL, "left")
    rest = _cleaned(rest, F.col("mask") & F.col("_under").isNull(), [("open", 3), ("close", 5)])
    labelled, heights = field.crowns(rest, "mask", 20)
    return detections(labelled, heights, RESIDUAL, "residual", stage_no)


def peaks(mask: DataFrame, found: DataFrame, stage_no: int, least: float = 8.0, least_px: int = 300, least_fill: float = 0.28) -> DataFrame:
    """Detections around peaks of the distance field that are near no detection found so far, nor near an earlier peak taken.

    A peak is a component of pixels that are highest under a kernel of 19 and reach `least`; its highest pixel counts, the first of equals."""
    narrow = mask.select(*PIXEL, "mask")
    top = field.highest(field.distance(narrow, "mask"), "distance", raster.ellipse(19), "top").withColumn("_on", (F.col("distance") == F.col("top")) & (F.col("distance") >= least))
    comp = raster.components(top.select(*PIXEL, "distance", "_on"), "_on")
    best = comp.groupBy("image_id", "label").agg(F.max(F.struct("distance", (-shape.pixel_key(F.col("x"), F.col("y"))).alias("first"), "x", "y")).alias("m"))
    at = best.select("image_id", F.col("label").alias("idx"), F.col("m.x").alias("cx"), F.col("m.y").alias("cy"), F.col("m.distance").alias("peak"))
    at = stage(at.withColumn("radius", F.bround(F.greatest(F.lit(6.0), F.least(F.lit(50.0), F.col("peak") * 1.70 + 3.0)), 0).cast("int")), "peaks")
    px = raster.in_discs(mask.where("mask").select(*PIXEL), at.select("image_id", "idx", "cx", "cy", "radius"), CELL).groupBy("image_id", "idx").agg(F.count(F.lit(1)).alias("px"))
    fill = F.col("px") / (math.pi * F.col("radius") * F.col("radius"))
    own = at.join(px.hint("merge"), ["image_id", "idx"]).where((F.col("px") >= least_px) & (fill >= least_fill))
    own = own.select(
        "image_id", (F.col("idx") + stage_no * STAGE).alias("idx"), F.col("cx").alias("x"), F.col("cy").alias("y"), "radius", F.col("px").cast("double").alias("area_px"),
        F.lit(0.0).alias("circularity"), F.bround(fill, 3).alias("fill_ratio"), F.bround("peak", 2).alias("peak_radius"), F.lit("peak").alias("source"), F.lit(True).alias("_fresh"),
    )
    both = stage(found.select(*[c for c in own.columns if c != "_fresh"], F.lit(False).alias("_fresh")).unionByName(own), "peaks")
    near = conflicts.proximity(0.90)
    # those found before stay in any case
    kept = suppress(both, [F.col("_fresh").cast("int"), F.col("idx")], lambda p, q: (p("_fresh") | q("_fresh")) & near(p, q), widest(both, 1.0, 10))
    return kept.where("_fresh").drop("_fresh")


def ensemble(pixels: DataFrame, gap_fill: bool = True, peak_supplement: bool = True, threshold: float = 0.60) -> tuple[DataFrame, DataFrame]:
    """(detections with id by position, mask): strict and loose settings in one pool, then what is left over, then peaks; each
    stage reads the pool as the one before left it."""
    first, mask = reference(pixels)
    second, loose = reference(pixels, RECALL, "recall", 1)
    mask = stage(mask.unionByName(loose).groupBy(*PIXEL).agg(F.max("mask").alias("mask")), "mask")
    pool = pooled(first.drop("id").unionByName(second.drop("id")), threshold)
    if gap_fill:
        pool = pooled(pool.unionByName(residual(mask, pool, 2)), threshold)
    if peak_supplement:
        pool = pooled(pool.unionByName(peaks(mask, pool, 3)), threshold)
    return renumber(pool), mask


@dataclass(frozen=True)
class Settings:
    """Settings of the detector by enclosing circles. lab, shadow: the vote of three with Lab's planes and without shadows."""

    s: int = 35
    v: int = 45
    exg: int = 12
    rule: Rule = Rule(area=(120, 6800), fill=0.28, aspect=2.8, scale=1.15)
    overlap: float = 0.62
    split: bool = True
    peak_distance: int = 0
    least_peak: int = 0
    lab: bool = False
    shadow: bool = False


_RULE = Rule(aspect=2.8, scale=1.15)
# Settings by name.
PRESETS = {
    "precision": Settings(22, 38, 10, replace(_RULE, area=(100, 8000), circularity=0.10, radius=(6, 62)), 0.70, lab=True, shadow=True),
    "balanced": Settings(38, 42, 18, replace(_RULE, area=(150, 6000), circularity=0.15, fill=0.30, radius=(8, 56)), 0.74),
    "recall": Settings(28, 38, 10, replace(_RULE, area=(90, 6800), circularity=0.10, radius=(6, 62)), 0.76),
}


def voted_mask(pixels: DataFrame, settings: Settings) -> DataFrame:
    """(image_id, x, y, mask): two votes of three, less shadows, opened and closed; small blobs go."""
    p = raster.lab(pixels) if settings.lab else pixels
    mask = raster.vote_mask(F.col("lab_a") if settings.lab else None, F.col("lab_l") if settings.lab and settings.shadow else None, settings.exg, settings.s, settings.v, settings.shadow)
    p = _cleaned(p, mask, [("open", 3), ("close", 7), ("close", 9)])
    return stage(raster.without_small(p, "mask", settings.rule.area[0] // 2), "mask")


def enclosed(pixels: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(detections with id by position, mask): crowns split or not, radius of the enclosing circle, scaled."""
    mask = voted_mask(pixels, settings) if settings.lab or settings.shadow else tree_mask(pixels, settings.s, settings.v, settings.exg)
    labelled = field.crowns(mask, "mask", settings.peak_distance, settings.least_peak)[0] if settings.split else field.filled_regions(mask, "mask")
    return renumber(overlapping_gone(detections(labelled, None, settings.rule, "opencv"), settings.overlap)), mask


def original(pixels: DataFrame, area: tuple[float, float] = (80, 9000), circ: float = 0.08, widest_share: float = 0.08, largest_share: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(detections with id by position, mask): the first detector; its limits follow the image's size."""
    mask = _cleaned(raster.original_mask(pixels), F.col("original") & (F.col("s") >= 35) & (F.col("v") >= 45), [("open", 3), ("close", 7), ("close", 7)])
    size = mask.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    found = measured(field.filled_regions(mask, "mask"), None, area).where("perimeter > 0").join(size, "image_id")
    found = found.withColumn("circ", candidates.circularity(F.col("area_px"), F.col("perimeter"))).where(F.col("circ") >= circ).withColumn("radius", F.col("enclosing").cast("int"))
    found = found.where((F.col("radius") >= 4) & (F.col("radius") <= widest_share * F.least("width", "height")) & (F.col("area_px") <= largest_share * F.col("width") * F.col("height")))
    return renumber(found.select("image_id", F.col("label").alias("idx"), F.col("ex").cast("int").alias("x"), F.col("ey").cast("int").alias("y"), "radius", F.bround("area_px", 2).alias("area_px"), F.bround("circ", 3).alias("circularity"))), mask


def detect(pixels: DataFrame, preset: str = "ensemble") -> tuple[DataFrame, DataFrame]:
    """(detections, mask) of pixels (image_id, x, y, b, g, r) by the detector of that name: original, reference, ensemble, precision, balanced or recall."""
    coloured = stage(raster.colour(pixels.select(*PIXEL, "b", "g", "r")), "coloured")
    if preset in PRESETS:
        return enclosed(coloured, PRESETS[preset])
    if preset not in ("original", "reference", "ensemble"):
        raise ValueError(f"no detector of the name {preset!r}")
    return {"original": original, "reference": reference, "ensemble": ensemble}[preset](coloured)


def core_mask(pixels: DataFrame) -> DataFrame:
    """(image_id, x, y, mask): the core of crowns, opened and closed."""
    return _cleaned(raster.crown_core(pixels), F.col("core"), [("open", 3), ("close", 3)])


def core_decisions(core: DataFrame, found: DataFrame, least_green: float = 0.28, least_px: int = 30, largest: int = 120) -> DataFrame:
    """The detections with local_refine_decision and green_ratio; kept ones with their new place and radius.

    Each disc is looked at by itself: its pixels of the core hang together within it only, so discs that overlap keep
    apart. Too little core rejects it, as does no component that is large and near enough. The best component, by
    area and nearness, moves the centre to its enclosing circle's, and shrinks a radius that is far too large. Detections without
    a radius, or whose surroundings lie off the image, are in neither table.
    """
    own = ["image_id", "idx"]
    size = core.groupBy("image_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    pad = F.greatest(F.lit(8), F.bround(F.col("radius") * 1.25, 0).cast("int"))
    seen = found.where("radius > 0").join(size, "image_id").where((F.col("x") + pad >= 0) & (F.col("y") + pad >= 0) & (F.col("x") - pad < F.col("_w")) & (F.col("y") - pad < F.col("_h")))
    seen = stage(seen, "detections")
    discs = seen.select(*own, F.col("x").alias("cx"), F.col("y").alias("cy"), F.greatest(F.lit(3), "radius").alias("radius"))
    gate = stage(raster.in_discs(core, discs, CELL).select(*own, "x", "y", "mask", "cx", "cy", "radius"), "gate")
    share = gate.groupBy(*own).agg((F.count_if("mask") / F.count(F.lit(1))).alias("green"))
    judged = stage(seen.join(share.hint("merge"), own, "left").withColumn("green", F.coalesce("green", F.lit(0.0))), "judged")
    ok = judged.where(F.col("green") >= least_green).select(*own)
    lab = stage(raster.components(gate.join(ok.hint("merge"), own, "left_semi"), "mask", ("image_id", "idx")), "cores")
    away = F.sqrt(F.pow(F.avg("x") - F.first("cx"), 2) + F.pow(F.avg("y") - F.first("cy"), 2))
    stats = lab.groupBy(*own, "label").agg(F.count(F.lit(1)).alias("n"), away.alias("away"), F.first("radius").alias("radius"))
    stats = stats.where((F.col("n") >= least_px) & (F.col("away") <= F.greatest(F.lit(10.0), F.col("radius") * 0.90)))
    best = stage(stats.groupBy(*own).agg(F.max_by("label", F.struct(F.col("n") / (1.0 + F.col("away") * 0.18), -F.col("label"))).alias("label")), "best")
    by = ("image_id", "idx", "label")
    lab = lab.select(*by, "x", "y").join(best.hint("merge"), list(by), "left_semi")
    shaped = shape.contour_stats(lab, shape.contours(lab, by), by).select(*by, F.greatest(F.lit(1.0), "area").alias("_area")).join(shape.enclosing_circles(shape.hulls(lab, by), by).hint("merge"), list(by)).drop("label")
    out = judged.join(shaped.hint("merge"), own, "left")
    need = F.greatest(F.sqrt(F.col("_area") / math.pi) * 1.45, F.col("er") * 0.85, F.lit(5.0))
    radius = F.when(F.col("radius") > need * 1.35, F.bround(F.least("radius", need), 0).cast("int")).otherwise(F.col("radius"))
    kept = F.col("er").isNotNull()
    within = lambda c, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, F.bround(c, 0).cast("int")))
    decision = F.when(F.col("green") < least_green, "rejected_low_green_core").when(~kept, "rejected_no_green_component").otherwise("kept_refined")
    return out.withColumns({
        "local_refine_decision": decision, "green_ratio": F.bround("green", 4), "x": F.when(kept, within("ex", "_w")).otherwise(F.col("x")), "y": F.when(kept, within("ey", "_h")).otherwise(F.col("y")),
        "radius": F.when(kept, F.greatest(F.lit(5), F.least(F.lit(largest), radius))).otherwise(F.col("radius")),
    }).select(*found.columns, "local_refine_decision", "green_ratio")


def refine(pixels: DataFrame, found: DataFrame, threshold: float = 0.58) -> tuple[DataFrame, DataFrame]:
    """(verified with id by position, rejected): detections held against the crown cores of coloured pixels; of verified ones that are one crown the best stays."""
    judged = stage(core_decisions(core_mask(pixels), found), "judged")
    kept = judged.where("local_refine_decision = 'kept_refined'")
    return renumber(pooled(kept, threshold)), judged.where("local_refine_decision <> 'kept_refined'")


def _name() -> Column:
    """A detection's own name among images: what holds for an image then holds for each detection by itself."""
    return F.concat_ws(":", F.col("image_id").cast("string"), F.col("idx").cast("string"))


def _windows(planes: DataFrame, found: DataFrame, padding: float) -> DataFrame:
    """(image_id: name of the detection, x, y, the planes, dx, dy, reach): the square around each detection, cut to its image."""
    reach = F.greatest(F.lit(4), F.bround(F.col("radius") * padding, 0).cast("int"))
    around = found.select("image_id", "idx", F.col("x").alias("cx"), F.col("y").alias("cy"), reach.alias("reach"))
    square = raster.in_discs(planes, around.withColumn("radius", F.col("reach") * 1.4143), CELL).drop("radius")
    square = square.withColumns({"dx": F.col("x") - F.col("cx"), "dy": F.col("y") - F.col("cy")}).where((F.abs("dx") <= F.col("reach")) & (F.abs("dy") <= F.col("reach")))
    return square.withColumn("image_id", _name()).drop("idx", "cx", "cy")


def _closed_regions(squares: DataFrame, on: Column) -> DataFrame:
    """(image_id, label, x, y): regions of what holds within a detection's disc, closed by a kernel of 3 within its square."""
    p = stage(squares.select(*PIXEL, (on & (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= F.col("reach") * F.col("reach"))).alias("on")), "squares")
    some = p.where("on").select("image_id").distinct()
    return stage(raster.components(raster.closed(p.join(some.hint("merge"), "image_id", "left_semi"), "on", raster.ellipse(3)), "on").select("image_id", "label", "x", "y"), "local")


def with_contours(mask: DataFrame, found: DataFrame, least: float = 6.0) -> DataFrame:
    """The detections with contour: array<struct<x, y>> and contour_points, null where the mask (image_id, x, y, mask) shows no crown there.

    A detection takes the crown at its centre, or the most frequent one near it, within a slightly wider disc: the convex hull of the largest piece.
    Where that gives none, it takes what the mask shows within a wider disc: the piece that holds the centre, or else is large and near.
    Pieces whose contour's area is under `least` do not count. Contours are simplified (`shape.simplified`). Discs that overlap are looked at apart.
    """
    mask = stage(mask.select(*PIXEL, F.coalesce("mask", F.lit(False)).alias("mask")), "mask")
    found = stage(found.withColumn("_name", _name()), "detections")
    crown, _ = field.crowns(mask, "mask")
    own = stage(raster.label_near(found.select("image_id", "idx", "x", "y"), crown), "near").where("label is not null").select(_name().alias("image_id"), F.col("label").alias("own"))
    planes = stage(mask.join(crown.hint("merge"), PIXEL, "left"), "planes")
    lab = _closed_regions(_windows(planes, found, 1.08).join(own.hint("shuffle_hash"), "image_id"), F.col("mask") & (F.col("label") == F.col("own")))
    rings = stage(shape.contours(lab), "rings")
    best = shape.contour_stats(lab, rings).where(F.col("area") >= least).groupBy("image_id").agg(F.max_by("label", F.struct("area", -F.col("label"))).alias("label"))
    hull = shape.hulls(lab.join(best.hint("merge"), ["image_id", "label"], "left_semi")).select("image_id", "label", F.posexplode("hull").alias("k", "p"))
    hull = stage(hull.select("image_id", "label", F.col("k").cast("long").alias("seq"), "p.x", "p.y"), "hulls")

    rest = found.join(hull.select(F.col("image_id").alias("_name")).distinct().hint("merge"), "_name", "left_anti")
    lab = _closed_regions(_windows(planes, rest, 1.22), F.col("mask"))
    rings = stage(shape.contours(lab), "rings")
    centre = rest.select(F.col("_name").alias("image_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    edge = rings.join(centre.hint("merge"), "image_id")
    over = ((F.col("y") > F.col("py")) != (F.col("ny") > F.col("py"))) & (F.col("px") < (F.col("nx") - F.col("x")) * (F.col("py") - F.col("y")) / F.nullif(F.col("ny") - F.col("y"), F.lit(0)) + F.col("x"))
    holds = edge.groupBy("image_id", "label").agg(((F.count_if(over) % 2 == 1) | F.max((F.col("x") == F.col("px")) & (F.col("y") == F.col("py")))).alias("holds"))
    stats = shape.contour_stats(lab, rings).select("image_id", "label", "area", "cx", "cy").join(holds.hint("merge"), ["image_id", "label"]).join(centre.hint("merge"), "image_id")
    away = F.sqrt(F.pow(F.coalesce("cx", "px") - F.col("px"), 2) + F.pow(F.coalesce("cy", "py") - F.col("py"), 2))
    best = stats.groupBy("image_id").agg(F.max(F.struct("holds", (F.col("area") / (1.0 + away)).alias("score"), "area", (-F.col("label")).alias("first"))).alias("m"))
    best = best.where(F.col("m.area") >= least).select("image_id", (-F.col("m.first")).alias("label"))
    both = hull.unionByName(rings.join(best.hint("merge"), ["image_id", "label"], "left_semi").select("image_id", "label", "seq", "x", "y"))
    points = shape.simplified(stage(both, "contours")).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))  # as many as a simplified contour has at most
    points = points.where(F.size("p") >= 3).select(F.col("image_id").alias("_name"), F.transform("p", lambda q: F.struct(q["x"].cast("int").alias("x"), q["y"].cast("int").alias("y"))).alias("contour"))
    return found.join(points.hint("merge"), "_name", "left").drop("_name").withColumn("contour_points", F.when(F.col("contour").isNotNull(), F.size("contour")))


def red_circles(pixels: DataFrame, scale: tuple[float, float] = (1.0, 1.0), radii: tuple[int, int] = (8, 95), least_cover: float = 0.16, threshold: float = 0.62) -> DataFrame:
    """(image_id, id, x, y, radius, score, overlay_x, overlay_y, overlay_radius, source): circles drawn in red over coloured pixels, as labels of the image
    they were drawn on, which is `scale` times as wide and high.

    Circles are found by votes on the blurred red mask. Their score is the share of places on the ring and close to it that are red; circles with
    too little go, and of two that are the same the one with the better score, then the wider one, stays. Numbers go by position, before the scaling.
    """
    mask = _cleaned(pixels, raster.red_mask(), [("open", 3), ("close", 3)])
    soft = field.blurred(mask.select(*PIXEL, (F.col("mask").cast("int") * 255).alias("v")), "v", field.gaussian(1.5, 9)).withColumn("v", F.bround("v", 0))
    rings = stage(field.circles(soft, "v", radii, max(6, radii[0])).select("image_id", "idx", F.bround("cx", 0).cast("int").alias("cx"), F.bround("cy", 0).cast("int").alias("cy"), "radius"), "rings")
    cover = raster.ring_share(rings, mask, "mask")
    scored = rings.join(cover.hint("merge"), ["image_id", "idx"]).where(F.col("coverage") >= least_cover).select("image_id", "idx", F.col("cx").alias("x"), F.col("cy").alias("y"), "radius", F.bround("coverage", 4).alias("score"))
    kept = renumber(suppress(scored, [-F.col("score"), -F.col("radius"), F.col("idx")], conflicts.same_circle(4.0, 0.38, threshold), 64.0))
    old = kept.withColumns({"overlay_x": F.col("x"), "overlay_y": F.col("y"), "overlay_radius": F.col("radius"), "area_px": F.lit(0.0)})
    return candidates.rescale(old, *scale).drop("area_px", "idx").withColumn("source", F.lit("red_overlay"))
