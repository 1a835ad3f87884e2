"""Queries over detectors: crowns found in pixels, and detections refined by crown cores."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from silvaframe.functions import rules
from silvaframe.operators import detector, field, raster
from silvaframe.plans.detect import _POOL, greedy_sql
from silvaframe.plans.registry import query
from silvaframe.plans.shapes import _CANOPY, _CIRCLES, _CRACKS, _CROSS, _HOLES, _HULL, _morph, _REACH
from silvaframe.sources.fixtures import view, with_views

#: Detections to be refined: a disc for each square of 13 pixels, at home nowhere in particular.
_FOUND = """SELECT image_id, CAST(max(y * 80 + x) AS BIGINT) AS idx, CAST(max(x) - 6 AS INT) AS x, CAST(max(y) - 5 AS INT) AS y, CAST(4 + (max(x) + 3 * max(y) + image_id) % 14 AS INT) AS radius,
  CAST(50 + (max(x) * 7 + max(y) * 3) % 300 AS DOUBLE) AS area_px, CAST((max(x) * 13 + max(y)) % 100 AS DOUBLE) / 100 AS circularity, CAST((max(x) + max(y) * 29) % 100 AS DOUBLE) / 100 AS fill_ratio,
  CASE (max(x) + max(y)) % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'recall' ELSE 'peak' END AS source
FROM canopy GROUP BY image_id, floor(x / 13), floor(y / 13)"""

_CORE = ", ".join(
    [
        "taps3 AS (SELECT dx, dy, (CASE WHEN dx = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END) * (CASE WHEN dy = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END) AS w FROM range(-1, 2) a(dx), range(-1, 2) b(dy))",
        """tex AS (SELECT a.image_id, a.x, a.y, sum(w * b.gray) AS g, sum(w * b.gray * b.gray) AS g2 FROM px a, taps3, px b WHERE b.image_id = a.image_id
  AND b.x = (CASE WHEN a.x + dx < 0 THEN -(a.x + dx) WHEN a.x + dx > 79 THEN 158 - a.x - dx ELSE a.x + dx END) AND b.y = (CASE WHEN a.y + dy < 0 THEN -(a.y + dy) WHEN a.y + dy > 49 THEN 98 - a.y - dy ELSE a.y + dy END) GROUP BY 1, 2, 3)""",
        """m0 AS (SELECT image_id, x, y, ((h BETWEEN 26 AND 110 AND s >= 48 AND v >= 52 AND exg >= 10 AND px.g >= r + 6) OR (h BETWEEN 26 AND 110 AND s >= 40 AND v BETWEEN 38 AND 75 AND exg >= 6 AND px.g >= r))
  AND NOT (s < 22 AND v > 68) AND NOT (v < 30 AND exg < 6) AND greatest(g2 - tex.g * tex.g, 0) > 30 AS m FROM px JOIN tex USING (image_id, x, y))""",
        *[_morph(f"m{k}", f"m{k + 1}", test, _CROSS) for k, test in enumerate(("bool_and", "bool_or", "bool_or", "bool_and"))],
    ]
)
#: Each disc's pixels of the core, under a number of image and disc, so that what holds for images holds for discs.
_DECIDED = ", ".join(
    [
        f"found AS ({_FOUND})",
        "gate AS (SELECT f.image_id * 100000 + f.idx AS image_id, p.x, p.y, p.m, f.x AS cx, f.y AS cy, f.radius FROM found f JOIN m4 p ON p.image_id = f.image_id AND (p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y) <= greatest(3, f.radius) * greatest(3, f.radius))",
        "green AS (SELECT image_id, count(*) FILTER (m) / count(*)::DOUBLE AS green FROM gate GROUP BY image_id)",
        "gated AS (SELECT g.* FROM gate g JOIN green q ON q.image_id = g.image_id AND q.green >= 0.28::DOUBLE WHERE g.m)",
        _REACH.format(mask="true").replace("FROM px WHERE true", "FROM gated").replace("lab AS (", "lab0 AS ("),
        "core AS (SELECT l.image_id, l.label, count(*) AS n, sqrt(pow(avg(l.x) - any_value(g.cx), 2) + pow(avg(l.y) - any_value(g.cy), 2)) AS away, greatest(3, any_value(g.radius)) AS radius FROM lab0 l JOIN gated g ON g.image_id = l.image_id AND g.x = l.x AND g.y = l.y GROUP BY 1, 2)",
        "best AS (SELECT image_id, max_by(label, {'s': n / (1 + away * 0.18::DOUBLE), 'l': -label}) AS label FROM core WHERE n >= 30 AND away <= greatest(10, radius * 0.9::DOUBLE) GROUP BY 1)",
        "lab AS (SELECT l.* FROM lab0 l JOIN best b ON b.image_id = l.image_id AND b.label = l.label)",
        _CRACKS,
        _HULL,
        _CIRCLES,
        "enc AS (SELECT image_id, arg_min(cx, r2) AS ex, arg_min(cy, r2) AS ey, sqrt(min(r2)) AS er FROM fits GROUP BY image_id)",
        "area AS (SELECT e.image_id, greatest(1, coalesce(abs(sum(x * ny - nx * y)) / 2.0::DOUBLE, 0)) AS area FROM enc e LEFT JOIN ring r ON r.image_id = e.image_id GROUP BY 1)",
        "need AS (SELECT image_id, ex, ey, greatest(sqrt(area / pi()) * 1.45::DOUBLE, er * 0.85::DOUBLE, 5) AS need FROM enc JOIN area USING (image_id))",
        """decided AS (SELECT f.* EXCLUDE (x, y, radius), round_even(coalesce(q.green, 0), 4) AS green_ratio, CASE WHEN coalesce(q.green, 0) < 0.28::DOUBLE THEN 'rejected_low_green_core' WHEN n.need IS NULL THEN 'rejected_no_green_component' ELSE 'kept_refined' END AS decision,
  CASE WHEN n.need IS NULL THEN f.x ELSE greatest(0, least(79, round_even(ex, 0)))::INT END AS x, CASE WHEN n.need IS NULL THEN f.y ELSE greatest(0, least(49, round_even(ey, 0)))::INT END AS y,
  CASE WHEN n.need IS NULL THEN f.radius ELSE greatest(5, least(120, CASE WHEN f.radius > need * 1.35::DOUBLE THEN round_even(least(f.radius, need), 0)::INT ELSE f.radius END))::INT END AS radius
  FROM found f LEFT JOIN green q ON q.image_id = f.image_id * 100000 + f.idx LEFT JOIN need n ON n.image_id = f.image_id * 100000 + f.idx)""",
    ]
)


def coloured(spark, d):
    return raster.colour(view(spark, d, "canopy"))


def found(spark, d):
    return spark.sql(_FOUND.replace("FROM canopy", "FROM {c}"), c=view(spark, d, "canopy"))


@query(with_views(f"WITH RECURSIVE {_CANOPY}, {_CORE}, {_DECIDED} SELECT image_id, idx, x, y, radius, green_ratio, decision AS local_refine_decision FROM decided", "canopy"))
def r1_core_decisions(spark, d):
    """What becomes of each detection when it is held against the core of crowns."""
    judged = detector.core_decisions(detector.core_mask(coloured(spark, d)), found(spark, d))
    return judged.select("image_id", "idx", "x", "y", "radius", "green_ratio", "local_refine_decision")


_QUALITY = rules.QUALITY_SQL.replace("+ 0.0::DOUBLE +", "+ green_ratio * 16.0::DOUBLE +")
_REFINED = greedy_sql(
    "quality DESC, idx",
    _POOL.format(t="0.58::DOUBLE"),
    f"SELECT *, {_QUALITY} AS quality FROM decided WHERE decision = 'kept_refined'",
    "SELECT k.image_id, row_number() OVER (PARTITION BY k.image_id ORDER BY y, x, quality DESC, k.idx) AS id, x, y, radius, source, green_ratio FROM kept k JOIN base b ON b.image_id = k.image_id AND b.idx = k.idx",
)


@query(with_views("WITH RECURSIVE " + ", ".join([_CANOPY, _CORE, _DECIDED]) + ", " + _REFINED[_REFINED.index("base AS (") :], "canopy"))
def r1_refined(spark, d):
    """Detections verified by the core of crowns, one of each crown, numbered."""
    kept, _ = detector.refine(coloured(spark, d), found(spark, d))
    return kept.select("image_id", "id", "x", "y", "radius", "source", "green_ratio")


_HALF7 = [0, 2, 3, 3, 3, 2, 0]
_DISC7 = [(dx, dy - 3) for dy, half in enumerate(_HALF7) for dx in range(-half, half + 1)]
#: The filled regions of the mask in table {m}, measured: area and length of the contour, smallest enclosing circle, centroid.
_MEASURED = ", ".join(
    [
        "rings AS (SELECT image_id, x, y, m FROM {m})",
        _HOLES.replace("x IN (0, 39) OR y IN (0, 24)", "x IN (0, 79) OR y IN (0, 49)"),
        _REACH.format(mask="true").replace("FROM px WHERE true", "FROM whole"),
        _CRACKS,
        _HULL,
        _CIRCLES,
        "enc AS (SELECT image_id, label, arg_min(cx, r2) AS ex, arg_min(cy, r2) AS ey, sqrt(min(r2)) AS er FROM fits GROUP BY 1, 2)",
        "sums AS (SELECT image_id, label, sum(x * ny - nx * y) AS a, sum((x + nx) * (x * ny - nx * y)) AS mx, sum((y + ny) * (x * ny - nx * y)) AS my, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS p FROM ring GROUP BY 1, 2)",
        "box AS (SELECT image_id, label, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh FROM lab GROUP BY 1, 2)",
        "shapes AS (SELECT s.*, abs(a) / 2.0::DOUBLE AS area, 4 * pi() * (abs(a) / 2.0::DOUBLE) / (p * p) AS circ, abs(a) / 2.0::DOUBLE / (pi() * er * er) AS fill, ex, ey, er, bw, bh FROM sums s JOIN enc USING (image_id, label) JOIN box USING (image_id, label))",
    ]
)


@query(
    with_views(
        "WITH RECURSIVE "
        + ", ".join(
            [
                _CANOPY,
                """osp AS (SELECT image_id, min(exg) AS lo, max(exg) AS hi FROM px GROUP BY image_id),
    lv AS (SELECT px.*, CASE WHEN hi > lo THEN round_even(255.0::DOUBLE * (exg - lo) / (hi - lo), 0)::INT ELSE 0 END AS level FROM px JOIN osp USING (image_id)),
    bins AS (SELECT image_id, level, count(*)::DOUBLE AS n FROM lv GROUP BY 1, 2),
    ot AS (SELECT a.image_id, a.level, sum(b.n) FILTER (b.level <= a.level) AS w, sum(b.n * b.level) FILTER (b.level <= a.level) AS m, sum(b.n) AS ww, sum(b.n * b.level) AS mm FROM bins a JOIN bins b ON b.image_id = a.image_id GROUP BY 1, 2),
    thr AS (SELECT image_id, max_by(level, {'s': round(CASE WHEN ww > w THEN w * (ww - w) * pow(m / w - (mm - m) / (ww - w), 2) ELSE 0 END, 3), 'l': -level}) AS threshold FROM ot GROUP BY image_id),
    m0 AS (SELECT image_id, x, y, h BETWEEN 30 AND 100 AND s >= 35 AND v >= 45 AND level > threshold AS m FROM lv JOIN thr USING (image_id))""",
                *[_morph(f"m{k}", f"m{k + 1}", test, kernel) for k, (test, kernel) in enumerate([("bool_and", _CROSS), ("bool_or", _CROSS), ("bool_or", _DISC7), ("bool_and", _DISC7), ("bool_or", _DISC7), ("bool_and", _DISC7)])],
                _MEASURED.format(m="m6"),
            ]
        )
        + """ SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY trunc(ey), trunc(ex), label)::INT AS id, trunc(ex)::INT AS x, trunc(ey)::INT AS y, trunc(er)::INT AS radius, round_even(area, 2) AS area_px, round_even(circ, 3) AS circularity
    FROM shapes WHERE area BETWEEN 20 AND 9000 AND circ >= 0.08::DOUBLE AND trunc(er) >= 4 AND trunc(er) <= 0.5::DOUBLE * 50 AND area <= 0.5::DOUBLE * 4000""",
        "canopy",
    )
)
def gen3_original_detector(spark, d):
    """The first detector from pixels to numbered rows, its limits scaled to the small images."""
    found, _ = detector.original(coloured(spark, d), area=(20, 9000), widest_share=0.5, largest_share=0.5)
    return found.select("image_id", "id", "x", "y", "radius", "area_px", "circularity")


@query(
    with_views(
        "WITH RECURSIVE "
        + ", ".join([_CANOPY, "m0 AS (SELECT image_id, x, y, h BETWEEN 28 AND 105 AND s >= 38 AND v >= 42 AND exg >= 18 AS m FROM px)", *[_morph(f"m{k}", f"m{k + 1}", test, _CROSS) for k, test in enumerate(("bool_and", "bool_or", "bool_or", "bool_and"))], _MEASURED.format(m="m4")])
        + """ SELECT image_id, label AS idx, round_even(coalesce(mx / (3.0::DOUBLE * nullif(a, 0)), ex), 0)::INT AS x, round_even(coalesce(my / (3.0::DOUBLE * nullif(a, 0)), ey), 0)::INT AS y, round_even(1.15::DOUBLE * er, 0)::INT AS radius, round_even(area, 2) AS area_px, round_even(circ, 3) AS circularity, round_even(fill, 3) AS fill_ratio
    FROM shapes WHERE area BETWEEN 60 AND 6000 AND p > 0 AND circ >= 0.15::DOUBLE AND fill >= 0.30::DOUBLE AND greatest(bw, bh) / greatest(1, least(bw, bh))::DOUBLE <= 2.8::DOUBLE AND round_even(1.15::DOUBLE * er, 0) BETWEEN 8 AND 56""",
        "canopy",
    )
)
def gen9_regions(spark, d):
    """Filled regions of the tree mask that are shaped like crowns, with the radius of the enclosing circle, scaled."""
    mask = detector.tree_mask(coloured(spark, d), 38, 42, 18)
    rule = replace(detector.PRESETS["balanced"].rule, area=(60, 6000))
    found = detector.detections(field.filled_regions(mask, "mask"), None, rule, "opencv")
    return found.select("image_id", "idx", "x", "y", "radius", "area_px", "circularity", "fill_ratio")


_ROW = ["image_id", "id", "x", "y", "radius", "area_px", "circularity", "fill_ratio", "peak_radius", "source"]


@query()
def gen10_reference_detector(spark, d):
    """Crowns split at the peaks of the distance field, from pixels to numbered rows. SQL has no flood: tests hold it against plain Python."""
    return detector.detect(view(spark, d, "canopy"), "reference")[0].select(*_ROW)


@query()
def gen11_ensemble_detector(spark, d):
    """Strict and loose settings, what they leave over, and peaks, in one pool."""
    return detector.detect(view(spark, d, "canopy"), "ensemble")[0].select(*_ROW)


@query()
def gen12_precision_detector(spark, d):
    """The detector of the vote of three with Lab's planes, by its name."""
    return detector.detect(view(spark, d, "canopy"), "precision")[0].select("image_id", "id", "x", "y", "radius", "area_px", "circularity", "fill_ratio")


@query()
def seg19_attached_contours(spark, d):
    """Detections with the contour of the crown that they stand on."""
    out = detector.with_contours(detector.tree_mask(coloured(spark, d)), found(spark, d).select("image_id", "idx", "x", "y", "radius"))
    return out.select("image_id", "idx", "contour_points", F.to_json("contour").alias("contour"))


def ringed(spark, d):
    """Crowns with a red circle drawn in each quarter of an image, of a radius that follows from the image."""
    off = F.sqrt(F.pow(F.expr("x - (int(x div 40) * 40 + 20)"), 2) + F.pow(F.expr("y - (int(y div 25) * 25 + 12)"), 2)) - (8 + F.col("image_id") % 3)
    red = F.abs(off) <= 1.2
    return view(spark, d, "canopy").select("image_id", "x", "y", *[F.when(red, v).otherwise(F.col(c)).alias(c) for c, v in (("b", 30), ("g", 35), ("r", 220))])


@query()
def gen13_red_circles(spark, d):
    """Circles drawn in red, read back as labels of an image twice the size. SQL has no votes of gradients to offer: tests look for the circles drawn."""
    return detector.red_circles(raster.colour(ringed(spark, d)), scale=(2.0, 2.0), least_cover=0.25)
