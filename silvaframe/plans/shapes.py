"""Queries over the shapes of regions: contours, hulls, enclosing circles, holes."""

from __future__ import annotations

from pyspark.sql import functions as F

from silvaframe.operators import field, raster, shape
from silvaframe.plans.pixels import HSV, _kernel_sql, pixels
from silvaframe.plans.registry import query
from silvaframe.plans.scratch import stage
from silvaframe.sources.fixtures import view, with_views

def _morph(source: str, out: str, test: str, kernel) -> str:
    """One pass over a kernel's offsets: bool_and erodes, bool_or dilates; each pixel is told to the places that see it."""
    told = f"(SELECT image_id, x - dx AS x, y - dy AS y, m FROM {source}, {_kernel_sql(kernel)})"
    return f"{out} AS (SELECT a.image_id, a.x, a.y, {test}(b.m) AS m FROM {source} a JOIN {told} b USING (image_id, x, y) GROUP BY 1, 2, 3)"


#: 8-connected components: the first pixels of neighbourhoods spread their number to what comes behind them.
_REACH = """on_ AS (SELECT image_id, x, y, y::BIGINT * 1000000 + x AS id FROM px WHERE {mask}),
e AS (SELECT a.image_id, a.id AS u, b.id AS v FROM on_ a JOIN on_ b ON b.image_id = a.image_id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND a.id <> b.id),
reach AS (SELECT image_id, id, id AS label FROM on_ o WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.image_id = o.image_id AND e.u = o.id AND e.v < e.u) UNION SELECT e.image_id, e.v, r.label FROM reach r JOIN e ON e.image_id = r.image_id AND e.u = r.id AND e.v > r.label),
lab AS (SELECT o.*, r.label FROM on_ o JOIN (SELECT image_id, id, min(label) AS label FROM reach GROUP BY 1, 2) r ON r.image_id = o.image_id AND r.id = o.id)"""
_LAB = f"{HSV}, {_REACH.format(mask='bare')}"
#: The cracks of regions with their successors, followed one by one from the top side of each region's first pixel.
_CRACKS = """nb AS (SELECT a.image_id, a.label, a.x, a.y, bool_or(b.x = a.x AND b.y = a.y - 1) AS n, bool_or(b.x = a.x + 1 AND b.y = a.y) AS e, bool_or(b.x = a.x AND b.y = a.y + 1) AS s, bool_or(b.x = a.x - 1 AND b.y = a.y) AS w,
  bool_or(b.x = a.x + 1 AND b.y = a.y - 1) AS ne, bool_or(b.x = a.x + 1 AND b.y = a.y + 1) AS se, bool_or(b.x = a.x - 1 AND b.y = a.y + 1) AS sw, bool_or(b.x = a.x - 1 AND b.y = a.y - 1) AS nw
  FROM lab a JOIN lab b ON b.image_id = a.image_id AND b.label = a.label AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 GROUP BY 1, 2, 3, 4),
cr AS (SELECT image_id, label, x, y, 0 AS side, CASE WHEN ne THEN [x + 1, y - 1, 3] WHEN e THEN [x + 1, y, 0] ELSE [x, y, 1] END AS t FROM nb WHERE NOT n
  UNION ALL SELECT image_id, label, x, y, 1, CASE WHEN se THEN [x + 1, y + 1, 0] WHEN s THEN [x, y + 1, 1] ELSE [x, y, 2] END FROM nb WHERE NOT e
  UNION ALL SELECT image_id, label, x, y, 2, CASE WHEN sw THEN [x - 1, y + 1, 1] WHEN w THEN [x - 1, y, 2] ELSE [x, y, 3] END FROM nb WHERE NOT s
  UNION ALL SELECT image_id, label, x, y, 3, CASE WHEN nw THEN [x - 1, y - 1, 2] WHEN n THEN [x, y - 1, 3] ELSE [x, y, 0] END FROM nb WHERE NOT w),
follow AS (SELECT image_id, label, 0 AS n, x, y, side, t FROM cr WHERE label = y * 1000000 + x AND side = 0
  UNION ALL SELECT c.image_id, c.label, f.n + 1, c.x, c.y, c.side, c.t FROM follow f JOIN cr c ON c.image_id = f.image_id AND c.label = f.label AND c.x = f.t[1] AND c.y = f.t[2] AND c.side = f.t[3]
    WHERE NOT (c.label = c.y * 1000000 + c.x AND c.side = 0)),
ring AS (SELECT image_id, label, row_number() OVER (PARTITION BY image_id, label ORDER BY n) - 1 AS seq, x, y, t[1] AS nx, t[2] AS ny FROM follow WHERE x <> t[1] OR y <> t[2])"""


def regions(spark, d):
    return raster.components(pixels(spark, d), "bare").select("image_id", "label", "x", "y")


@query(with_views(f"WITH RECURSIVE {_LAB}, {_CRACKS} SELECT image_id, label, seq::BIGINT AS seq, x, y FROM ring", "pixels"))
def seg8_contours(spark, d):
    """The outer contour of each region of bare soil, pixel by pixel in order."""
    return shape.contours(regions(spark, d)).select("image_id", "label", "seq", "x", "y")


@query(
    with_views(
        f"""WITH RECURSIVE {_LAB}, {_CRACKS}, q AS (SELECT image_id, label, sum(x * ny - nx * y) AS a, sum((x + nx) * (x * ny - nx * y)) AS mx, sum((y + ny) * (x * ny - nx * y)) AS my, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS p FROM ring GROUP BY 1, 2),
    b AS (SELECT image_id, label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM lab GROUP BY 1, 2)
    SELECT image_id, label, coalesce(abs(a) / 2.0::DOUBLE, 0) AS area, round(coalesce(p, 0), 6) AS perimeter, x, y, w, h, round(mx / (3.0::DOUBLE * nullif(a, 0)), 6) AS cx, round(my / (3.0::DOUBLE * nullif(a, 0)), 6) AS cy FROM b LEFT JOIN q USING (image_id, label)""",
        "pixels",
    )
)
def seg8_contour_stats(spark, d):
    """Area, length, bounding box and centroid of each contour."""
    lab = regions(spark, d)
    return shape.contour_stats(lab, shape.contours(lab)).withColumns({c: F.round(c, 6) for c in ("perimeter", "cx", "cy")})


#: Corners of the hull: pixels that no triangle or stretch of other pixels of their region holds, seen as ends of supporting lines.
_HULL = """ends AS (SELECT DISTINCT image_id, label, x, y FROM (SELECT image_id, label, y, min(x) AS x FROM lab GROUP BY 1, 2, 3 UNION ALL SELECT image_id, label, y, max(x) AS x FROM lab GROUP BY 1, 2, 3)),
sup AS (SELECT a.image_id, a.label, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM ends a JOIN ends b ON a.image_id = b.image_id AND a.label = b.label AND (a.x, a.y) <> (b.x, b.y)
  JOIN ends c ON c.image_id = a.image_id AND c.label = a.label GROUP BY 1, 2, 3, 4, 5, 6
  HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) <= 0))),
corner AS (SELECT image_id, label, ax AS x, ay AS y FROM sup UNION SELECT image_id, label, min(x), min(y) FROM ends GROUP BY 1, 2 HAVING count(*) = 1)"""


@query(with_views(f"WITH RECURSIVE {_LAB}, {_HULL} SELECT image_id, label, x, y FROM corner", "pixels"))
def seg12_hulls(spark, d):
    """Corners of the convex hull of each region."""
    return shape.hulls(regions(spark, d)).select("image_id", "label", F.inline("hull"))


#: All circles through two or three corners, and those of them that hold all corners.
_CIRCLES = """two AS (SELECT a.image_id, a.label, (a.x + b.x) / 2.0::DOUBLE AS cx, (a.y + b.y) / 2.0::DOUBLE AS cy, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 4.0::DOUBLE AS r2 FROM corner a JOIN corner b ON a.image_id = b.image_id AND a.label = b.label AND (a.x, a.y) <= (b.x, b.y)),
    tri AS (SELECT a.image_id, a.label, a.x, a.y, (b.x - a.x)::DOUBLE AS ux, (b.y - a.y)::DOUBLE AS uy, (c.x - a.x)::DOUBLE AS vx, (c.y - a.y)::DOUBLE AS vy FROM corner a JOIN corner b ON a.image_id = b.image_id AND a.label = b.label AND (a.x, a.y) < (b.x, b.y) JOIN corner c ON a.image_id = c.image_id AND a.label = c.label AND (b.x, b.y) < (c.x, c.y)),
    off AS (SELECT image_id, label, x, y, (vy * (ux * ux + uy * uy) - uy * (vx * vx + vy * vy)) / (2 * (ux * vy - uy * vx)) AS ox, (ux * (vx * vx + vy * vy) - vx * (ux * ux + uy * uy)) / (2 * (ux * vy - uy * vx)) AS oy FROM tri WHERE ux * vy <> uy * vx),
    cand AS (SELECT image_id, label, cx, cy, r2 FROM two UNION ALL SELECT image_id, label, x + ox, y + oy, ox * ox + oy * oy FROM off),
    fits AS (SELECT q.image_id, q.label, q.cx, q.cy, q.r2 FROM cand q JOIN corner p ON p.image_id = q.image_id AND p.label = q.label GROUP BY 1, 2, 3, 4, 5 HAVING max((p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy)) <= r2 + 1e-9 * (1 + r2))"""


@query(
    with_views(
        f"""WITH RECURSIVE {_LAB}, {_HULL},
    {_CIRCLES}
    SELECT image_id, label, round(arg_min(cx, r2), 5) AS ex, round(arg_min(cy, r2), 5) AS ey, round(sqrt(min(r2)), 6) AS er FROM fits GROUP BY image_id, label""",
        "pixels",
    )
)
def seg9_enclosing_circles(spark, d):
    """The smallest circle around each region."""
    found = shape.enclosing_circles(shape.hulls(regions(spark, d)))
    return found.select("image_id", "label", F.round("ex", 5).alias("ex"), F.round("ey", 5).alias("ey"), F.round("er", 6).alias("er"))


_D2 = "d2 AS (SELECT a.image_id, a.x, a.y, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM {px} a JOIN {px} b ON b.image_id = a.image_id AND NOT b.{mask} GROUP BY 1, 2, 3)"


@query(with_views(f"WITH {HSV}, {_D2.format(px='px', mask='tree')} SELECT image_id, x, y, d2::BIGINT AS d2 FROM d2 WHERE d2 > 0", "pixels"))
def seg3_distance(spark, d):
    """The squared distance of each tree pixel to the nearest other one."""
    return field.distance_squared(pixels(spark, d), "tree").where("d2 > 0")


#: The blur of 17 taps, its weights written out: exp(-k² / 8) for k from -8 to 8, over their sum.
_TAPS = "taps AS (SELECT k, exp(-k * k / 8.0::DOUBLE) / sum(exp(-k * k / 8.0::DOUBLE)) OVER () AS w FROM range(-8, 9) t(k))"
_MIRROR = "CASE WHEN {at} < 0 THEN -({at}) WHEN {at} > {last} THEN {twice} - ({at}) ELSE {at} END"
_FIELD = ", ".join(
    [
        _D2,
        _TAPS,
        f"b1 AS (SELECT a.image_id, a.x, a.y, sum(w * sqrt(b.d2)) AS v FROM d2 a, taps, d2 b WHERE b.image_id = a.image_id AND b.y = a.y AND b.x = {_MIRROR.format(at='a.x + k', last='{right}', twice='2 * {right}')} GROUP BY 1, 2, 3)",
        f"dist AS (SELECT a.image_id, a.x, a.y, round(sum(w * b.v), 4) AS distance FROM b1 a, taps, b1 b WHERE b.image_id = a.image_id AND b.x = a.x AND b.y = {_MIRROR.format(at='a.y + k', last='{bottom}', twice='2 * {bottom}')} GROUP BY 1, 2, 3)",
    ]
)


@query(with_views(f"WITH {HSV}, {_FIELD.format(px='px', mask='tree', right=39, bottom=24)} SELECT image_id, x, y, distance FROM dist", "pixels"))
def seg2_blurred_distance(spark, d):
    """The distance field, blurred."""
    return field.distance(pixels(spark, d), "tree")


#: A kernel of 13 rows as an ellipse cuts them, and the cross of 3: half widths by row, written out.
_HALF13 = [0, 3, 4, 5, 6, 6, 6, 6, 6, 5, 4, 3, 0]
_PEAKS = ", ".join(
    [
        f"kern AS (SELECT i - 6 AS dy, unnest(range(-h, h + 1)) AS dx FROM (SELECT unnest(range(0, 13)) AS i, unnest({_HALF13}) AS h))",
        "low AS (SELECT image_id, x, y, greatest(distance - 1.5::DOUBLE, 0) AS height FROM dist)",
        "peak AS (SELECT a.image_id, a.x, a.y FROM low a JOIN (SELECT image_id, x - dx AS x, y - dy AS y, height FROM low, kern) b USING (image_id, x, y) WHERE a.height >= 2 GROUP BY a.image_id, a.x, a.y, a.height HAVING max(b.height) = a.height)",
        "cross3 AS (SELECT DISTINCT p.image_id, p.x + dx AS x, p.y + dy AS y FROM peak p, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) c(dx, dy) WHERE p.x + dx BETWEEN 0 AND 79 AND p.y + dy BETWEEN 0 AND 49)",
        _REACH.format(mask="true").replace("FROM px WHERE true", "FROM cross3"),
    ]
)
_CANOPY = HSV.replace("FROM pixels)", "FROM canopy)")
#: The tree mask opened and closed by a cross of 3.
_CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
_CLEAN = ", ".join(["m0 AS (SELECT image_id, x, y, tree AS m FROM px)", *[_morph(f"m{k}", f"m{k + 1}", test, _CROSS) for k, test in enumerate(("bool_and", "bool_or", "bool_or", "bool_and"))]])


def canopy(spark, d):
    """Pixels of crowns that grow into each other, with the mask tree, opened and closed."""
    p = raster.colour(view(spark, d, "canopy")).select("image_id", "x", "y", raster.tree_mask().alias("tree"))
    return raster.closed(raster.opened(p, "tree", raster.ellipse(3)), "tree", raster.ellipse(3))


@query(with_views(f"WITH RECURSIVE {_CANOPY}, {_CLEAN}, {_FIELD.format(px='m4', mask='m', right=79, bottom=49)}, {_PEAKS} SELECT image_id, x, y, label AS marker FROM lab", "canopy"))
def seg4_markers(spark, d):
    """Peaks of the distance field of trees."""
    on = stage(canopy(spark, d), "mask")
    return field.markers(field.distance(on, "tree"), on.where("tree"), 13, 2)


@query()
def seg4_watershed(spark, d):
    """Tree pixels by the peak of the distance field that water reaches them from. SQL has no flood: tests hold it against one pixel after another."""
    return field.crowns(canopy(spark, d), "tree")[0]


_RINGS = "rings AS (SELECT image_id, x, y, NOT ((greatest(abs(x % 20 - 10), abs(y - 12)) % 3 <> 0) OR (x + y * 3 + image_id) % 17 = 0) AS m FROM px)"
_HOLES = """off_ AS (SELECT image_id, x, y, y::BIGINT * 1000000 + x AS id FROM rings WHERE NOT m),
oe AS (SELECT a.image_id, a.id AS u, b.id AS v FROM off_ a JOIN off_ b ON b.image_id = a.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
open_ AS (SELECT image_id, id FROM off_ WHERE x IN (0, 39) OR y IN (0, 24) UNION SELECT oe.image_id, oe.v FROM open_ o JOIN oe ON oe.image_id = o.image_id AND oe.u = o.id),
hole AS (SELECT o.image_id, o.x, o.y FROM off_ o WHERE NOT EXISTS (SELECT 1 FROM open_ p WHERE p.image_id = o.image_id AND p.id = o.id)),
whole AS (SELECT image_id, x, y FROM rings WHERE m UNION ALL SELECT image_id, x, y FROM hole)"""


def rings(spark, d):
    """Squares inside squares, with gaps here and there."""
    return pixels(spark, d).select("image_id", "x", "y", F.expr("not ((greatest(abs(x % 20 - 10), abs(y - 12)) % 3 <> 0) or (x + y * 3 + image_id) % 17 = 0)").alias("m"))


@query(with_views(f"WITH RECURSIVE {HSV}, {_RINGS}, {_HOLES} SELECT image_id, x, y FROM hole", "pixels"))
def seg6_holes(spark, d):
    """Pixels that nested rings shut in."""
    return field.holes(rings(spark, d), "m").select("image_id", "x", "y")


@query(with_views(f"WITH RECURSIVE {HSV}, {_RINGS}, {_HOLES}, {_REACH.format(mask='true').replace('FROM px WHERE true', 'FROM whole')} SELECT image_id, x, y, label FROM lab", "pixels"))
def seg6_filled_regions(spark, d):
    """Regions of nested rings with all that they shut in."""
    return field.filled_regions(rings(spark, d), "m")


#: Sobel's gradients with the border repeated, their amounts beside and across, and which pixels are highest across their edge.
_CANNY = """g8 AS (SELECT a.image_id, a.x, a.y, sum(b.gray * dx * (2 - abs(dy))) AS gx, sum(b.gray * dy * (2 - abs(dx))) AS gy FROM px a, range(-1, 2) i(dx), range(-1, 2) j(dy), px b
  WHERE b.image_id = a.image_id AND b.x = greatest(0, least(39, a.x + dx)) AND b.y = greatest(0, least(24, a.y + dy)) GROUP BY 1, 2, 3),
mg AS (SELECT *, abs(gx) + abs(gy) AS m FROM g8),
nb8 AS (SELECT a.image_id, a.x, a.y, any_value(a.gx) AS gx, any_value(a.gy) AS gy, any_value(a.m) AS m, sum(b.m) FILTER (b.x = a.x - 1 AND b.y = a.y) AS w, sum(b.m) FILTER (b.x = a.x + 1 AND b.y = a.y) AS e, sum(b.m) FILTER (b.x = a.x AND b.y = a.y - 1) AS n, sum(b.m) FILTER (b.x = a.x AND b.y = a.y + 1) AS s,
  sum(b.m) FILTER (b.x = a.x - 1 AND b.y = a.y - 1) AS nw, sum(b.m) FILTER (b.x = a.x + 1 AND b.y = a.y - 1) AS ne, sum(b.m) FILTER (b.x = a.x - 1 AND b.y = a.y + 1) AS sw, sum(b.m) FILTER (b.x = a.x + 1 AND b.y = a.y + 1) AS se
  FROM mg a JOIN mg b ON b.image_id = a.image_id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY 1, 2, 3),
thin AS (SELECT image_id, x, y, m, CASE WHEN abs(gy) * 32768 < abs(gx) * 13573 THEN m > coalesce(w, 0) AND m >= coalesce(e, 0) WHEN abs(gy) * 32768 > abs(gx) * 79109 THEN m > coalesce(n, 0) AND m >= coalesce(s, 0)
  WHEN (gx < 0) = (gy < 0) THEN m > coalesce(nw, 0) AND m > coalesce(se, 0) ELSE m > coalesce(ne, 0) AND m > coalesce(sw, 0) END AND m > 70 AS weak FROM nb8)"""


@query(with_views(f"WITH RECURSIVE {HSV}, {_CANNY}, {_REACH.format(mask='weak').replace('FROM px WHERE', 'FROM thin WHERE')} SELECT l.image_id, l.x, l.y FROM lab l JOIN (SELECT DISTINCT l.image_id, l.label FROM lab l JOIN thin t ON t.image_id = l.image_id AND t.x = l.x AND t.y = l.y WHERE t.m > 150) s ON s.image_id = l.image_id AND s.label = l.label", "pixels"))
def px15_edges(spark, d):
    """Edges of the grey plane, weak ones where they hang together with strong ones."""
    return field.edges(pixels(spark, d)).where("edge").select("image_id", "x", "y")


@query()
def seg11_simplified(spark, d):
    """The corners of each region's contour. SQL would have to split stretches in turn: tests hold it against the recursive rule."""
    return shape.simplified(shape.contours(regions(spark, d)))
