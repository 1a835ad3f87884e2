"""Queries over pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from silvaframe.functions import rules
from silvaframe.operators import raster
from silvaframe.plans.registry import query
from silvaframe.sources.fixtures import view, with_views

HSV = """turned AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS delta, 2 * g - r - b AS exg, round_even(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r, 0)::INT AS gray,
  CASE WHEN greatest(b, g, r) = least(b, g, r) THEN 0.0::DOUBLE WHEN greatest(b, g, r) = r THEN 60.0::DOUBLE * (g - b) / (greatest(b, g, r) - least(b, g, r))
    WHEN greatest(b, g, r) = g THEN 120.0::DOUBLE + 60.0::DOUBLE * (b - r) / (greatest(b, g, r) - least(b, g, r)) ELSE 240.0::DOUBLE + 60.0::DOUBLE * (r - g) / (greatest(b, g, r) - least(b, g, r)) END AS turn FROM pixels),
hsv AS (SELECT *, round_even((CASE WHEN turn < 0 THEN turn + 360.0::DOUBLE ELSE turn END) / 2.0::DOUBLE, 0)::INT % 180 AS h, CASE WHEN v = 0 THEN 0 ELSE round_even(255.0::DOUBLE * delta / v, 0)::INT END AS s FROM turned),
flags AS (SELECT *, h BETWEEN 25 AND 115 AND s >= 28 AND v >= 35 AND exg >= -2 AND g >= r - 8 AS veg, h BETWEEN 8 AND 36 AND s <= 115 AND v >= 65 AND exg < 22 AS soil FROM hsv),
px AS (SELECT *, NOT veg AND v >= 70 AND s <= 95 AND exg < 12 AS bare,
  ((s <= 48 AND v >= 172 AND delta <= 58) OR (h BETWEEN 88 AND 135 AND s >= 55 AND v >= 82) OR ((h <= 8 OR h >= 170) AND s >= 75 AND v >= 90)) AND NOT veg AND NOT soil AS anomaly,
  (((h <= 16 OR h >= 172) AND s >= 115 AND v >= 165 AND r > g + 38 AND r > b + 55) OR (h BETWEEN 8 AND 28 AND s >= 130 AND v >= 180 AND r > g + 22 AND r > b + 70)) AND NOT veg AND NOT soil AS fire,
  s <= 45 AND v BETWEEN 105 AND 218 AND delta <= 32 AS smoke, h BETWEEN 28 AND 105 AND s >= 25 AND v >= 40 AND exg >= 10 AS tree, (h BETWEEN 0 AND 12 OR h BETWEEN 168 AND 179) AND s >= 70 AND v >= 60 AS red,
  ((v < 100 AND v > 24 AND s > 32 AND h BETWEEN 25 AND 115) OR (v < 78 AND s > 22 AND exg > -5 AND g >= r - 6)) AND NOT (s < 26 AND v > 68) AS dark FROM flags)"""


def pixels(spark, d):
    p = raster.colour(view(spark, d, "pixels"))
    return p.withColumns({"vegetation": raster.vegetation(), "bare": raster.bare_soil(), "tree": raster.tree_mask()})


@query(with_views(f"WITH {HSV} SELECT image_id, sum(h)::BIGINT AS h, sum(s)::BIGINT AS s, sum(v)::BIGINT AS v, sum(gray)::BIGINT AS gray, sum(exg)::BIGINT AS exg FROM px GROUP BY image_id", "pixels"))
def px1_colour(spark, d):
    return pixels(spark, d).groupBy("image_id").agg(*[F.sum(c).alias(c) for c in ("h", "s", "v", "gray", "exg")])


@query(with_views(f"WITH {HSV} SELECT image_id, " + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in ("veg", "bare", "soil", "anomaly", "fire", "smoke", "tree", "red", "dark")) + " FROM px GROUP BY image_id", "pixels"))
def px_masks(spark, d):
    masks = {"veg": raster.vegetation(), "bare": raster.bare_soil(), "soil": raster.soil_like(), "anomaly": raster.colour_anomaly(), "fire": raster.fire_core(), "smoke": raster.smoke_like(), "tree": raster.tree_mask(), "red": raster.red_mask(), "dark": raster.dark_crown()}
    return pixels(spark, d).groupBy("image_id").agg(*[F.count_if(m).alias(k) for k, m in masks.items()])


@query(
    with_views(
        f"""WITH {HSV}, span AS (SELECT image_id, min(exg) AS lo, max(exg) AS hi FROM px GROUP BY image_id),
    bins AS (SELECT px.image_id, CASE WHEN hi > lo THEN round_even(255.0::DOUBLE * (exg - lo) / (hi - lo), 0)::INT ELSE 0 END AS level, count(*)::DOUBLE AS n FROM px JOIN span USING (image_id) GROUP BY 1, 2),
    t AS (SELECT a.image_id, a.level, sum(b.n) FILTER (b.level <= a.level) AS w, sum(b.n * b.level) FILTER (b.level <= a.level) AS m, sum(b.n) AS ww, sum(b.n * b.level) AS mm FROM bins a JOIN bins b ON b.image_id = a.image_id GROUP BY 1, 2)
    SELECT image_id, max_by(level, {{'s': round(CASE WHEN ww > w THEN w * (ww - w) * pow(m / w - (mm - m) / (ww - w), 2) ELSE 0 END, 3), 'l': -level}}) AS threshold FROM t GROUP BY image_id""",
        "pixels",
    )
)
def px5_otsu(spark, d):
    return raster.otsu(pixels(spark, d))


def _kernel_sql(kernel) -> str:
    return "(VALUES " + ", ".join(f"({dx}, {dy})" for dx, dy in kernel) + ") k(dx, dy)"


def _morph(source: str, out: str, test: str, kernel) -> str:
    """One pass over a kernel's offsets: bool_and erodes, bool_or dilates; neighbours outside the image are left out."""
    return f"{out} AS (SELECT a.image_id, a.x, a.y, {test}(b.m) AS m FROM {source} a, {_kernel_sql(kernel)}, {source} b WHERE b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY 1, 2, 3)"


_K3, _K5 = raster.ellipse(3), raster.ellipse(5)
_OPEN5 = "m0 AS (SELECT image_id, x, y, {mask} AS m FROM px), " + _morph("m0", "m1", "bool_and", _K5) + ", " + _morph("m1", "m2", "bool_or", _K5)


@query(with_views(f"WITH {HSV}, {_OPEN5.format(mask='veg')} SELECT image_id, x, y FROM m2 WHERE m", "pixels"))
def seg1_opened_vegetation(spark, d):
    return raster.opened(pixels(spark, d), "vegetation", _K5).where("vegetation").select("image_id", "x", "y")


@query(with_views(f"WITH {HSV}, m0 AS (SELECT image_id, x, y, tree AS m FROM px), {_morph('m0', 'm1', 'bool_and', _K3)}, {_morph('m1', 'm2', 'bool_or', _K3)}, {_morph('m2', 'm3', 'bool_or', _K3)}, {_morph('m3', 'm4', 'bool_and', _K3)} SELECT image_id, count(*) FILTER (m) AS tree_px FROM m4 GROUP BY image_id", "pixels"))
def px3_tree_mask(spark, d):
    p = raster.closed(raster.opened(pixels(spark, d), "tree", _K3), "tree", _K3)
    return p.groupBy("image_id").agg(F.count_if("tree").alias("tree_px"))


_REACH = """on_ AS (SELECT image_id, x, y, y::BIGINT * 1000000 + x AS id FROM px WHERE {mask}),
e AS (SELECT a.image_id, a.id AS u, b.id AS v FROM on_ a JOIN on_ b ON b.image_id = a.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id),
reach AS (SELECT image_id, id, id AS label FROM on_ UNION SELECT e.image_id, e.v, r.label FROM reach r JOIN e ON e.image_id = r.image_id AND e.u = r.id AND e.v > r.label),
lab AS (SELECT o.*, r.label FROM on_ o JOIN (SELECT image_id, id, min(label) AS label FROM reach GROUP BY 1, 2) r ON r.image_id = o.image_id AND r.id = o.id)"""
STATS = "SELECT image_id, label, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, avg(x) AS cx, avg(y) AS cy FROM lab GROUP BY image_id, label"


@query(with_views(f"WITH RECURSIVE {HSV}, {_REACH.format(mask='bare')} {STATS}", "pixels"))
def seg7_components(spark, d):
    """8-connected components of bare soil with their statistics."""
    return raster.component_stats(raster.components(pixels(spark, d), "bare"))


@query(with_views(f"WITH {HSV} SELECT image_id, count(*) AS total, count(*) FILTER (veg) AS vegetation_px, count(*) FILTER (bare) AS bare_px, count(*) FILTER (veg) / count(*)::DOUBLE * 100.0::DOUBLE AS vegetation_pct, count(*) FILTER (bare) / count(*)::DOUBLE * 100.0::DOUBLE AS bare_pct FROM px GROUP BY image_id", "pixels"))
def ag5_cover(spark, d):
    return raster.cover(pixels(spark, d))


@query(
    with_views(
        f"""WITH {HSV}, c AS (SELECT i AS row, j AS col, (i * 25) // 6 AS y1, ((i + 1) * 25) // 6 AS y2, (j * 40) // 8 AS x1, ((j + 1) * 40) // 8 AS x2 FROM range(0, 6) a(i), range(0, 8) b(j))
    SELECT image_id, row::INT AS row, col::INT AS col, round(avg(veg::INT), 3) AS vegetation, round(avg(bare::INT), 3) AS bare FROM px JOIN c ON y >= y1 AND y < y2 AND x >= x1 AND x < x2 GROUP BY image_id, row, col""",
        "pixels",
    )
)
def ag6_grid(spark, d):
    return raster.grid(pixels(spark, d))


#: A disc for each square of 10 x 10 pixels, around its last pixel.
_DISCS = """SELECT image_id, CAST(max(y * 40 + x) AS BIGINT) AS idx, CAST(max(x) AS INT) AS cx, CAST(max(y) AS INT) AS cy, CAST(3 + (max(x) + 3 * max(y) + image_id) % 5 AS INT) AS radius
FROM pixels GROUP BY image_id, floor(x / 10), floor(y / 10)"""


def discs(spark, d):
    return spark.sql(_DISCS.replace("FROM pixels", "FROM {p}"), p=view(spark, d, "pixels"))


_IN = "JOIN d ON d.image_id = px.image_id AND (x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius"


@query(with_views(f"WITH {HSV}, d AS ({_DISCS}) SELECT image_id, count(*) AS canopy_px FROM (SELECT DISTINCT px.image_id, x, y FROM px {_IN}) GROUP BY image_id", "pixels"))
def seg15_canopy(spark, d):
    """Pixels under at least one disc."""
    under = raster.in_discs(pixels(spark, d), discs(spark, d), 8)
    return under.select("image_id", "x", "y").distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("canopy_px"))


@query(with_views(f"WITH {HSV}, d AS ({_DISCS}) SELECT image_id, x, y FROM px WHERE veg AND NOT EXISTS (SELECT 1 FROM d WHERE d.image_id = px.image_id AND (x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius)", "pixels"))
def gen5_residual(spark, d):
    """Vegetation outside all discs."""
    p = pixels(spark, d)
    under = raster.in_discs(p, discs(spark, d), 8).select("image_id", "x", "y").distinct()
    return p.where("vegetation").join(under, ["image_id", "x", "y"], "left_anti").select("image_id", "x", "y")




@query(
    with_views(
        f"""WITH {HSV}, d AS ({_DISCS}) SELECT image_id, idx, round(green, 3) AS green_ratio, round(tex, 1) AS texture,
      CASE WHEN radius <= 13 OR n < 360 THEN '灌木/幼树' WHEN green < 0.34::DOUBLE THEN '稀疏冠层树' WHEN mv < 82 AND ms >= 38 THEN '暗绿阔叶树' WHEN radius >= 34 AND green >= 0.5::DOUBLE AND tex >= 14 THEN '成熟阔叶树' ELSE '普通阔叶树' END AS species
    FROM (SELECT px.image_id, idx, any_value(radius) * 8 AS radius, count(*) * 20 AS n, avg(veg::INT) AS green, avg(s) AS ms, avg(v) AS mv, stddev_pop(gray) AS tex FROM px {_IN} GROUP BY px.image_id, idx HAVING count(*) >= 20)""",
        "pixels",
    )
)
def e15_pixel_class(spark, d):
    """Class of each disc from the pixels in it; discs of fewer than twenty pixels are left out. Sizes are scaled to the small images."""
    p = raster.in_discs(pixels(spark, d), discs(spark, d), 8).groupBy("image_id", "idx")
    m = p.agg((F.first("radius") * 8).alias("radius"), (F.count(F.lit(1)) * 20).alias("n"), F.avg(F.col("vegetation").cast("int")).alias("green"), F.avg("s").alias("ms"), F.avg("v").alias("mv"), F.stddev_pop("gray").alias("tex")).where("n >= 400")
    c = rules.pixel_crown_class(F.col("radius"), F.col("n"), F.col("green"), F.col("ms"), F.col("mv"), F.col("tex"))
    return m.select("image_id", "idx", F.round("green", 3).alias("green_ratio"), F.round("tex", 1).alias("texture"), c["species"].alias("species"))


@query(with_views("SELECT image_id, (x // 4)::INT AS x, (y // 4)::INT AS y, round_even(avg(b), 0)::INT AS b, round_even(avg(g), 0)::INT AS g, round_even(avg(r), 0)::INT AS r FROM pixels GROUP BY image_id, x // 4, y // 4", "pixels"))
def px16_shrink(spark, d):
    return raster.shrink(view(spark, d, "pixels"), 4)


@query(with_views(f"WITH {HSV}, t AS (SELECT a.image_id, a.x, a.y, any_value(a.exg) AS exg, max(b.exg) AS top FROM px a JOIN px b ON b.image_id = a.image_id AND abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 4 WHERE a.exg >= 60 GROUP BY 1, 2, 3) SELECT image_id, x, y, exg FROM t WHERE exg = top", "pixels"))
def w4_local_maxima(spark, d):
    return raster.local_maxima(pixels(spark, d), "exg", 4, 60).select("image_id", "x", "y", "exg")


@query(
    with_views(
        f"""WITH {HSV}, d AS ({_DISCS}), k AS (SELECT image_id, idx, a, round_even(cx + (radius + o) * cos(a * (2 * 3.141592653589793::DOUBLE / 96)), 0)::INT AS x, round_even(cy + (radius + o) * sin(a * (2 * 3.141592653589793::DOUBLE / 96)), 0)::INT AS y FROM d, range(0, 96) q(a), range(-3, 4) w(o)),
    h AS (SELECT k.image_id, k.idx, k.a, max(CASE WHEN tree THEN 1 ELSE 0 END) AS hit FROM k LEFT JOIN px ON px.image_id = k.image_id AND px.x = k.x AND px.y = k.y GROUP BY 1, 2, 3)
    SELECT image_id, idx, round(avg(hit), 6) AS coverage FROM h GROUP BY image_id, idx""",
        "pixels",
    )
)
def seg14_ring_coverage(spark, d):
    return raster.ring_coverage(discs(spark, d), pixels(spark, d), "tree").withColumn("coverage", F.round("coverage", 6))


@query(
    with_views(
        f"""WITH RECURSIVE {HSV}, d AS ({_DISCS}), {_REACH.format(mask='bare')}, n AS (SELECT d.image_id, d.idx, label, count(*) AS n, max((x = cx AND y = cy)::INT) AS exact FROM d JOIN lab ON lab.image_id = d.image_id AND abs(x - cx) <= 7 AND abs(y - cy) <= 7 GROUP BY 1, 2, 3)
    SELECT image_id, idx, max_by(label, {{'e': exact, 'n': n, 'l': -label}}) AS label FROM n GROUP BY image_id, idx""",
        "pixels",
    )
)
def seg17_label_near(spark, d):
    points = discs(spark, d).select("image_id", "idx", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return raster.label_near(points, raster.components(pixels(spark, d), "bare"))


@query(
    with_views(
        f"""WITH RECURSIVE {HSV}, {_REACH.format(mask='bare')}, c AS (SELECT l.image_id, l.label, count(*) AS area, avg(p.veg::INT) AS veg_ratio, avg((p.v > 170)::INT) AS bright, (stddev_pop(p.b) + stddev_pop(p.g) + stddev_pop(p.r)) / 3 AS colour, count(*) / ((max(l.x) - min(l.x) + 1) * (max(l.y) - min(l.y) + 1))::DOUBLE AS compact
      FROM lab l JOIN px p ON p.image_id = l.image_id AND p.x = l.x AND p.y = l.y GROUP BY 1, 2)
    SELECT image_id, label, area, round(veg_ratio, 6) AS veg_ratio, round(bright, 6) AS bright, round(colour, 6) AS colour, round(compact, 6) AS compact FROM c WHERE area >= 10""",
        "pixels",
    )
)
def j11_component_regions(spark, d):
    """What the masks and colours are within each component: the inputs of the region scores."""
    on = raster.components(pixels(spark, d), "bare")
    sd = (F.stddev_pop("b") + F.stddev_pop("g") + F.stddev_pop("r")) / 3
    box = (F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)
    out = on.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area"), F.round(F.avg(F.col("vegetation").cast("int")), 6).alias("veg_ratio"), F.round(F.avg((F.col("v") > 170).cast("int")), 6).alias("bright"), F.round(sd, 6).alias("colour"), F.round(F.count(F.lit(1)) / box, 6).alias("compact"))
    return out.where("area >= 10")


@query(
    with_views(
        f"""WITH {HSV}, k AS (SELECT dx, dy, (CASE WHEN dx = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END) * (CASE WHEN dy = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END) AS w FROM range(-1, 2) a(dx), range(-1, 2) b(dy)),
    t AS (SELECT a.image_id, a.x, a.y, sum(w * b.gray) AS m, sum(w * b.gray * b.gray) AS m2 FROM px a, k, px b
      WHERE b.image_id = a.image_id AND b.x = (CASE WHEN a.x + dx < 0 THEN -(a.x + dx) WHEN a.x + dx > 39 THEN 78 - a.x - dx ELSE a.x + dx END) AND b.y = (CASE WHEN a.y + dy < 0 THEN -(a.y + dy) WHEN a.y + dy > 24 THEN 48 - a.y - dy ELSE a.y + dy END) GROUP BY 1, 2, 3)
    SELECT image_id, x, y FROM px JOIN t USING (image_id, x, y) WHERE ((h BETWEEN 26 AND 110 AND s >= 48 AND v >= 52 AND exg >= 10 AND g >= r + 6) OR (h BETWEEN 26 AND 110 AND s >= 40 AND v BETWEEN 38 AND 75 AND exg >= 6 AND g >= r))
      AND NOT (s < 22 AND v > 68) AND NOT (v < 30 AND exg < 6) AND greatest(m2 - m * m, 0) > 30""",
        "pixels",
    )
)
def px7_crown_core(spark, d):
    """The crown core before morphology."""
    return raster.crown_core(pixels(spark, d)).where("core").select("image_id", "x", "y")


@query(
    with_views(
        f"""WITH {HSV}, span AS (SELECT image_id, min(exg) AS lo, max(exg) AS hi FROM px GROUP BY image_id),
    lv AS (SELECT px.*, CASE WHEN hi > lo THEN round_even(255.0::DOUBLE * (exg - lo) / (hi - lo), 0)::INT ELSE 0 END AS level FROM px JOIN span USING (image_id)),
    bins AS (SELECT image_id, level, count(*)::DOUBLE AS n FROM lv GROUP BY 1, 2),
    t AS (SELECT a.image_id, a.level, sum(b.n) FILTER (b.level <= a.level) AS w, sum(b.n * b.level) FILTER (b.level <= a.level) AS m, sum(b.n) AS ww, sum(b.n * b.level) AS mm FROM bins a JOIN bins b ON b.image_id = a.image_id GROUP BY 1, 2),
    o AS (SELECT image_id, max_by(level, {{'s': round(CASE WHEN ww > w THEN w * (ww - w) * pow(m / w - (mm - m) / (ww - w), 2) ELSE 0 END, 3), 'l': -level}}) AS threshold FROM t GROUP BY image_id)
    SELECT image_id, count(*) AS px FROM lv JOIN o USING (image_id) WHERE h BETWEEN 30 AND 100 AND level > threshold GROUP BY image_id""",
        "pixels",
    )
)
def px5_original_mask(spark, d):
    return raster.original_mask(pixels(spark, d)).where("original").groupBy("image_id").agg(F.count(F.lit(1)).alias("px"))
