"""Queries over the analysis of a site. Limits are scaled to the small images."""

from __future__ import annotations

from pyspark.sql import functions as F

from silvaframe.operators import raster, site
from silvaframe.plans.pixels import _REACH, HSV, _morph
from silvaframe.plans.registry import query
from silvaframe.sources.fixtures import view, with_views

LIMITS = site.Limits(waste_least=6, waste_share=(0.0, 0.5), margin=0, aspect=6.0, vegetation=0.5, bare=1.0, edge=0.05, colour=30.0, fire_least=4, fire_share=0.5, pad=3, cut=0.45)
_EDGE = "(x * 7 + y * 3) % 5 = 0"
_K3, _K5, _K7 = raster.square(3), raster.ellipse(5), raster.ellipse(7)
_MASKS = ", ".join(
    [
        HSV.replace("FROM pixels)", "FROM site_pixels)"),
        "v0 AS (SELECT image_id, x, y, veg AS m FROM px), b0 AS (SELECT image_id, x, y, bare AS m FROM px), a0 AS (SELECT image_id, x, y, anomaly AS m FROM px), f0 AS (SELECT image_id, x, y, fire AS m FROM px)",
        *[_morph(f"{c}0", f"{c}1", "bool_and", _K5) + ", " + _morph(f"{c}1", f"{c}2", "bool_or", _K5) for c in "vb"],
        _morph("a0", "a1", "bool_or", _K7), _morph("a1", "a2", "bool_and", _K7), _morph("a2", "a3", "bool_and", _K5), _morph("a3", "a4", "bool_or", _K5),
        _morph("f0", "f1", "bool_and", _K3), _morph("f1", "f2", "bool_or", _K3),
        "sz AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, count(*) AS total FROM px GROUP BY image_id)",
    ]
)
_OF = "JOIN px p ON p.image_id = l.image_id AND p.x = l.x AND p.y = l.y"
_TREES = "SELECT image_id, idx, x % 40 AS cx, y % 25 AS cy, 1 + radius % 6 AS radius, source AS species FROM crowns"


def planes(spark, d):
    return site.planes(view(spark, d, "site_pixels"), F.expr(_EDGE))


@query(
    with_views(
        f"""WITH RECURSIVE {_MASKS}, {_REACH.format(mask="m").replace("FROM px WHERE", "FROM a4 WHERE")},
    c AS (SELECT l.image_id, l.label AS component, count(*) AS area_px, min(l.x) AS x, min(l.y) AS y, max(l.x) - min(l.x) + 1 AS w, max(l.y) - min(l.y) + 1 AS h, avg(v2.m::INT) AS veg, avg(b2.m::INT) AS bare,
      avg(((l.x * 7 + l.y * 3) % 5 = 0)::INT) AS edges, avg((p.v > 170)::INT) AS lit, (stddev_pop(p.b) + stddev_pop(p.g) + stddev_pop(p.r)) / 3 AS spread
      FROM lab l {_OF} JOIN v2 ON v2.image_id = l.image_id AND v2.x = l.x AND v2.y = l.y JOIN b2 ON b2.image_id = l.image_id AND b2.x = l.x AND b2.y = l.y GROUP BY 1, 2),
    s AS (SELECT c.*, 0.22::DOUBLE + least(0.20::DOUBLE, edges * 1.2::DOUBLE) + least(0.22::DOUBLE, spread / 120.0::DOUBLE) + least(0.12::DOUBLE, area_px / (w * h)::DOUBLE * 0.18::DOUBLE) + least(0.12::DOUBLE, lit * 0.18::DOUBLE)
        + least(0.10::DOUBLE, least(1.0::DOUBLE, sqrt(area_px / greatest(1, floor(total * {LIMITS.waste_share[1]}::DOUBLE)))) * 0.10::DOUBLE) - bare * 0.18::DOUBLE AS score
      FROM c JOIN sz USING (image_id) WHERE area_px BETWEEN {LIMITS.waste_least} AND floor(total * {LIMITS.waste_share[1]}::DOUBLE) AND x > 0 AND y > 0 AND x + w < width AND y + h < height
        AND greatest(w, h) / least(w, h)::DOUBLE <= {LIMITS.aspect} AND veg <= {LIMITS.vegetation}::DOUBLE AND bare <= {LIMITS.bare} AND (edges >= {LIMITS.edge}::DOUBLE OR spread >= {LIMITS.colour})),
    k AS (SELECT *, round_even(least({LIMITS.waste_cap}::DOUBLE, score), 2) AS confidence FROM s WHERE score >= {LIMITS.cut}::DOUBLE)
    SELECT image_id, place::INT AS place, '{site.WASTE}' AS label, x, y, w, h, area_px, confidence, round_even(edges, 3) AS edge_density, round_even(spread, 1) AS color_std
    FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, component) AS place FROM k) WHERE place <= 8""",
        "site_pixels",
    )
)
def site_waste(spark, d):
    return site.waste_regions(planes(spark, d), LIMITS)


@query(
    with_views(
        f"""WITH RECURSIVE {_MASKS}, {_REACH.format(mask="m").replace("FROM px WHERE", "FROM f2 WHERE")},
    c AS (SELECT l.image_id, l.label AS component, count(*) AS area_px, min(l.x) AS x1, max(l.x) AS x2, min(l.y) AS y1, max(l.y) AS y2, avg(l.x) AS x, avg(l.y) AS y, avg(p.r - greatest(p.g, p.b)) AS red, avg(p.v) AS hot FROM lab l {_OF} GROUP BY 1, 2),
    q AS (SELECT c.*, width, height, greatest({LIMITS.pad}, 2 * greatest(x2 - x1 + 1, y2 - y1 + 1)) AS pad FROM c JOIN sz USING (image_id) WHERE area_px >= {LIMITS.fire_least} AND area_px <= total * {LIMITS.fire_share}::DOUBLE),
    h AS (SELECT *, greatest(0, x1 - pad) AS hx1, least(width, x2 + 1 + pad) AS hx2, greatest(0, y1 - pad) AS hy1, least(height, y2 + 1 + pad) AS hy2 FROM q),
    m AS (SELECT h.image_id, h.component, count(*) FILTER (p.smoke) / any_value((hx2 - hx1) * (hy2 - hy1))::DOUBLE AS smoke FROM h JOIN px p ON p.image_id = h.image_id AND p.x >= hx1 AND p.x < hx2 AND p.y >= hy1 AND p.y < hy2 GROUP BY 1, 2),
    s AS (SELECT h.*, smoke, 0.34::DOUBLE + least(0.24::DOUBLE, (red - 35.0::DOUBLE) / 120.0::DOUBLE) + least(0.22::DOUBLE, (hot - 160.0::DOUBLE) / 170.0::DOUBLE) + least(0.12::DOUBLE, sqrt(area_px) / 65.0::DOUBLE) + least(0.10::DOUBLE, smoke * 1.8::DOUBLE) AS score FROM h JOIN m USING (image_id, component)),
    k AS (SELECT *, round_even(least({LIMITS.fire_cap}::DOUBLE, score), 2) AS confidence FROM s WHERE score >= {LIMITS.cut}::DOUBLE)
    SELECT image_id, place::INT AS place, '{site.FIRE}' AS label, x, y, trunc(greatest(16.0::DOUBLE, least(50.0::DOUBLE, sqrt(area_px / 3.141592653589793::DOUBLE) * 3.0::DOUBLE)))::INT AS radius, area_px, confidence, round_even(smoke, 3) AS smoke_ratio
    FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, component) AS place FROM k) WHERE place <= 6""",
        "site_pixels",
    )
)
def site_fires(spark, d):
    return site.fire_points(planes(spark, d), LIMITS)


@query(
    with_views(
        f"""WITH {_MASKS}, t AS ({_TREES}), canopy AS (SELECT image_id, count(*) AS canopy FROM (SELECT DISTINCT px.image_id, px.x, px.y FROM px JOIN t ON t.image_id = px.image_id AND (px.x - cx) * (px.x - cx) + (px.y - cy) * (px.y - cy) <= radius * radius) GROUP BY image_id),
    kinds AS (SELECT image_id, species, count(*) AS n, min(idx) AS first FROM t GROUP BY 1, 2), best AS (SELECT image_id, sum(n)::BIGINT AS trees, max_by(species, {{'n': n, 'f': -first}}) AS species FROM kinds GROUP BY image_id),
    cover AS (SELECT v2.image_id, count(*) FILTER (v2.m) AS veg, count(*) FILTER (b2.m) AS soil FROM v2 JOIN b2 ON b2.image_id = v2.image_id AND b2.x = v2.x AND b2.y = v2.y GROUP BY 1),
    s AS (SELECT sz.*, veg, soil, veg / total::DOUBLE * 100.0::DOUBLE AS vp, soil / total::DOUBLE * 100.0::DOUBLE AS bp, coalesce(canopy, 0) / total::DOUBLE * 100.0::DOUBLE AS cp, veg * 0.1::DOUBLE * 0.1::DOUBLE / 10000.0::DOUBLE AS ha, coalesce(trees, 0) AS trees, coalesce(species, '--') AS species
      FROM sz JOIN cover USING (image_id) LEFT JOIN canopy USING (image_id) LEFT JOIN best USING (image_id))
    SELECT image_id, width AS image_width, height AS image_height, trees AS tree_count, round_even(vp, 2) AS vegetation_cover_pct, round_even(least(100.0::DOUBLE, cp), 2) AS canopy_cover_pct, round_even(bp, 2) AS bare_soil_pct,
      CASE WHEN bp > 65 AND vp < 20 THEN '重度' WHEN bp > 48 AND vp < 35 THEN '中度' WHEN bp > 32 THEN '轻度' ELSE '稳定' END AS desertification_level, round_even(ha * 18.0::DOUBLE, 2) AS carbon_stock_tco2e, round_even(ha * 6.0::DOUBLE, 2) AS annual_sink_tco2e, species AS dominant_species FROM s""",
        "site_pixels",
        "crowns",
    )
)
def site_summary(spark, d):
    trees = spark.sql(_TREES.replace("FROM crowns", "FROM {c}"), c=view(spark, d, "crowns"))
    return site.summary(planes(spark, d), trees, 8)


@query(with_views(f"WITH {HSV} SELECT image_id, count(*) FILTER ((h BETWEEN 25 AND 110)::INT + (exg >= 10)::INT + 1 >= 2 AND NOT v < 40) AS without_plane, count(*) FILTER ((h BETWEEN 25 AND 110)::INT + (exg >= 10)::INT + ((x * 5 + y) % 256 < 122)::INT >= 2 AND NOT (v < 40 OR (x + y * 3) % 256 < 35)) AS with_plane FROM px GROUP BY image_id", "pixels"))
def px4_vote_mask(spark, d):
    """The vote of three with and without the planes of Lab, which stand here as numbers of the place."""
    p = raster.colour(view(spark, d, "pixels"))
    a, light = F.expr("(x * 5 + y) % 256"), F.expr("(x + y * 3) % 256")
    return p.groupBy("image_id").agg(F.count_if(raster.vote_mask()).alias("without_plane"), F.count_if(raster.vote_mask(a, light)).alias("with_plane"))
