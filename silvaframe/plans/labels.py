"""Queries over label files, manifests, edits, hit tests and row classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from silvaframe.functions import rules
from silvaframe.functions.geometry import DIST_SQL, shoelace
from silvaframe.operators import labels
from silvaframe.plans.registry import query
from silvaframe.sources.fixtures import view, with_views

CLASS_SQL = "CASE WHEN source = 'dark' THEN '暗绿阔叶树' WHEN radius <= 13 OR area_px < 360 THEN '灌木/幼树' WHEN fill_ratio <> 0 AND fill_ratio < 0.30::DOUBLE THEN '稀疏冠层树' WHEN radius >= 34 OR area_px >= 1800 THEN '成熟阔叶树' ELSE '普通阔叶树' END"


def classed(spark, d):
    return view(spark, d, "crowns").withColumn("species", rules.crown_class(F.col("source"), F.col("radius"), F.col("area_px"), F.col("fill_ratio")))


@query(with_views(f"SELECT image_id, idx, {CLASS_SQL} AS species FROM crowns", "crowns"))
def e14_row_class(spark, d):
    return classed(spark, d).select("image_id", "idx", "species")


@query(with_views(f"SELECT image_id, species AS dominant, n AS trees FROM (SELECT image_id, species, count(*) AS n, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, min(idx)) AS k FROM (SELECT *, {CLASS_SQL} AS species FROM crowns) GROUP BY image_id, species) WHERE k = 1", "crowns"))
def ag4_dominant(spark, d):
    """The most frequent class of each image, ties by first appearance."""
    n = classed(spark, d).groupBy("image_id", "species").agg(F.count(F.lit(1)).alias("trees"), F.min("idx").alias("first"))
    return n.groupBy("image_id").agg(F.max_by(F.struct("species", "trees"), F.struct("trees", -F.col("first"))).alias("m")).select("image_id", F.col("m.species").alias("dominant"), F.col("m.trees").alias("trees"))


_FILES = "SELECT stem || CASE image_id % 5 WHEN 0 THEN '_trees_corrected.csv' WHEN 1 THEN '_trees.xlsx' WHEN 2 THEN '_yolo_trees.csv' ELSE '.csv' END AS name FROM images WHERE image_id % 7 <> 0 UNION ALL SELECT stem || '_trees.csv' FROM images WHERE image_id % 3 = 0"


def files(spark, d):
    return spark.sql(f"SELECT '/labels/' || name AS path FROM ({_FILES.replace('FROM images', 'FROM {images}')})", images=view(spark, d, "images"))


@query(
    with_views(
        f"""WITH f AS (SELECT DISTINCT name FROM ({_FILES})), w AS (SELECT image_id, stem, name, place FROM images, (VALUES (0, '_trees_corrected.xlsx'), (1, '_trees_corrected.csv'), (2, '_trees.xlsx'), (3, '_trees.csv'), (4, '_yolo_trees_corrected.xlsx'), (5, '_yolo_trees_corrected.csv'), (6, '_yolo_trees.xlsx'), (7, '_yolo_trees.csv'), (8, '.xlsx'), (9, '.csv')) p(place, tail), f WHERE f.name = stem || tail)
    SELECT i.image_id, i.stem, '/labels/' || min_by(w.name, w.place) AS label_path FROM images i LEFT JOIN w ON w.image_id = i.image_id GROUP BY i.image_id, i.stem""",
        "images",
    )
)
def j7_label_file(spark, d):
    return labels.label_of_image(view(spark, d, "images"), files(spark, d))


@query(
    with_views(
        """WITH c AS (SELECT image_id, count(*) AS n FROM crowns WHERE image_id % 4 <> 1 GROUP BY image_id)
    SELECT count(n) AS prepared_images, coalesce(sum(n), 0)::BIGINT AS total_trees, string_agg(CASE WHEN n IS NULL THEN stem END, ',' ORDER BY stem) AS missing FROM (SELECT * FROM images ORDER BY stem LIMIT 20) i LEFT JOIN c ON c.image_id = i.image_id""",
        "images",
        "crowns",
    )
)
def j9_manifest(spark, d):
    m = labels.manifest(view(spark, d, "images"), view(spark, d, "crowns").where("image_id % 4 <> 1"), 20)
    return m.select("prepared_images", "total_trees", F.array_join("missing_labels", ",").alias("missing"))


@query(with_views("SELECT image_id, stem FROM images WHERE image_id % 3 <> 0 AND stem > 'IMG_0004' ORDER BY stem LIMIT 7", "images"))
def j12_pending(spark, d):
    i = view(spark, d, "images")
    return labels.pending(i, i.where("image_id % 3 = 0"), "IMG_0004", 7).select("image_id", "stem")


_EDITS = """WITH RECURSIVE start AS (SELECT image_id, idx % 30 AS label_no, min_by(x, idx) AS x, min_by(y, idx) AS y, min_by(radius, idx) AS radius FROM crowns GROUP BY image_id, idx % 30),
lab AS (SELECT * FROM start), l AS (SELECT *, row_number() OVER (PARTITION BY image_id, label_no ORDER BY seq) AS rn FROM edits),
k AS (SELECT image_id, label_no FROM lab UNION SELECT image_id, label_no FROM edits),
s AS (SELECT k.image_id, k.label_no, 0::BIGINT AS rn, lab.radius IS NOT NULL AS here, lab.x, lab.y, lab.radius, CASE WHEN lab.radius IS NOT NULL THEN 'loaded' END AS source FROM k LEFT JOIN lab USING (image_id, label_no)
 UNION ALL SELECT s.image_id, s.label_no, l.rn, CASE op WHEN 'add' THEN true WHEN 'delete' THEN false ELSE here END,
  CASE WHEN op = 'add' OR (op = 'move' AND here) THEN l.x ELSE s.x END, CASE WHEN op = 'add' OR (op = 'move' AND here) THEN l.y ELSE s.y END,
  CASE WHEN op = 'add' THEN 24 WHEN op = 'radius' AND here THEN greatest(2, least(160, s.radius + delta)) ELSE s.radius END, CASE WHEN op = 'add' THEN 'manual' ELSE source END
  FROM s JOIN l ON l.image_id = s.image_id AND l.label_no = s.label_no AND l.rn = s.rn + 1),
f AS (SELECT image_id, label_no, max_by({'h': here, 'x': x, 'y': y, 'r': radius, 's': source}, rn) AS v FROM s GROUP BY image_id, label_no)
SELECT image_id, label_no, v.x AS x, v.y AS y, v.r AS radius, v.s AS source FROM f WHERE v.h"""


@query(with_views(_EDITS, "crowns", "edits"))
def edits_applied(spark, d):
    """Net state of labels after a log of edits."""
    c = view(spark, d, "crowns").withColumn("label_no", F.col("idx") % 30)
    start = c.groupBy("image_id", "label_no").agg(*[F.min_by(x, "idx").alias(x) for x in ("x", "y", "radius")]).withColumn("source", F.lit("loaded"))
    return labels.apply_edits(start, view(spark, d, "edits"), 640, 480)


_CLICKS = "SELECT image_id, idx AS click, (x * 3 + 11) % 640 AS x, (y * 3 + 7) % 480 AS y FROM crowns WHERE idx % 20 = 0"


def clicks(spark, d):
    return spark.sql(_CLICKS.replace("FROM crowns", "FROM {crowns}"), crowns=view(spark, d, "crowns"))


@query(
    with_views(
        f"""WITH r AS ({_CLICKS}) SELECT r.image_id, click, min_by(e.idx, {{'d': {DIST_SQL.format(a='r', b='e')}, 'i': e.idx}}) AS idx FROM r JOIN crowns e ON e.image_id = r.image_id
    AND {DIST_SQL.format(a='r', b='e')} <= greatest(e.radius + 8.0::DOUBLE, 8.0::DOUBLE) GROUP BY r.image_id, click""",
        "crowns",
    )
)
def j14_nearest_circle(spark, d):
    return labels.nearest(clicks(spark, d), view(spark, d, "crowns"), 70.0)


@query(
    with_views(
        f"""WITH r AS ({_CLICKS}) SELECT r.image_id, click, max(e.idx) AS idx FROM r JOIN crowns e ON e.image_id = r.image_id
    AND CASE WHEN e.idx % 2 = 0 THEN abs(r.x - e.x) + abs(r.y - e.y) < e.radius ELSE {DIST_SQL.format(a='r', b='e')} <= e.radius END GROUP BY r.image_id, click""",
        "crowns",
    )
)
def j13_topmost_shape(spark, d):
    """Even detections are diamonds, a hair smaller than their radius so that their edge is outside; the others are circles."""
    c = view(spark, d, "crowns")
    x, y, r = F.col("x").cast("double"), F.col("y").cast("double"), F.col("radius") - 1e-6
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    diamond = F.array(corner(x - r, y), corner(x, y - r), corner(x + r, y), corner(x, y + r))
    shapes = c.withColumn("contour", F.when(F.col("idx") % 2 == 0, diamond).otherwise(F.slice(diamond, 1, 0)))
    return labels.topmost(clicks(spark, d), shapes, 70.0)


@query(with_views("SELECT image_id, idx, 2.0::DOUBLE * radius * radius AS area FROM crowns", "crowns"))
def e16_polygon_area(spark, d):
    c = view(spark, d, "crowns")
    x, y, r = (F.col(k).cast("double") for k in ("x", "y", "radius"))
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return c.select("image_id", "idx", shoelace(F.array(corner(x - r, y), corner(x, y - r), corner(x + r, y), corner(x, y + r))).alias("area"))


@query(with_views("SELECT image_id, idx, tx + x AS gx, ty + y AS gy FROM (SELECT *, (idx % 4 * 200)::INT AS tx, (idx % 3 * 150)::INT AS ty FROM crowns) WHERE x < 320 AND y < 320 AND radius BETWEEN 12 AND 50", "crowns"))
def e7_tile_to_global(spark, d):
    c = view(spark, d, "crowns").withColumn("tx", (F.col("idx") % 4 * 200).cast("int")).withColumn("ty", (F.col("idx") % 3 * 150).cast("int"))
    g = rules.tile_to_global((F.col("tx"), F.col("ty"), F.lit(320), F.lit(320)), F.col("x"), F.col("y"), F.col("radius"), 12, 50)
    return c.withColumn("g", g).where("g is not null").select("image_id", "idx", F.col("g.x").alias("gx"), F.col("g.y").alias("gy"))


@query(with_views("SELECT image_id, idx, conf AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, idx) AS k FROM crowns) WHERE k <= 8", "crowns"))
def so2_top_regions(spark, d):
    """The eight surest rows of each image; the planner keeps eight per task before the shuffle."""
    k = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("conf"), "idx"))
    return view(spark, d, "crowns").withColumn("k", k).where("k <= 8").select("image_id", "idx", F.col("conf").alias("confidence"))


@query(with_views("""SELECT image_id, idx, CASE WHEN bare > 65 AND veg < 20 THEN '重度' WHEN bare > 48 AND veg < 35 THEN '中度' WHEN bare > 32 THEN '轻度' ELSE '稳定' END AS level,
 round(area_px * 0.1::DOUBLE * 0.1::DOUBLE / 10000.0::DOUBLE * 18.0::DOUBLE, 9) AS stock, CASE WHEN circularity > 0.58::DOUBLE THEN 'bare' WHEN fill_ratio > 0.42::DOUBLE THEN 'vegetation' ELSE 'none' END AS overlay,
 round(0.34::DOUBLE + least(0.24::DOUBLE, (radius - 35.0::DOUBLE) / 120.0::DOUBLE) + least(0.22::DOUBLE, (veg + 150 - 160.0::DOUBLE) / 170.0::DOUBLE) + least(0.12::DOUBLE, sqrt(area_px) / 65.0::DOUBLE) + least(0.10::DOUBLE, conf * 1.8::DOUBLE), 9) AS fire,
 round(0.22::DOUBLE + least(0.20::DOUBLE, conf * 1.2::DOUBLE) + least(0.22::DOUBLE, radius / 120.0::DOUBLE) + least(0.12::DOUBLE, circularity * 0.18::DOUBLE) + least(0.12::DOUBLE, fill_ratio * 0.18::DOUBLE) + least(0.10::DOUBLE, least(1.0::DOUBLE, sqrt(area_px / 4000)) * 0.10::DOUBLE) - bare / 100 * 0.18::DOUBLE, 9) AS waste
 FROM (SELECT *, circularity * 100 AS bare, fill_ratio * 50 AS veg FROM crowns)""", "crowns"))
def e17_site_rules(spark, d):
    """Desertification level, carbon stock, overlay class, fire confidence and waste score, on the crowns' numbers."""
    c = view(spark, d, "crowns").withColumn("bare", F.col("circularity") * 100).withColumn("veg", F.col("fill_ratio") * 50)
    n = F.col
    return c.select(
        "image_id",
        "idx",
        rules.desert_level(n("bare"), n("veg")).alias("level"),
        F.round(rules.green_hectares(n("area_px")) * 18.0, 9).alias("stock"),
        rules.overlay_class(n("circularity"), n("fill_ratio")).alias("overlay"),
        F.round(rules.fire_confidence(n("radius"), n("veg") + 150, n("area_px"), n("conf")), 9).alias("fire"),
        F.round(rules.waste_score(n("conf"), n("radius"), n("circularity"), n("fill_ratio"), n("area_px"), F.lit(4000), n("bare") / 100), 9).alias("waste"),
    )
