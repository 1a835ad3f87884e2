"""Queries that show single functions and composed flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from silvaframe.functions import conflicts, rules
from silvaframe.functions.geometry import box_iou, contour_json, parse_contour
from silvaframe.operators import labels, tiles, verdicts
from silvaframe.operators.spatial import widest
from silvaframe.operators.suppress import renumber, suppress
from silvaframe.plans.detect import _SAME, greedy_sql
from silvaframe.plans.registry import query
from silvaframe.sources.fixtures import view, with_views


@query(
    with_views(
        """SELECT id, CASE WHEN lower(trim(t)) IN ('true', 'yes', 'y', '1') THEN true WHEN lower(trim(t)) IN ('false', 'no', 'n', '0') THEN false WHEN try_cast(trim(t) AS DOUBLE) IS NOT NULL THEN try_cast(trim(t) AS DOUBLE) <> 0 ELSE true END AS yes,
    coalesce(least(100, greatest(0, round_even(CASE WHEN isfinite(try_cast(trim(t) AS DOUBLE)) THEN try_cast(trim(t) AS DOUBLE) END, 0))), 7)::INT AS confidence
    FROM (SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN ' YES ' WHEN 1 THEN 'n' WHEN 2 THEN '2.5' WHEN 3 THEN '-3' WHEN 4 THEN '' WHEN 5 THEN 'tree' WHEN 6 THEN '250' WHEN 7 THEN '0.0' ELSE '77.5' END AS t FROM events)"""
    )
)
def e8_coercions(spark, d):
    """What a model's words become as yes or no and as a confidence."""
    words = F.element_at(F.array(*[F.lit(x) for x in (" YES ", "n", "2.5", "-3", "", "tree", "250", "0.0", "77.5")]), (F.col("event_id") % 9 + 1).cast("int"))
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), words.alias("t"))
    return e.select("id", rules.coerce_bool(F.col("t"), True).alias("yes"), rules.coerce_confidence(F.col("t"), 7).alias("confidence"))


@query(
    with_views(
        """SELECT path, regexp_extract(replace(path, chr(92), '/'), '([^/]*?)(\\.[^./]*)?$', 1) AS stem, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS suffix, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.mp4', '.avi', '.mov', '.mkv', '.wmv') AS video
    FROM (SELECT '/data' || chr(92) || 'set/' || stem || CASE image_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mp4' WHEN 2 THEN '' ELSE '.v2.Png' END AS path FROM images)""",
        "images",
    )
)
def e22_paths(spark, d):
    tail = F.element_at(F.array(*[F.lit(x) for x in (".JPG", ".mp4", "", ".v2.Png")]), (F.col("image_id") % 4 + 1).cast("int"))
    p = view(spark, d, "images").select(F.concat(F.lit("/data\\set/"), "stem", tail).alias("path"))
    return p.select("path", labels.stem(F.col("path")).alias("stem"), labels.suffix(F.col("path")).alias("suffix"), labels.is_video(F.col("path")).alias("video"))


_AREA = "greatest(1.0::DOUBLE, 4.0::DOUBLE * {0} * {0})"
_BOTH = "(greatest(0, least(x + radius, x + 9 + idx % 20) - greatest(x - radius, x + 9 - idx % 20)) * greatest(0, least(y + radius, y + 4 + idx % 20) - greatest(y - radius, y + 4 - idx % 20)))"


@query(with_views(f"SELECT image_id, idx, round({_BOTH} / ({_AREA.format('radius')} + {_AREA.format('(idx % 20)')} - {_BOTH}), 9) AS iou FROM crowns", "crowns"))
def e2_box_iou(spark, d):
    x, y, r, k = (F.col(c) for c in ("x", "y", "radius", "idx"))
    k = k % 20
    return view(spark, d, "crowns").select("image_id", "idx", F.round(box_iou((x - r, y - r, x + r, y + r), (x + 9 - k, y + 4 - k, x + 9 + k, y + 4 + k)), 9).alias("iou"))


@query(
    greedy_sql(
        "k DESC, idx",
        _SAME.format(least=5.0, share=0.45, t=0.58),
        "SELECT *, CASE source WHEN 'reference' THEN 2 ELSE 1 END AS k FROM crowns WHERE source <> 'manual'",
        "SELECT b.source, count(*) AS trees, min(b.idx) AS first FROM kept k JOIN base b ON b.image_id = k.image_id AND b.idx = k.idx GROUP BY b.source",
    )
)
def image_flow(spark, d):
    """Union of the candidate lists, repair-style deduplication, numbering and counts, as one plan."""
    c = view(spark, d, "crowns").where("source <> 'manual'").withColumn("k", F.when(F.col("source") == "reference", 2).otherwise(1))
    kept = renumber(suppress(c, [-F.col("k"), F.col("idx")], conflicts.same_circle(5.0, 0.45, 0.58), widest(c, 2.0, 10)))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("trees"), F.min("idx").alias("first"))


def verify_images(spark, d):
    """Verdicts joined to detections, then what is kept spread over tiles as training labels."""
    v = verdicts.verify(view(spark, d, "crowns"), view(spark, d, "verdicts_raw"))
    kept = v.where(~F.col("llm_decision").startswith("rejected"))
    images = view(spark, d, "images")
    return tiles.dataset(images, kept.join(images.select("image_id", "width", "height"), "image_id").where("x < width and y < height"))


@query(
    with_views(
        "SELECT image_id, idx, CASE WHEN idx % 3 = 0 THEN NULL ELSE '[[' || (x - radius) || ',' || y || '],[' || x || ',' || (y - radius) || '],[' || (x + radius) || ',' || y || ']]' END AS contour, CASE WHEN idx % 3 = 0 THEN NULL ELSE 3 END AS points FROM crowns",
        "crowns",
    )
)
def e13_contours(spark, d):
    """Contours to JSON and back; two points are none."""
    x, y, r = F.col("x"), F.col("y"), F.col("radius")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    shape = F.when(F.col("idx") % 3 == 0, F.array(corner(x, y), corner(x, y + r))).otherwise(F.array(corner(x - r, y), corner(x, y - r), corner(x + r, y)))
    c = view(spark, d, "crowns").withColumn("contour", contour_json(shape))
    back = parse_contour(F.col("contour"))
    return c.select("image_id", "idx", "contour", F.when(back.isNotNull(), F.size(back)).alias("points"))
