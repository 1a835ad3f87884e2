"""Queries over sources, sinks and what joins them: written to the shared folder and reread."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from silvaframe.functions import rules
from silvaframe.operators import labels, raster, tiles, verdicts
from silvaframe.plans.pixels import _DISCS, _IN, HSV, discs, pixels
from silvaframe.plans.registry import query
from silvaframe.plans.scratch import shared_dir
from silvaframe.plans.tiling import TILES_SQL
from silvaframe.plans.verdicts import DETS, repair_inputs
from silvaframe.sources import io
from silvaframe.sources.fixtures import view, with_views


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(with_views("SELECT image_id, idx, x, y, radius, source FROM crowns", "crowns"))
def snk1_detections(spark, d):
    """Detections in folders by source."""
    path = folder(spark, "detections")
    io.write_detections(view(spark, d, "crowns").select("image_id", "idx", "x", "y", "radius", "source"), path, "source")
    return spark.read.parquet(path).select("image_id", "idx", "x", "y", "radius", "source")


@query(with_views("SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY idx)::INT AS id, x, y, radius, source FROM crowns", "crowns"))
def snk5_review(spark, d):
    """Reviewed labels as CSV, a folder for each image, numbered anew."""
    path = folder(spark, "review")
    io.write_review(view(spark, d, "crowns").withColumnRenamed("idx", "id"), path)
    return io.read_review(spark, path).withColumn("image_id", F.col("image_id").cast("long"))


@query(with_views("SELECT x::DOUBLE AS x, y::DOUBLE AS y, (radius - 20)::DOUBLE AS radius FROM crowns WHERE radius > 20", "crowns"))
def src4_label_scan(spark, d):
    """Labels for training from CSV; circles without extent go."""
    path = folder(spark, "labels")
    view(spark, d, "crowns").select("x", "y", (F.col("radius") - 20).alias("radius"), "source").write.option("header", True).csv(path)
    return io.read_labels(spark, path)


@query(
    with_views(
        """SELECT idx::INT AS id, x::DOUBLE AS x, y::DOUBLE AS y, radius::DOUBLE AS radius,
      CASE WHEN source = 'dark' THEN '暗绿阔叶树' WHEN radius <= 13 OR area_px < 360 THEN '灌木/幼树' WHEN fill_ratio <> 0 AND fill_ratio < 0.30::DOUBLE THEN '稀疏冠层树' WHEN radius >= 34 OR area_px >= 1800 THEN '成熟阔叶树' ELSE '普通阔叶树' END AS species,
      CASE WHEN idx % 2 = 0 THEN 3 END AS points FROM crowns""",
        "crowns",
    )
)
def src6_result_scan(spark, d):
    """Results with contours, some of which are no JSON, and the class of each row."""
    path = folder(spark, "results")
    corner = lambda dx, dy: F.format_string("[%d,%d]", F.col("x") + dx, F.col("y") + dy)
    contour = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("["), F.concat_ws(",", corner(0, 1), corner(2, 0), corner(0, 3)), F.lit("]"))).otherwise("[[broken")
    view(spark, d, "crowns").select(F.col("idx").alias("id"), "x", "y", "radius", "source", "area_px", "circularity", "fill_ratio", contour.alias("contour")).write.option("header", True).option("escape", '"').csv(path)
    return io.results(spark, path).select("id", "x", "y", "radius", "species", F.size("contour").alias("points"))


@query(with_views("SELECT image_id, to_base64(encode(stem || ' ' || repeat('pixel ', 40))) AS base64 FROM images", "images"))
def snk9_base64(spark, d):
    content = F.encode(F.concat("stem", F.lit(" "), F.repeat(F.lit("pixel "), 40)), "UTF-8")
    return io.encoded(view(spark, d, "images").withColumn("content", content)).select("image_id", "base64")


_STEMS = "SELECT stem, CASE image_id % 3 WHEN 0 THEN 'demo/' || stem || '.jpg' END AS demo, CASE WHEN image_id % 5 < 4 THEN 'raw/' || stem || '.jpg' END AS raw, 'labels/' || stem || '_trees.csv' AS path FROM images"


@query(with_views(f"WITH s AS ({_STEMS}) SELECT stem, path AS label_path, coalesce(demo, raw) AS image_path FROM s WHERE coalesce(demo, raw) IS NOT NULL", "images"))
def j10_image_of_label(spark, d):
    """Images for labels: some lie in the demo folder, some among the raw images, some nowhere."""
    s = spark.sql(_STEMS.replace("FROM images", "FROM {i}"), i=view(spark, d, "images"))
    of = lambda c: s.where(F.col(c).isNotNull()).select("stem", F.col(c).alias("path"))
    return labels.image_of_label(of("path"), of("demo"), of("raw"))


@query(
    with_views(
        f"""WITH {HSV}, d AS ({_DISCS}), a AS (SELECT image_id, idx, CASE WHEN radius * 8 <= 13 THEN '灌木/幼树' WHEN radius * 8 >= 34 THEN '成熟阔叶树' ELSE '普通阔叶树' END AS own FROM d),
    b AS (SELECT px.image_id, idx, any_value(radius) * 8 AS radius, count(*) AS n, avg(veg::INT) AS green, avg(s) AS ms, avg(v) AS mv, stddev_pop(gray) AS tex FROM px {_IN} GROUP BY px.image_id, idx),
    c AS (SELECT image_id, idx, CASE WHEN radius <= 13 OR n * 20 < 360 THEN '灌木/幼树' WHEN green < 0.34::DOUBLE THEN '稀疏冠层树' WHEN mv < 82 AND ms >= 38 THEN '暗绿阔叶树' WHEN radius >= 34 AND green >= 0.5::DOUBLE AND tex >= 14 THEN '成熟阔叶树' ELSE '普通阔叶树' END AS species,
      CASE WHEN radius <= 13 OR n * 20 < 360 THEN 0.72::DOUBLE WHEN green < 0.34::DOUBLE THEN 0.66::DOUBLE WHEN mv < 82 AND ms >= 38 THEN 0.68::DOUBLE WHEN radius >= 34 AND green >= 0.5::DOUBLE AND tex >= 14 THEN 0.70::DOUBLE ELSE 0.64::DOUBLE END AS sure FROM b WHERE n >= 20)
    SELECT a.image_id, a.idx, coalesce(species, own) AS species, sure AS species_confidence FROM a LEFT JOIN c ON c.image_id = a.image_id AND c.idx = a.idx""",
        "pixels",
    )
)
def e15_merged_classes(spark, d):
    """The class of each disc: from its pixels where there are twenty or more, from its row otherwise."""
    p = raster.in_discs(pixels(spark, d), discs(spark, d), 8).groupBy("image_id", "idx")
    m = p.agg((F.first("radius") * 8).alias("radius"), F.count(F.lit(1)).alias("n"), F.avg(F.col("vegetation").cast("int")).alias("green"), F.avg("s").alias("ms"), F.avg("v").alias("mv"), F.stddev_pop("gray").alias("tex"))
    c = rules.pixel_crown_class(F.col("radius"), F.col("n") * 20, F.col("green"), F.col("ms"), F.col("mv"), F.col("tex"))
    own = rules.crown_class(F.lit("reference"), F.col("radius") * 8, F.lit(1000.0), F.lit(1.0))
    rows = discs(spark, d).select("image_id", "idx", own.alias("species"))
    return labels.with_classes(rows, m.select("image_id", "idx", "n", c["species"].alias("species"), c["species_confidence"].alias("species_confidence")))


@query(with_views("SELECT image_id, median(radius)::DOUBLE AS middle, avg(circularity) AS mean, stddev_pop(area_px) AS spread, avg((conf > 0.5::DOUBLE)::INT) AS sure FROM crowns GROUP BY image_id", "crowns"))
def ag8_statistics(spark, d):
    return view(spark, d, "crowns").groupBy("image_id").agg(F.median("radius").alias("middle"), F.avg("circularity").alias("mean"), F.stddev_pop("area_px").alias("spread"), F.avg((F.col("conf") > 0.5).cast("int")).alias("sure"))


@query("SELECT event_id AS id, coalesce(round_even(CASE WHEN isfinite(try_cast(trim(t) AS DOUBLE)) THEN try_cast(trim(t) AS DOUBLE) END, 0)::BIGINT, -1) AS number FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' 12 ' WHEN 1 THEN '2.5' WHEN 2 THEN 'x' WHEN 3 THEN '-3.7' WHEN 4 THEN '' ELSE '1e3' END AS t FROM events)")
def e10_whole_numbers(spark, d):
    words = F.element_at(F.array(*[F.lit(x) for x in (" 12 ", "2.5", "x", "-3.7", "", "1e3")]), (F.col("event_id") % 6 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), rules.whole_number(words, -1).alias("number"))


_TEMPLATE = "Tile of {width} x {height}. Candidates: {candidates}. Answer with JSON."


@query(
    with_views(
        f"""WITH {TILES_SQL}, dets AS ({DETS}), l AS (SELECT d.image_id, t.tile_idx, string_agg('{{"id":' || det_no || ',"x":' || (x - tx) || ',"y":' || (y - ty) || ',"radius":' || radius || '}}', ',' ORDER BY det_no) AS c
      FROM dets d JOIN tiles t ON t.image_id = d.image_id AND tx <= x AND x < tx + tw AND ty <= y AND y < ty + th GROUP BY 1, 2)
    SELECT t.image_id, t.tile_idx, 'Tile of ' || tw || ' x ' || th || '. Candidates: [' || coalesce(c, '') || ']. Answer with JSON.' AS prompt FROM tiles t LEFT JOIN l ON l.image_id = t.image_id AND l.tile_idx = t.tile_idx""",
        "images",
        "crowns",
    )
)
def e23_prompts(spark, d):
    dets, _, t = repair_inputs(spark, d)
    return verdicts.prompts(verdicts.tile_candidates(tiles.in_tiles(dets, t), t), _TEMPLATE).select("image_id", "tile_idx", "prompt")
