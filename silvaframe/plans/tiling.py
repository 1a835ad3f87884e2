"""Queries over tiles and training labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from silvaframe.operators import tiles
from silvaframe.plans.registry import query
from silvaframe.sources.fixtures import view, with_views

_ORIGINS = "list_distinct(list_transform(range(0, ceil(greatest(0, {n} - 640) / 512.0)::BIGINT + 1), lambda k: least(k * 512, greatest(0, {n} - 640))))"
TILES_SQL = f"""tiles AS (SELECT image_id, stem, (row_number() OVER (PARTITION BY image_id ORDER BY ty, tx) - 1)::INT AS tile_idx, tx::INT AS tx, ty::INT AS ty, least(640, width - tx)::INT AS tw, least(640, height - ty)::INT AS th
 FROM (SELECT *, unnest({_ORIGINS.format(n='width')}) AS tx FROM (SELECT *, unnest({_ORIGINS.format(n='height')}) AS ty FROM images)))"""
#: Labels of the images: the crowns of the same number, spread over the image.
LABELS = "SELECT i.image_id, idx, (c.x * 7 + idx % 13) % i.width AS x, (c.y * 5 + idx % 11) % i.height AS y, radius FROM crowns c JOIN images i ON i.image_id = c.image_id"


def label_view(spark, d):
    return spark.sql(LABELS.replace("crowns c", "{crowns} c").replace("images i", "{images} i"), crowns=view(spark, d, "crowns"), images=view(spark, d, "images"))


@query(with_views(f"WITH {TILES_SQL} SELECT image_id, tile_idx, tx, ty, tw, th FROM tiles", "images"))
def t1_tiles(spark, d):
    return tiles.generate_tiles(view(spark, d, "images"))


@query(with_views(f"WITH {TILES_SQL}, labels AS ({LABELS}) SELECT l.image_id, l.idx, t.tile_idx FROM labels l JOIN tiles t ON t.image_id = l.image_id AND tx <= x AND x < tx + tw AND ty <= y AND y < ty + th", "images", "crowns"))
def j3_in_tiles(spark, d):
    return tiles.in_tiles(label_view(spark, d), tiles.generate_tiles(view(spark, d, "images"))).select("image_id", "idx", "tile_idx")


_VIS = "greatest(0, least(x + radius, tx + tw) - greatest(x - radius, tx)) * greatest(0, least(y + radius, ty + th) - greatest(y - radius, ty))::DOUBLE"


def _six(over: str, under: str) -> str:
    """over / under to six places, half to even, in whole numbers."""
    n, d = f"(({over})::BIGINT * 1000000)", f"({under})::BIGINT"
    return f"(({n} // {d} + CASE WHEN 2 * ({n} % {d}) > {d} OR (2 * ({n} % {d}) = {d} AND ({n} // {d}) % 2 = 1) THEN 1 ELSE 0 END) / 1000000::DOUBLE)"


_X = "greatest(x - radius, tx)", "least(x + radius, tx + tw)"
_Y = "greatest(y - radius, ty)", "least(y + radius, ty + th)"
_NUMBERS = ", ".join([_six(f"{_X[0]} + {_X[1]} - 2 * tx", "2 * tw"), _six(f"{_Y[0]} + {_Y[1]} - 2 * ty", "2 * th"), _six(f"{_X[1]} - {_X[0]}", "tw"), _six(f"{_Y[1]} - {_Y[0]}", "th")])
LINES_SQL = f"""lines AS (SELECT l.image_id, l.idx, t.tile_idx, stem, tx, ty, format('0 {{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}}', {_NUMBERS}) AS line
  FROM labels l JOIN tiles t ON t.image_id = l.image_id AND {_VIS} / greatest(1.0::DOUBLE, 4.0::DOUBLE * radius * radius) >= 0.65::DOUBLE)"""


@query(with_views(f"WITH {TILES_SQL}, labels AS ({LABELS}), {LINES_SQL} SELECT image_id, idx, tile_idx, line FROM lines", "images", "crowns"))
def t2_tile_labels(spark, d):
    return tiles.tile_labels(label_view(spark, d), tiles.generate_tiles(view(spark, d, "images"))).select("image_id", "idx", "tile_idx", "line")


@query(
    with_views(
        f"""WITH {TILES_SQL}, labels AS ({LABELS}), {LINES_SQL}, t AS (SELECT image_id, tile_idx, count(*) AS boxes,
      CASE WHEN ('0x' || substr(md5(concat_ws('|', '42', any_value(stem), any_value(tx)::VARCHAR, any_value(ty)::VARCHAR)), 1, 8))::BIGINT % 10000 < 8000 THEN 'train' ELSE 'val' END AS split FROM lines GROUP BY image_id, tile_idx)
    SELECT image_id, split, count(*) AS tiles, sum(boxes)::BIGINT AS boxes FROM t GROUP BY ROLLUP (split, image_id)""",
        "images",
        "crowns",
    )
)
def t5_split_counts(spark, d):
    """Tiles and boxes by split and image, with the totals."""
    out = tiles.dataset(view(spark, d, "images"), label_view(spark, d))
    return out.rollup("split", "image_id").agg(F.count(F.lit(1)).alias("tiles"), F.sum(F.size("lines")).alias("boxes")).select("image_id", "split", "tiles", "boxes")
