"""Tiles of an image, what lies in them, and training labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvaframe.functions.geometry import box_intersection
from silvaframe.functions.rules import yolo_line


def origins(length: Column, size: int, overlap: float) -> Column:
    """Tile origins along one side: steps of a stride, the last one moved back to the edge, each once."""
    stride = max(1, int(size * (1 - overlap)))
    rest = F.greatest(F.lit(0), length - size)
    steps = F.ceil(rest / stride).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), steps), lambda k: F.least(k * stride, rest)))


def generate_tiles(images: DataFrame, size: int = 640, overlap: float = 0.2) -> DataFrame:
    """(image_id, tile_idx, tx, ty, tw, th): tiles in row order that cover each image."""
    out = images.select("image_id", "width", "height", F.posexplode(origins(F.col("height"), size, overlap)).alias("row", "ty"), origins(F.col("width"), size, overlap).alias("xs"))
    out = out.select("*", F.size("xs").alias("n"), F.posexplode("xs").alias("col", "tx"))
    return out.select("image_id", (F.col("row") * F.col("n") + F.col("col")).alias("tile_idx"), "tx", "ty", F.least(F.lit(size), F.col("width") - F.col("tx")).alias("tw"), F.least(F.lit(size), F.col("height") - F.col("ty")).alias("th"))


def _buckets(low: Column, high: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def _bucketed(left: DataFrame, tiles: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, size: int) -> DataFrame:
    """Boxes with the tiles they may touch: an equi-join on image and the grid squares of a tile's size."""
    a = left.withColumn("_bx", _buckets(x1, x2, size)).withColumn("_by", _buckets(y1, y2, size))
    b = tiles.withColumn("_bx", _buckets(F.col("tx"), F.col("tx") + F.col("tw"), size)).withColumn("_by", _buckets(F.col("ty"), F.col("ty") + F.col("th"), size))
    return a.join(b, ["image_id", "_bx", "_by"])


def in_tiles(detections: DataFrame, tiles: DataFrame, size: int = 640) -> DataFrame:
    """Each detection with every tile that holds its centre; tiles are half open."""
    at = F.col("x"), F.col("y")
    out = _bucketed(detections, tiles, *at, *at, size)
    return out.where((F.col("tx") <= F.col("x")) & (F.col("x") < F.col("tx") + F.col("tw")) & (F.col("ty") <= F.col("y")) & (F.col("y") < F.col("ty") + F.col("th"))).drop("_bx", "_by")


def tile_labels(labels: DataFrame, tiles: DataFrame, visible: float = 0.65, size: int = 640) -> DataFrame:
    """Labels that show enough of their box in a tile, clipped to it, as text lines of relative numbers."""
    r = F.col("radius").cast("double")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    box = (x - r, y - r, x + r, y + r)
    out = _bucketed(labels, tiles, *box, size)
    edge = tuple(c.cast("double") for c in (F.col("tx"), F.col("ty"), F.col("tx") + F.col("tw"), F.col("ty") + F.col("th")))
    full = F.greatest(F.lit(1.0), (box[2] - box[0]) * (box[3] - box[1]))
    out = out.where(box_intersection(box, edge) / full >= visible).dropDuplicates(["image_id", "idx", "tile_idx"])
    x1, y1 = F.greatest(box[0], edge[0]) - edge[0], F.greatest(box[1], edge[1]) - edge[1]
    x2, y2 = F.least(box[2], edge[2]) - edge[0], F.least(box[3], edge[3]) - edge[1]
    out = out.where((x2 > x1) & (y2 > y1))
    line = yolo_line((x1 + x2) / 2.0 / F.col("tw"), (y1 + y2) / 2.0 / F.col("th"), (x2 - x1) / F.col("tw"), (y2 - y1) / F.col("th"))
    return out.withColumn("line", line).drop("_bx", "_by")


def split(stem: Column, tx: Column, ty: Column, train: float = 0.8, seed: str = "42") -> Column:
    """train or val by a hash of seed and tile, so the answer depends on nothing else."""
    key = F.concat_ws("|", F.lit(seed), stem, tx.cast("string"), ty.cast("string"))
    return F.when(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 10000 < int(train * 10000), "train").otherwise("val")


def dataset(images: DataFrame, labels: DataFrame, size: int = 640, overlap: float = 0.2, visible: float = 0.65, include_empty: bool = False, train: float = 0.8, need_labels: bool = False) -> DataFrame:
    """(image_id, stem, tile_idx, tx, ty, tw, th, split, lines): a row per tile with its label lines.

    need_labels: an image without any label is an error, raised when the rows are read.
    """
    if need_labels:
        some = labels.select("image_id").distinct().withColumn("_some", F.lit(True))
        none = F.raise_error(F.concat(F.lit("no labels for image "), F.col("stem")))
        images = images.join(some, "image_id", "left").withColumn("stem", F.when(F.col("_some"), F.col("stem")).otherwise(none)).drop("_some")
    tiles = generate_tiles(images, size, overlap)
    lines = tile_labels(labels, tiles, visible, size).groupBy("image_id", "tile_idx").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    out = tiles.join(images.select("image_id", "stem"), "image_id").join(lines, ["image_id", "tile_idx"], "left" if include_empty else "inner")
    return out.withColumn("lines", F.coalesce("lines", F.array().cast("array<string>"))).withColumn("split", split(F.col("stem"), F.col("tx"), F.col("ty"), train))
