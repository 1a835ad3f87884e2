"""Label files, manifests, manual edits and hit tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaframe.functions.geometry import distance, in_polygon

# Names of an image's label file, in order of preference; csv after xlsx.
PATTERNS = ("{stem}_trees_corrected", "{stem}_trees", "{stem}_yolo_trees_corrected", "{stem}_yolo_trees", "{stem}")
SUFFIXES = (".xlsx", ".csv")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp")
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv", ".wmv")


def stem(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*?)(?:\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def is_video(path: Column) -> Column:
    return suffix(path).isin(*VIDEO_SUFFIXES)


def label_of_image(images: DataFrame, files: DataFrame) -> DataFrame:
    """(image_id, stem, label_path): each image with the first label file of its names; null without one."""
    names = F.array(*[F.concat(F.lit(p.split("{stem}")[0]), F.col("stem"), F.lit(p.split("{stem}")[1] + s)) for p in PATTERNS for s in SUFFIXES])
    wanted = images.select("image_id", "stem", F.posexplode(names).alias("place", "name"))
    found = wanted.join(files.select(F.regexp_extract(F.col("path"), r"([^/\\]*)$", 1).alias("name"), "path"), "name")
    first = found.groupBy("image_id").agg(F.min_by("path", F.struct("place", "path")).alias("label_path"))
    return images.select("image_id", "stem").join(first, "image_id", "left")


def manifest(images: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: prepared_images, total_trees, missing_labels, items (name, tree_count), by name.

    The lists are the manifest itself, one short entry per image.
    """
    counts = labels.groupBy("image_id").agg(F.count(F.lit(1)).alias("tree_count"))
    rows = images.select("image_id", "stem").orderBy("stem")
    rows = (rows.limit(limit) if limit else rows).join(counts, "image_id", "left")
    item = F.when(F.col("tree_count").isNotNull(), F.struct(F.col("stem").alias("name"), "tree_count"))
    return rows.agg(
        F.count("tree_count").alias("prepared_images"),
        F.coalesce(F.sum("tree_count"), F.lit(0)).alias("total_trees"),
        F.array_sort(F.collect_list(F.when(F.col("tree_count").isNull(), F.col("stem")))).alias("missing_labels"),
        F.array_sort(F.collect_list(item)).alias("items"),
    )


def image_of_label(labels: DataFrame, demo: DataFrame, raw: DataFrame) -> DataFrame:
    """(stem, label_path, image_path): each label file (stem, path) with the image of its stem, from the demo folder or else
    from the raw images; labels without an image are left out."""
    of = lambda df, name: df.groupBy("stem").agg(F.min("path").alias(name))
    out = labels.select("stem", F.col("path").alias("label_path")).join(of(demo, "_demo"), "stem", "left").join(of(raw, "_raw"), "stem", "left")
    return out.select("stem", "label_path", F.coalesce("_demo", "_raw").alias("image_path")).where("image_path is not null")


def with_classes(rows: DataFrame, pixels: DataFrame) -> DataFrame:
    """Rows (image_id, idx, species) with the class from their pixels (image_id, idx, n, species, species_confidence) where twenty pixels or more
    gave one; the row's own class otherwise."""
    of = pixels.where("n >= 20").select("image_id", "idx", F.col("species").alias("_species"), F.col("species_confidence").alias("_sure"))
    out = rows.join(of, ["image_id", "idx"], "left")
    return out.withColumn("species", F.coalesce("_species", "species")).withColumnRenamed("_sure", "species_confidence").drop("_species")


def pending(images: DataFrame, done: DataFrame, start_after: str | None = None, limit: int | None = None) -> DataFrame:
    """Images without an output yet, after a name, by name, so many at most."""
    out = images.join(done.select("stem"), "stem", "left_anti")
    out = out.where(F.col("stem") > start_after) if start_after else out
    return out.orderBy("stem").limit(limit) if limit else out


def paired_by_position(images: DataFrame, files: DataFrame) -> DataFrame:
    """The n-th image with the n-th label file; both lists have to be of one length.

    The file lists of one run are short; numbering them needs one order over each.
    """
    at = lambda c: F.row_number().over(Window.orderBy(c)).alias("n")
    out = images.select(F.col("stem"), at("stem")).join(files.select("path", at("path")), "n", "full")
    ok = F.col("stem").isNotNull() & F.col("path").isNotNull()
    return out.select(F.when(ok, F.col("stem")).otherwise(F.raise_error(F.lit("lists of images and labels differ in length"))).alias("stem"), "path")


def apply_edits(labels: DataFrame, edits: DataFrame, width: int, height: int, radius: tuple[int, int] = (2, 160), new_radius: int = 24) -> DataFrame:
    """(image_id, label_no, x, y, radius, source): labels after an edit log (image_id, seq, label_no, op, x, y, delta).

    add sets a label anew at a place, delete removes it, move sets its place within the image, radius
    changes its radius within limits; edits of a label that is not there do nothing. A label's edits
    are folded in order; only the edits since its last add or delete can matter before that fold.
    """
    start = labels.select("image_id", "label_no", F.lit(-1).cast("long").alias("seq"), F.lit("have").alias("op"), "x", "y", F.col("radius").alias("delta"), "source")
    log = edits.select("image_id", "label_no", "seq", "op", "x", "y", "delta", F.lit("manual").alias("source")).unionByName(start)
    sets = F.col("op").isin("add", "delete", "have")
    last = F.max(F.when(sets, F.col("seq"))).over(Window.partitionBy("image_id", "label_no"))
    log = log.withColumn("from", last).where(F.col("seq") >= F.col("from"))
    # bounded steps since the label was set: place by the last move, radius by a clamped running sum
    steps = F.array_sort(F.collect_list(F.when(F.col("op") == "radius", F.struct("seq", "delta"))))
    out = log.groupBy("image_id", "label_no").agg(
        F.max_by("op", F.when(sets, F.col("seq"))).alias("op"),
        F.max_by("source", F.when(sets, F.col("seq"))).alias("source"),
        F.max_by("delta", F.when(sets, F.col("seq"))).alias("start"),
        F.max_by(F.struct("x", "y"), F.when(F.col("op") != "radius", F.col("seq"))).alias("at"),
        steps.alias("steps"),
    )
    first = F.when(F.col("op") == "add", F.lit(new_radius)).otherwise(F.col("start"))
    size = F.aggregate("steps", first.cast("int"), lambda acc, s: F.greatest(F.lit(radius[0]), F.least(F.lit(radius[1]), acc + s["delta"])))
    clamp = lambda c, top: F.greatest(F.lit(0), F.least(F.lit(top), F.col(f"at.{c}"))).cast("int").alias(c)
    return out.where("op <> 'delete'").select("image_id", "label_no", clamp("x", width), clamp("y", height), size.alias("radius"), "source")


def nearest(clicks: DataFrame, circles: DataFrame, cell: float, slack: float = 8.0) -> DataFrame:
    """(image_id, click, idx): for each click the nearest circle that it is in or near; the first of equals."""
    from silvaframe.operators.spatial import point_pairs

    dist = lambda p, q: distance(p("x"), p("y"), q("x"), q("y"))
    reach = lambda q: F.greatest(q("radius") + slack, F.lit(slack))
    pairs = point_pairs(clicks, circles, ["image_id"], cell, lambda p, q: dist(p, q) <= reach(q), reach, (["click"], ["idx"]))
    p, q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
    return pairs.groupBy("image_id", p("click").alias("click")).agg(F.min_by("q.idx", F.struct(dist(p, q), "q.idx")).alias("idx"))


def topmost(clicks: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """(image_id, click, idx): for each click the last drawn shape that it is in: its polygon, or its circle without one."""
    from silvaframe.operators.spatial import point_pairs

    either = lambda q, polygon, circle: F.when(F.size(q("contour")) >= 3, polygon).otherwise(circle)
    hit = lambda p, q: either(q, in_polygon(q("contour"), p("x"), p("y")), distance(p("x"), p("y"), q("x"), q("y")) <= q("radius"))
    off = lambda q: F.transform(q("contour"), lambda c: F.greatest(F.abs(c["x"] - q("x")), F.abs(c["y"] - q("y"))))
    pairs = point_pairs(clicks, shapes, ["image_id"], cell, hit, lambda q: either(q, F.array_max(off(q)), q("radius")), (["click"], ["idx"]))
    return pairs.groupBy("image_id", F.col("p.click").alias("click")).agg(F.max("q.idx").alias("idx"))
