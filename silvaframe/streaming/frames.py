"""Frames of a video as a stream: each is worked on by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaframe.operators import detector, raster
from silvaframe.sources.io import read_images, to_pixels


def frame_pixels(spark: SparkSession, path: str, schema: str = "image_id long, x int, y int, b int, g int, r int", per_batch: int = 16) -> DataFrame:
    """Pixels of frames that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def frame_cover(pixels: DataFrame) -> DataFrame:
    """Flags per pixel: a stateless map, the same on a stream as on a table."""
    p = raster.colour(pixels)
    return p.select("image_id", "x", "y", raster.vegetation().alias("vegetation"), raster.bare_soil().alias("bare"), raster.tree_mask().alias("tree"))


def run(pixels: DataFrame, out: str, checkpoint: str):
    """Writes each micro-batch's counts per frame; restarts where the checkpoint says.

    A frame is one file, hence within one micro-batch: counts need no state across batches. Batches are
    written under their number, so one that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), *[F.count_if(c).alias(c) for c in ("vegetation", "bare", "tree")])
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return frame_cover(pixels).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frame_files(spark: SparkSession, path: str, per_batch: int = 16) -> DataFrame:
    """(path, modificationTime, length, content): image files as they arrive in a folder. Only their paths are read below."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(path)


def frame_counts(pixels: DataFrame, preset: str | None = None) -> DataFrame:
    """(image_id, pixels, vegetation, bare, tree) of each frame; with the name of a detector also trees, the detections in it."""
    counts = frame_cover(pixels).groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), *[F.count_if(c).alias(c) for c in ("vegetation", "bare", "tree")])
    if preset is None:
        return counts
    trees = detector.detect(pixels, preset)[0].groupBy("image_id").agg(F.count(F.lit(1)).alias("trees"))
    return counts.join(trees, "image_id", "left").withColumn("trees", F.coalesce("trees", F.lit(0)))


def run_images(files: DataFrame, out: str, checkpoint: str, preset: str | None = None):
    """Writes the counts of each frame of a stream of image files; restarts where the checkpoint says.

    A micro-batch's files, as many as the stream takes at a time, are decoded by the image source, on the executors, and cut into rows of pixels. Frames are worked on by themselves. A file that is no
    image gives no row. Batches are written under their number, so one that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]  # per_batch at most
        if paths:
            frame_counts(to_pixels(read_images(batch.sparkSession, paths)), preset).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.select("path").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
