"""Reading images, labels and results; writing detections, label sets and manifests."""

from __future__ import annotations

import io
import itertools
import os
import re
import shutil
import uuid
import xml.etree.ElementTree as ET
import zipfile
import zlib
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from silvaframe.functions.geometry import parse_contour
from silvaframe.functions.rules import crown_class
from silvaframe.operators.labels import IMAGE_SUFFIXES, stem, suffix

LABEL_SCHEMA = "id int, x double, y double, radius double, source string"


def list_images(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """(path, stem, length) of the image files in directories or under globs, each once, by path. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(paths).select("path", "length")
    return files.where(suffix(F.col("path")).isin(*suffixes)).dropDuplicates(["path"]).withColumn("stem", stem(F.col("path"))).orderBy("path")


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(image_id, height, width, data): decoded images, bytes in blue, green, red order; undecodable files are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path)
    return raw.select(stem(F.col("image.origin")).alias("image_id"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.data").alias("data"))


def row_slices(images: DataFrame) -> DataFrame:
    """(image_id, width, y, line): the bytes of each row of decoded three-channel images; no row carries more than its own."""
    cut = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.struct(y.alias("y"), F.substring("data", y * F.col("width") * 3 + 1, F.col("width") * 3).alias("line")))
    return images.where("height > 0 and width > 0").select("image_id", "width", F.inline(cut))


def to_pixels(images: DataFrame) -> DataFrame:
    """(image_id, x, y, b, g, r): a row per pixel of decoded three-channel images, cut row by row without leaving the JVM."""
    byte = lambda x, c: F.conv(F.hex(F.substring("line", x * 3 + (c + 1), F.lit(1))), 16, 10).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda x: F.struct(x.alias("x"), byte(x, 0).alias("b"), byte(x, 1).alias("g"), byte(x, 2).alias("r")))
    return row_slices(images).select("image_id", "y", F.inline(cut)).select("image_id", "x", "y", "b", "g", "r")


def _require(df: DataFrame, columns: tuple[str, ...]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"label file lacks columns: {', '.join(missing)}")


def _raw_labels(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".xlsx"):
        return spark.read.format("xlsx").load(path)
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, radius) of label files for training: the three columns are required, circles without extent are dropped."""
    df = _raw_labels(spark, path)
    _require(df, ("x", "y", "radius"))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return df.select(number("x"), number("y"), number("radius")).where("radius > 0")


def read_labels_for_review(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, radius, source) with defaults: id by position in the file, source loaded."""
    df = _raw_labels(spark, path)
    _require(df, ("x", "y", "radius"))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    have = lambda c, kind: F.col(c).try_cast(kind) if c in df.columns else F.lit(None).cast(kind)
    rows = df.withColumn("_at", F.monotonically_increasing_id())  # one file is read in order by one split
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("_at"))
    return rows.select(F.coalesce(have("id", "int"), place).alias("id"), number("x"), number("y"), number("radius"), F.coalesce(have("source", "string"), F.lit("loaded")).alias("source"))


def write_detections(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, in folders by a column such as the decision if asked for."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_review(df: DataFrame, path: str, by: str = "image_id") -> None:
    """CSV with a header, a folder for each image: rows renumbered by position, whole numbers half to even; the path is replaced.

    On a file system that is local or mounted (file:, seen by all executors) tasks write each image's file themselves, as Spark's writer
    starts processes for each such file to set its mode. Elsewhere Spark writes; folders and lines are the same.
    """
    from pyspark.sql import Window

    whole = lambda c: F.bround(c, 0).cast("int").alias(c)
    out = df.withColumn("id", F.row_number().over(Window.partitionBy(by).orderBy("id"))).select(by, "id", whole("x"), whole("y"), whole("radius"), "source")
    if _seen_as_files(df.sparkSession, path):
        register(df.sparkSession)
        lines = out.sortWithinPartitions(by, "id").select(F.col(by).cast("string").alias("folder"), F.to_csv(F.struct(*_REVIEW)).alias("line"))
        lines.write.format("label_folders").option("by", by).option("header", ",".join(_REVIEW)).mode("overwrite").save(path)
    else:
        out.write.mode("overwrite").option("header", True).partitionBy(by).csv(path)


def read_review(spark: SparkSession, path: str, by: str = "image_id") -> DataFrame:
    """(image_id as text, id, x, y, radius, source) of what `write_review` wrote. Local or mounted folders are listed where they are read, not by the driver."""
    kinds = ", ".join(f"{c} {kind}" for c, kind in _REVIEW.items())
    if not _seen_as_files(spark, path):
        return spark.read.schema(f"{kinds}, `{by}` string").option("header", True).csv(path).select(by, *_REVIEW)
    register(spark)
    lines = spark.read.format("label_folders").option("by", by).option("parts", 4 * spark.sparkContext.defaultParallelism).load(path)
    return lines.select(F.col("folder").alias(by), F.from_csv("line", kinds).alias("row")).select(by, "row.*")


def write_label_set(dataset: DataFrame, path: str) -> None:
    """Text files of label lines in folders by split and tile; the folder is replaced."""
    name = F.format_string("%s_%d_%d_%dx%d", "stem", "tx", "ty", "tw", "th")
    lines = dataset.select("split", name.alias("tile"), F.explode("lines").alias("value"))
    lines.repartition("split", "tile").write.mode("overwrite").partitionBy("split", "tile").text(path)


def write_dataset_description(spark: SparkSession, path: str, names: list[str]) -> None:
    """data.yaml of a label set: where its parts are, and the names of its classes."""
    lines = [f"path: {path}", "train: images/train", "val: images/val", "names:", *[f"  {k}: {name}" for k, name in enumerate(names)]]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/data.yaml")


def encoded(images: DataFrame, column: str = "content") -> DataFrame:
    """Adds base64: the bytes of an encoded image as text, as a vision model takes them."""
    return images.withColumn("base64", F.regexp_replace(F.base64(column), r"\s+", ""))


def results(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, radius, source, area_px, circularity, fill_ratio, contour, species) of a results workbook or CSV: contours that are no
    JSON are null, the class follows from the row. A file that is not there gives no rows."""
    schema = "id int, x double, y double, radius double, source string, area_px double, circularity double, fill_ratio double, contour string"
    try:
        df = _raw_labels(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], schema)
    have = {k: kind for k, kind in (c.rsplit(" ", 1) for c in schema.split(", "))}
    df = df.select(*[(F.col(k).try_cast(kind) if k in df.columns else F.lit(None).cast(kind)).alias(k) for k, kind in have.items()])
    return df.withColumn("contour", parse_contour(F.col("contour"))).withColumn("species", crown_class(F.col("source"), F.col("radius"), F.col("area_px"), F.col("fill_ratio")))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


# --- workbooks: the first sheet of .xlsx files as a data source ---

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet(data: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        first = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        rows = []
        for row in ET.fromstring(z.read(first)).iter(f"{_NS}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_NS}c"):
                at = 0
                for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(ch) - 64
                while at and len(cells) < at - 1:
                    cells.append(None)
                v = c.find(f"{_NS}v")
                text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
            rows.append(cells)
        return rows


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self):
        return [_File(p) for p in self.path.split(",")]

    def read(self, partition):
        with open(partition.path.removeprefix("file://").removeprefix("file:"), "rb") as f:
            header, *rows = _sheet(f.read()) or [[]]
        place = {name: k for k, name in enumerate(header)}
        convert = {IntegerType: lambda v: int(float(v)), DoubleType: float}
        for row in rows:
            cell = lambda name: row[place[name]] if name in place and place[name] < len(row) else None
            yield tuple(None if cell(f.name) in (None, "") else convert.get(type(f.dataType), str)(cell(f.name)) for f in self.schema)


class XlsxSource(DataSource):
    """format("xlsx"): label workbooks, one partition per file; a workbook is a small file in a folder all executors see."""

    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        return StructType([StructField("id", IntegerType()), StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("radius", DoubleType()), StructField("source", StringType())])

    def reader(self, schema):
        return XlsxReader(self.options["path"], schema)


# --- label files, one for each image, in folders by image as Spark names them ---

_REVIEW = {"id": "int", "x": "int", "y": "int", "radius": "int", "source": "string"}
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _seen_as_files(spark: SparkSession, path: str) -> bool:
    """Whether Spark takes the path for one of a local or mounted file system."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return path.startswith("file:") or path.startswith("/") and default.startswith("file:")


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:").rstrip("/")


def _folder(by: str, value: str | None) -> str:
    return f"{by}=" + (re.sub(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value) if value else _NO_VALUE)


class FolderWriter(DataSourceArrowWriter):
    """Rows of a folder have to lie together. A file has another name until it is whole, so that attempts of one task do not meet;
    all is written beside the path and takes its place at the end."""

    def __init__(self, path: str, by: str, header: str):
        self.path, self.by, self.header = path, by, header
        self.beside = f"{path}.{uuid.uuid4().hex}"

    def write(self, iterator):
        rows = (row for batch in iterator for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for value, group in itertools.groupby(rows, lambda row: row[0]):
            folder = f"{self.beside}/{_folder(self.by, value)}"
            os.makedirs(folder, exist_ok=True)
            part = f"{folder}/.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(f"{self.header}\n")
                f.writelines(f"{line}\n" for _, line in group)
            os.replace(part, f"{folder}/{'empty' if value == '' else 'labels'}.csv")
        return WriterCommitMessage()

    def commit(self, messages):
        os.makedirs(self.beside, exist_ok=True)
        open(f"{self.beside}/_SUCCESS", "w").close()
        shutil.rmtree(self.path, ignore_errors=True)
        os.rename(self.beside, self.path)

    def abort(self, messages):
        shutil.rmtree(self.beside, ignore_errors=True)


class _Share(InputPartition):
    def __init__(self, number: int):
        self.number = number


class FolderReader(DataSourceReader):
    """Each task lists the folders and reads those that its number falls on by a hash of their name."""

    def __init__(self, path: str, by: str, parts: int):
        self.path, self.by, self.parts = path, by, parts

    def partitions(self):
        return [_Share(k) for k in range(self.parts)]

    def read(self, partition):
        import pyarrow as pa

        with os.scandir(self.path) as entries:
            names = [e.name for e in entries if e.name.startswith(f"{self.by}=") and zlib.crc32(e.name.encode()) % self.parts == partition.number]
        for name in names:
            text = name.removeprefix(f"{self.by}=")
            value = None if text == _NO_VALUE else unquote(text)
            for file in sorted(os.listdir(f"{self.path}/{name}")):
                if file.startswith((".", "_")):
                    continue
                with open(f"{self.path}/{name}/{file}", encoding="utf-8", newline="\n") as f:
                    next(f, None)
                    while lines := [line.removesuffix("\n") for line in itertools.islice(f, 8192)]:
                        yield pa.RecordBatch.from_arrays([pa.array([value] * len(lines), pa.string()), pa.array(lines, pa.string())], ["folder", "line"])


class LabelFolders(DataSource):
    """format("label_folders"): (folder, line) of text files with a header, in folders named by the option `by` and a value; all executors see the folder."""

    @classmethod
    def name(cls):
        return "label_folders"

    def schema(self):
        return StructType([StructField("folder", StringType()), StructField("line", StringType())])

    def reader(self, schema):
        return FolderReader(_local(self.options["path"]), self.options["by"], int(self.options["parts"]))

    def writer(self, schema, overwrite):
        return FolderWriter(_local(self.options["path"]), self.options["by"], self.options["header"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)
    spark.dataSource.register(LabelFolders)
