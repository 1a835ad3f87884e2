"""What lets pixel queries grow: squares and bands decide nothing, and pixels are never broadcast, however well their files compress."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from silvaframe.operators import field, labels, raster, shape, site
from silvaframe.operators.suppress import suppress
from silvaframe.sources import io


@pytest.fixture(scope="module")
def spots(spark):
    rng = random.Random(8)
    on = {(x, y): rng.random() < 0.55 for x in range(23) for y in range(17)}
    return on, spark.createDataFrame([(1, x, y, v, (x * 37 + y * 91) % 256) for (x, y), v in on.items()], "image_id long, x int, y int, m boolean, v int")


def rows(df):
    return sorted(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


def test_squares_decide_nothing(spots, monkeypatch):
    frame = spots[1]
    work = {
        "opened": lambda: raster.opened(frame, "m", raster.ellipse(5)),
        "blurred": lambda: raster.blurred(frame, {"s": F.col("v")}, raster.BINOMIAL),
        "edges": lambda: field.edges(frame, "v"),
        "highest": lambda: field.highest(frame, "v", raster.ellipse(7), "top"),
        "contours": lambda: shape.contours(raster.components(frame, "m").select("image_id", "label", "x", "y")),
        "components": lambda: raster.components(frame, "m", diagonal=False),
    }
    whole = {k: rows(f()) for k, f in work.items()}
    monkeypatch.setattr(raster, "TILE", 6)
    monkeypatch.setattr(raster, "BAND", 3)
    monkeypatch.setattr(shape, "BAND", 4)
    assert {k: rows(f()) for k, f in work.items()} == whole


@pytest.mark.parametrize("band", [2, 256])
def test_components_of_overlapping_regions(spark, monkeypatch, band):
    """Regions that share places in one image are told apart, with null as a region of its own."""
    monkeypatch.setattr(raster, "BAND", band)
    frame = spark.createDataFrame([(1, r, x, y, True) for r in ("a", None) for x, y in ((0, 0), (1, 1), (2, 2), (2, 3), (5, 2), (5, 3), (5, 4))], "image_id long, r string, x int, y int, m boolean")
    got = raster.components(frame, "m", ("image_id", "r")).collect()
    assert {(r.r, r.label) for r in got if r.r} == {("a", 0), ("a", 2_000_005)} and len(got) == 14


def test_pixels_are_not_broadcast(spark, spots):
    """Morphology moves pixels once, without a join; pixels that meet pixels do so by a merge join."""
    frame = spots[1]
    assert "Join" not in plan(raster.opened(frame, "m", raster.ellipse(5)))
    assert "Join" not in plan(raster.components(frame, "m"))
    points = frame.where("x % 5 = 0").select("image_id", F.col("v").cast("long").alias("idx"), "x", "y")
    assert "Broadcast" not in plan(raster.label_near(points, raster.components(frame, "m")))
    colours = spark.createDataFrame([(1, x, y, 90, 120, 40 + x) for x in range(9) for y in range(9)], "image_id long, x int, y int, b int, g int, r int")
    assert "Join" not in plan(site.planes(colours))


def test_an_image_of_one_square_floods_without_rounds(spark, monkeypatch):
    frame = spark.createDataFrame([(1, x, y, (x * 7 + y * 3) % 11, {(0, 0): 4, (8, 8): 9}.get((x, y))) for x in range(9) for y in range(9)], "image_id long, x int, y int, elevation int, marker long")
    once = field.flood(frame)
    assert "Join" not in plan(once)
    whole = rows(once)
    monkeypatch.setattr(field, "TILE", 3)
    assert rows(field.flood(frame)) == whole


def test_regions_of_one_band_are_measured_in_one_pass(spark, spots, monkeypatch):
    """Their contours take one pass and no join; hulls and circles write nothing at all."""
    lab = raster.components(spots[1], "m").select("image_id", "label", "x", "y")
    staged = []
    real = shape.stage
    monkeypatch.setattr(shape, "stage", lambda df, name="stage": staged.append(name) or real(df, name))
    assert "Join" not in plan(shape.contours(lab)) and staged == ["rings"]
    circles = shape.enclosing_circles(shape.hulls(lab))
    assert staged == ["rings"] and circles.count() == lab.select("label").distinct().count()


def test_squares_decide_nothing_for_fields(spots, monkeypatch):
    """Distances, filled regions, edges and large components: known within a square, or by the way that any image can take."""
    frame = spots[1]
    work = {
        "distance": lambda: field.distance(frame, "m", size=5),
        "filled": lambda: field.filled_regions(frame, "m"),
        "edges": lambda: field.edges(frame, "v", gradients=True),
        "large": lambda: raster.without_small(frame, "m", 6),
        "crowns": lambda: field.crowns(frame, "m", 3, 1)[0],
    }
    assert "Window" not in plan(field.distance(frame, "m")) and "Join" not in plan(field.edges(frame, "v"))
    whole = {k: rows(f()) for k, f in work.items()}
    monkeypatch.setattr(raster, "TILE", 6)
    assert {k: rows(f()) for k, f in work.items()} == whole
    monkeypatch.setattr(field, "REACH", 1)
    assert {k: rows(f()) for k, f in work.items()} == whole


def test_what_holds_for_an_image_reaches_pixels_without_a_broadcast(spark):
    colours = raster.colour(spark.createDataFrame([(1, x, y, 90, 120, 40 + x) for x in range(9) for y in range(9)], "image_id long, x int, y int, b int, g int, r int"))
    assert "Broadcast" not in plan(raster.original_mask(colours)) and "Broadcast" not in plan(field.medians(colours, "v"))


def test_rows_too_far_apart_are_not_compared(spark):
    """Within a folded group the reach rules most pairs out, before a costly condition is worked out."""
    frame = spark.createDataFrame([(1, k, 100 * k + d, 0, 5) for k in range(6) for d in (0, 3)], "image_id long, idx long, x int, y int, radius int")
    near = lambda p, q: F.when(F.abs(p("x") - q("x")) < 50, True).otherwise(F.raise_error(F.lit("compared")).cast("boolean"))
    kept = suppress(frame, [F.col("x")], near, 12.0)
    assert sorted(r.x for r in kept.collect()) == [100 * k for k in range(6)]


def test_folders_by_image_cost_no_processes_and_no_listing(spark, tmp_path, monkeypatch):
    """Hadoop's local file system leaves a .crc file, made by two processes, with each file; Spark's reader lists all folders at the driver. Else both ways give the same folders and lines."""
    images = ["a/b", "x=1", "", None, "IMG 7"] + [f"p{k}" for k in range(60)]
    sources = ["manual", None, "", 'say "so", then', " \\ "]
    frame = spark.createDataFrame([(k, 90 - n, n + 0.5, n + 1.5, 8, sources[n % 5]) for k in images for n in range(7)], "image_id string, id int, x double, y double, radius int, source string").repartition(3)
    written = lambda d: sorted((f.parent.name, line) for f in Path(d).glob("*/*.csv") for line in f.read_text().splitlines() if line != "id,x,y,radius,source")
    fast, plain = str(tmp_path / "fast"), str(tmp_path / "plain")
    for _ in range(2):  # the second time replaces the first
        io.write_review(frame, f"file://{fast}")
    got = io.read_review(spark, f"file://{fast}")
    assert not list(Path(fast).rglob("*.crc")) and not got.inputFiles() and [f.name for f in tmp_path.iterdir()] == ["fast"]
    monkeypatch.setattr(io, "_seen_as_files", lambda *_: False)
    io.write_review(frame, plain)
    assert written(fast) == written(plain) and len(written(fast)) == 65 * 7
    want = io.read_review(spark, plain)
    text = lambda df: sorted(map(repr, df.collect()))
    assert text(got) == text(want) == text(spark.read.schema(got.schema).option("header", True).csv(fast).select(*got.columns))


def test_review_without_rows(spark, tmp_path):
    frame = spark.createDataFrame([], "image_id long, id int, x double, y double, radius int, source string")
    io.write_review(frame, f"file://{tmp_path}/r")
    assert io.read_review(spark, f"file://{tmp_path}/r").count() == 0


@pytest.mark.parametrize("cell", [0.7, 70.0])
def test_shapes_of_any_reach_are_hit_without_copies(spark, cell):
    """Shapes were copied to nine cells each, and hits farther than a cell away were lost: against brute force, with wide shapes, places below zero and polygons off their place."""
    rng = random.Random(5)
    clicks = [(k % 2, k, rng.randint(-300, 300), rng.randint(-300, 300)) for k in range(40)]
    shapes = [(k % 2, k, rng.randint(-300, 300), rng.randint(-300, 300), rng.choice([0, 9, 70, 350, 900])) for k in range(60)]
    square = lambda x, y, r: [(x + 200.0, y - r * 1.0), (x + 200.0 + r, y - r * 1.0), (x + 200.0 + r, y + 0.0), (x + 200.0, y + 0.0)]
    c = spark.createDataFrame(clicks, "image_id long, click long, x int, y int")
    frame = spark.createDataFrame([(*s, square(*s[2:]) if s[1] % 3 == 0 else [] if s[1] % 3 == 1 else None) for s in shapes], "image_id long, idx long, x int, y int, radius int, contour array<struct<x: double, y: double>>")
    far = lambda p, s: ((p[2] - s[2]) ** 2 + (p[3] - s[3]) ** 2) ** 0.5
    meets = lambda p, s: s[2] + 200 <= p[2] < s[2] + 200 + s[4] and s[3] - s[4] <= p[3] < s[3] if s[1] % 3 == 0 else far(p, s) <= s[4]
    hit = {p[1]: max(s[1] for s in shapes if s[0] == p[0] and meets(p, s)) for p in clicks if any(s[0] == p[0] and meets(p, s) for s in shapes)}
    close = {p[1]: min(found)[1] for p in clicks if (found := [(far(p, s), s[1]) for s in shapes if s[0] == p[0] and far(p, s) <= s[4] + 8])}
    top, near = labels.topmost(c, frame, cell), labels.nearest(c, frame, cell)
    assert {r.click: r.idx for r in top.collect()} == hit and {r.click: r.idx for r in near.collect()} == close
    assert len(hit) > 30 and "[-1,0,1]" not in plan(top) + plan(near)
