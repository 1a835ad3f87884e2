"""Morphology by windows, the site flow's gates and parsed repairs against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from silvaframe.functions import rules
from silvaframe.operators import labels, raster, site, tiles, verdicts


@pytest.mark.parametrize("kernel", [raster.square(3), raster.ellipse(5), raster.ellipse(7), raster.square(1)])
def test_morphology_equals_brute_force(spark, kernel):
    rng = random.Random(4)
    on = {(x, y): rng.random() < 0.6 for x in range(14) for y in range(11)}
    frame = spark.createDataFrame([(1, x, y, v, "k") for (x, y), v in on.items()], "image_id long, x int, y int, m boolean, other string")
    wide = {p: any(on.get((p[0] + dx, p[1] + dy), False) for dx, dy in kernel) for p in on}
    thin = {p: all(on.get((p[0] + dx, p[1] + dy), True) for dx, dy in kernel) for p in on}
    again = {p: any(thin.get((p[0] + dx, p[1] + dy), False) for dx, dy in kernel) for p in on}
    got = lambda df: {(r.x, r.y): r.m for r in df.collect()}
    assert got(raster.dilate(frame, "m", kernel)) == wide
    assert got(raster.erode(frame, "m", kernel)) == thin
    opened = raster.opened(frame, "m", kernel)
    assert got(opened) == again and opened.columns == frame.columns


def test_site_gates(spark):
    """A blue block far from the border is waste; one that touches the border, and a long one, are not."""
    colour = {}
    for x in range(60):
        for y in range(60):
            colour[x, y] = (35, 130, 65)
    for x0, y0, w, h in ((20, 20, 15, 14), (0, 40, 15, 14), (20, 50, 39, 6)):
        for x in range(x0, x0 + w):
            for y in range(y0, min(60, y0 + h)):
                colour[x, y] = (200 + (x * 37 + y * 11) % 55, 90, 60)
    frame = spark.createDataFrame([(7, x, y, *c) for (x, y), c in colour.items()], "image_id long, x int, y int, b int, g int, r int")
    limits = site.Limits(waste_share=(0.0, 0.2), cut=0.3, edge=0.0)
    found = site.waste_regions(site.planes(frame), limits).collect()
    assert [(r.x, r.y, r.w, r.h, r.place) for r in found] == [(20, 20, 15, 14, 1)]
    assert site.fire_points(site.planes(frame), limits).collect() == []
    trees = spark.createDataFrame([(7, 1, 5, 5, 2, "a"), (7, 2, 50, 50, 0, "b"), (7, 3, 8, 5, 2, "b")], "image_id long, idx long, cx int, cy int, radius int, species string")
    row = site.summary(site.planes(frame), trees, 4).first()
    disc = lambda cx, cy, r: {(x, y) for x in range(60) for y in range(60) if (x - cx) ** 2 + (y - cy) ** 2 <= r * r}
    under = disc(5, 5, 2) | disc(50, 50, 1) | disc(8, 5, 2)
    assert row.tree_count == 3 and row.dominant_species == "b" and row.canopy_cover_pct == round(len(under) / 36, 2)


def test_actions_are_parsed_or_left_out(spark):
    texts = [
        'Sure:\n```json\n{"keep": [{"id": 1, "confidence": "90"}], "reject": "none", "add": [{"x": 2.5, "y": "3", "radius": 7}]}\n```',
        '{"adjust": [{"id": "4", "x": 1, "y": 1, "radius": 9, "confidence": 55.5}, {"id": "four"}]}',
        "[]",
        "no answer",
        None,
        '{"keep": [{"id": 1',
    ]
    frame = spark.createDataFrame([(1, 0, k, t) for k, t in enumerate(texts)], "image_id long, tile_idx int, answer long, response_text string")
    got = sorted((r.kind, r.det_no, r.x, r.y, r.radius, r.confidence) for r in verdicts.parse_actions(frame).collect())
    assert got == [("add", -1, 2, 3, 7, 0), ("adjust", -1, -1, -1, 0, 0), ("adjust", 4, 1, 1, 9, 56), ("keep", 1, -1, -1, 0, 90)]


def test_whole_numbers(spark):
    frame = spark.createDataFrame([(x,) for x in ("2.5", "3.5", "-1.5", " 7 ", "", "x", "NaN", "Infinity", None)], "t string")
    assert [r[0] for r in frame.select(rules.whole_number(F.col("t"), 9)).collect()] == [2, 4, -2, 7, 9, 9, 9, 9, 9]


def test_an_image_without_labels_is_an_error_if_asked_for(spark):
    images = spark.createDataFrame([(1, "a", 700, 600), (2, "b", 700, 600)], "image_id long, stem string, width int, height int")
    some = spark.createDataFrame([(1, 1, 50, 50, 9)], "image_id long, idx long, x int, y int, radius int")
    assert tiles.dataset(images, some).count() == 1
    with pytest.raises(Exception, match="no labels for image b"):
        tiles.dataset(images, some, need_labels=True, include_empty=True).collect()


def test_images_of_labels(spark):
    f = lambda rows: spark.createDataFrame(rows, "stem string, path string")
    out = labels.image_of_label(f([("a", "l/a"), ("b", "l/b"), ("c", "l/c")]), f([("a", "d/a")]), f([("a", "r/a"), ("b", "r/b"), ("b", "r/b2")])).collect()
    assert {tuple(r) for r in out} == {("a", "l/a", "d/a"), ("b", "l/b", "r/b")}


def test_prompts(spark):
    cut = spark.createDataFrame([(1, 0, 10, 20, '[{"id":1}]')], "image_id long, tile_idx int, tw int, th int, candidates string")
    prompt = verdicts.prompts(cut, "{width}x{height}: {candidates}").first().prompt
    assert prompt.split(": ", 1)[0] == "10x20" and json.loads(prompt.split(": ", 1)[1]) == [{"id": 1}]
