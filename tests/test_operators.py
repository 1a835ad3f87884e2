"""Properties and borders of the operators, sources, sinks and the stream."""

import math
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from silvaframe.functions import conflicts, geometry, rules
from silvaframe.operators import calls, labels, raster, tiles, verdicts
from silvaframe.operators.spatial import box_reach, widest
from silvaframe.operators.suppress import renumber, suppress
from silvaframe.sources import io as sio
from silvaframe.streaming import frames


def crowns(spark, n=400, images=3, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(images), i, rng.randrange(200), rng.randrange(200), rng.randint(5, 40), rng.random(), rng.choice(["reference", "recall", "peak"])) for i in range(n)]
    return spark.createDataFrame(rows, "image_id long, idx long, x int, y int, radius int, conf double, source string")


RULES = {"overlap": conflicts.overlap(0.5), "pool": conflicts.pool(), "dense": conflicts.dense(), "same": conflicts.same_circle(5.0, 0.45, 0.58), "near": conflicts.proximity()}


@pytest.mark.parametrize("name", RULES)
def test_fold_and_fixpoint_agree(spark, name):
    c = crowns(spark)
    rank, cell = [-F.col("conf"), F.col("idx")], widest(c, 2.0, 10)
    keep = lambda how: sorted((r.image_id, r.idx) for r in suppress(c, rank, RULES[name], cell, strategy=how).collect())
    assert keep("fold") == keep("fixpoint") and 0 < len(keep("fold")) < 400


@pytest.mark.parametrize("cell", [30.0, 200.0, 5000.0])
def test_cells_decide_nothing(spark, cell):
    """Wide circles, an outlier as wide as many images and circles of no radius: any cell gives what the fold gives."""
    rng = random.Random(9)
    rows = [(0, i, rng.randrange(300), rng.randrange(300), rng.choice([0, 1, 6, 20, 60]), rng.random(), "peak") for i in range(60)] + [(0, 100, 50, 50, 600, 0.9, "peak"), (0, 101, 280, 50, 600, 0.8, "peak"), (0, 102, -2000, 40, 1500, 0.7, "peak")]
    c = spark.createDataFrame(rows, "image_id long, idx long, x int, y int, radius int, conf double, source string")
    rank = [-F.col("conf"), F.col("idx")]
    for name in ("overlap", "pool", "near") if cell == 30 else ("pool",):
        keep = lambda how: sorted(r.idx for r in suppress(c, rank, RULES[name], cell, strategy=how).collect())
        assert keep("fold") == keep("fixpoint")
    boxed = c.where("radius > 0").select("*", *[F.expr(e) for e in ("x - 3 * radius as x1", "x + radius as x2", "y - radius as y1", "y + 2 * radius as y2")])
    keep = lambda how: sorted(r.idx for r in suppress(boxed, rank, conflicts.boxes(), cell, strategy=how, reach=box_reach).collect())
    assert keep("fold") == keep("fixpoint")


def test_suppression_is_independent_and_maximal(spark):
    c = crowns(spark, 200)
    rank, cell, rule = [-F.col("conf"), F.col("idx")], widest(c, 2.0, 10), conflicts.overlap(0.4)
    kept = {(r.image_id, r.idx): r for r in suppress(c, rank, rule, cell).collect()}

    def lens(p, q):
        d, a, b = math.hypot(p.x - q.x, p.y - q.y), p.radius, q.radius
        if d >= a + b:
            return 0.0
        if d <= abs(a - b):
            return math.pi * min(a, b) ** 2
        cos = lambda r, s: max(-1.0, min(1.0, (d * d + r * r - s * s) / (2 * d * r)))
        return a * a * math.acos(cos(a, b)) + b * b * math.acos(cos(b, a)) - 0.5 * math.sqrt(max(0.0, (-d + a + b) * (d + a - b) * (d - a + b) * (d + a + b)))

    hit = lambda p, q: lens(p, q) >= 0.4 * math.pi * min(p.radius, q.radius) ** 2
    want = {}
    for r in sorted(c.collect(), key=lambda r: (-r.conf, r.idx)):
        if not any(k[0] == r.image_id and hit(r, q) for k, q in want.items()):
            want[(r.image_id, r.idx)] = r
    assert set(kept) == set(want)


def test_suppression_of_nothing(spark):
    c = crowns(spark, 1).where("false")
    for how in ("auto", "fold", "fixpoint"):
        assert suppress(c, [F.col("idx")], conflicts.overlap(0.5), 10.0, strategy=how).count() == 0


def test_renumber_is_a_permutation(spark):
    rows = renumber(crowns(spark)).orderBy("image_id", "id").collect()
    for k in {r.image_id for r in rows}:
        own = [r for r in rows if r.image_id == k]
        assert [r.id for r in own] == list(range(1, len(own) + 1)) and [(r.y, r.x) for r in own] == sorted((r.y, r.x) for r in own)


def test_lens_area_borders(spark):
    df = spark.createDataFrame([(5.0, 5.0, 10.0), (5.0, 5.0, 9.999999), (5.0, 2.0, 3.0), (5.0, 5.0, 0.0), (1e-9, 5.0, 5.0)], "a double, b double, d double")
    v = [r[0] for r in df.select(geometry.lens_area(F.col("a"), F.col("b"), F.col("d"))).collect()]
    assert v[0] == 0 and 0 < v[1] < 1e-6 and v[2] == math.pi * 4 and v[3] == math.pi * 25 and abs(v[4]) < 1e-6


@pytest.mark.parametrize("size,overlap", [(640, 0.2), (100, 0.0), (64, 0.5), (7, 0.9)])
def test_tiles_cover_the_image(spark, size, overlap):
    images = spark.createDataFrame([(1, 500, 400), (2, 1281, 640), (3, 3, 5)], "image_id long, width int, height int")
    by = {}
    for r in tiles.generate_tiles(images, size, overlap).collect():
        by.setdefault(r.image_id, []).append(r)
    for i, w, h in ((1, 500, 400), (2, 1281, 640), (3, 3, 5)):
        t = sorted(by[i], key=lambda r: r.tile_idx)
        assert [r.tile_idx for r in t] == list(range(len(t))) and [(r.ty, r.tx) for r in t] == sorted({(r.ty, r.tx) for r in t})
        for at, length, n in (("tx", "tw", w), ("ty", "th", h)):
            covered = {p for r in t for p in range(getattr(r, at), getattr(r, at) + getattr(r, length))}
            assert covered == set(range(n))


@pytest.mark.parametrize("radius,area,fill,want", [(13, 9e9, 0.9, "shrub"), (14, 359.9, 0.9, "shrub"), (14, 360.0, 0.29, "sparse"), (14, 360.0, 0.0, "common"), (33, 1799.9, 0.3, "common"), (34, 360.0, 0.3, "mature"), (14, 1800.0, 0.3, "mature"), (None, None, None, "common")])
def test_crown_class_borders(spark, radius, area, fill, want):
    df = spark.createDataFrame([("recall", radius, area, fill)], "source string, radius int, area double, fill double")
    assert df.select(rules.crown_class(*[F.col(c) for c in df.columns])).first()[0] == rules.SPECIES[want]
    assert df.select(rules.crown_class(F.lit("dark"), *[F.col(c) for c in df.columns[1:]])).first()[0] == rules.SPECIES["dark"]


def test_verdict_fuzz(spark):
    answers = [
        (1, 1, 'so: ```json\n[{"id": 1, "is_tree": "no", "species": "", "confidence": "81.5"}]\n``` done'),
        (1, 2, '[{"id": "2", "is_tree": 0, "confidence": -4}, {"id": 2, "is_tree": true, "species": "oak", "confidence": 101}]'),
        (1, 3, '[{"id": 3, "is_tree": tr'),
        (1, 4, None),
        (1, 5, '[{"id": "x"}, {"is_tree": false}, {"id": 5, "confidence": "inf", "is_tree": "maybe"}]'),
        (1, 6, "no json here"),
    ]
    out = {r.id: r for r in verdicts.parse(spark.createDataFrame(answers, "image_id long, id long, response_text string")).collect()}
    assert set(out) == {1, 2, 5}
    assert (out[1].is_tree, out[1].species, out[1].llm_confidence) == (False, rules.UNKNOWN_SPECIES, 82)
    assert (out[2].is_tree, out[2].species, out[2].llm_confidence) == (True, "oak", 100)
    assert (out[5].is_tree, out[5].llm_confidence) == (True, 0)


def test_decisions_at_their_borders(spark):
    df = spark.createDataFrame([(True, 49), (True, 50), (False, 69), (False, 70)], "t boolean, c int")
    named = lambda cons: [r[0] for r in df.select(verdicts.decide(F.col("t"), F.col("c"), 50, 70, cons)).collect()]
    assert named(True) == ["kept_low_confidence_tree", "verified_tree", "kept_uncertain_non_tree", "rejected_non_tree"]
    assert named(False)[2:] == ["rejected_non_tree"] * 2


def picture(spark, rows):
    return spark.createDataFrame([(1, x, y, ch == "#") for y, row in enumerate(rows) for x, ch in enumerate(row)], "image_id long, x int, y int, m boolean")


def drawn(df, w, h):
    on = {(r.x, r.y) for r in df.where("m").collect()}
    return ["".join("#" if (x, y) in on else "." for x in range(w)) for y in range(h)]


def test_morphology(spark):
    speckle = ["....#", ".....", "###..", "###..", "###.."]
    p = picture(spark, speckle)
    assert drawn(raster.opened(p, "m", raster.square(3)), 5, 5) == [".....", ".....", "###..", "###..", "###.."]
    hole = ["#####", "##.##", "#####"]
    assert drawn(raster.closed(picture(spark, hole), "m", raster.square(3)), 5, 3) == ["#####"] * 3
    assert drawn(raster.dilate(picture(spark, ["...", ".#.", "..."]), "m", raster.ellipse(3)), 3, 3) == [".#.", "###", ".#."]


def test_components_of_shapes(spark):
    rows = ["#..#.###", ".##..#.#", "....#..#", "#.#.#...", ".#...###"]
    p = picture(spark, rows)
    out = raster.components(p, "m").collect()
    on = {(x, y) for y, row in enumerate(rows) for x, ch in enumerate(row) if ch == "#"}
    label = {}
    for start in sorted(on, key=lambda q: (q[1], q[0])):
        todo = [start] if start not in label else []
        while todo:
            q = todo.pop()
            if q in on and q not in label:
                label[q] = start[1] * 1_000_000 + start[0]
                todo += [(q[0] + dx, q[1] + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    assert {(r.x, r.y): r.label for r in out} == label
    assert raster.components(picture(spark, ["..."]), "m").count() == 0


def test_otsu_of_a_flat_image(spark):
    flat = spark.createDataFrame([(1, x, 0, 7) for x in range(9)], "image_id long, x int, y int, exg int")
    assert [tuple(r) for r in raster.otsu(flat).collect()] == [(1, 0)]


def test_edits(spark):
    start = spark.createDataFrame([(1, 1, 5, 5, 10, "loaded"), (1, 2, 6, 6, 3, "loaded")], "image_id long, label_no long, x int, y int, radius int, source string")
    log = [(1, 0, 1, "radius", 0, 0, 200), (1, 1, 1, "radius", 0, 0, -1), (1, 2, 2, "radius", 0, 0, -9), (1, 3, 2, "move", 999, -5, 0), (1, 4, 3, "move", 1, 1, 0), (1, 5, 4, "add", 3, 4, 0), (1, 6, 4, "delete", 0, 0, 0), (1, 7, 4, "radius", 0, 0, 1)]
    edits = spark.createDataFrame(log, "image_id long, seq long, label_no long, op string, x int, y int, delta int")
    assert sorted(tuple(r) for r in labels.apply_edits(start, edits, 640, 480).collect()) == [(1, 1, 5, 5, 159, "loaded"), (1, 2, 640, 0, 2, "loaded")]


def test_paired_lists_have_to_match(spark):
    images = spark.createDataFrame([("b",), ("a",)], "stem string")
    files = spark.createDataFrame([("1.csv",), ("2.csv",)], "path string")
    assert sorted(map(tuple, labels.paired_by_position(images, files).collect())) == [("a", "1.csv"), ("b", "2.csv")]
    with pytest.raises(Exception, match="differ in length"):
        labels.paired_by_position(images, files.limit(1)).collect()


def png(path, width, height, colour):
    raw = b"".join(b"\0" + bytes(colour) * width for _ in range(height))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    png(tmp_path / "a.png", 4, 3, (10, 200, 30))
    (tmp_path / "notes.txt").write_text("x")
    assert [r.stem for r in sio.list_images(spark, [str(tmp_path)]).collect()] == ["a"]
    pixels = sio.to_pixels(sio.read_images(spark, str(tmp_path / "a.png"))).collect()
    assert len(pixels) == 12 and {(r.b, r.g, r.r) for r in pixels} == {(30, 200, 10)} and {(r.x, r.y) for r in pixels} == {(x, y) for x in range(4) for y in range(3)}


def test_label_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("﻿id,x,y,radius,source\n1,5,6,7,manual\n2,1,2,0,recall\n3,x,2,4,\n", encoding="utf-8")
    assert sorted(r.radius for r in sio.read_labels(spark, str(tmp_path / "l.csv")).collect()) == [4.0, 7.0]
    review = sio.read_labels_for_review(spark, str(tmp_path / "l.csv")).collect()
    assert [(r.id, r.source) for r in review] == [(1, "manual"), (2, "recall"), (3, "loaded")]
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="radius"):
        sio.read_labels(spark, str(tmp_path / "bad.csv"))


def test_workbooks(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>radius</t></is></c></row><row><c r="A2"><v>5</v></c><c r="B2"><v>6.5</v></c><c r="D2"><v>7</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "l.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>x</t></si><si><t>y</t></si></sst>')
    sio.register(spark)
    assert [tuple(r) for r in sio.read_labels(spark, str(tmp_path / "l.xlsx")).collect()] == [(5.0, 6.5, 7.0)]


def test_sinks(spark, tmp_path):
    images = spark.createDataFrame([(1, "IMG", 100, 80)], "image_id long, stem string, width int, height int")
    marks = spark.createDataFrame([(1, 0, 50, 40, 10), (1, 1, 0, 0, 30)], "image_id long, idx long, x int, y int, radius int")
    data = tiles.dataset(images, marks)
    sio.write_label_set(data, str(tmp_path / "set"))
    text = spark.read.text(str(tmp_path / "set")).collect()
    assert [(r.value, r.tile) for r in text] == [("0 0.500000 0.500000 0.200000 0.250000", "IMG_0_0_100x80")]
    sio.write_manifest(labels.manifest(images, marks), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().total_trees == 2
    sio.write_detections(marks, str(tmp_path / "d"), "idx")
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    sio.write_review(marks.withColumn("id", F.col("idx")).withColumn("source", F.lit("manual")), str(tmp_path / "r"))
    assert sorted(r.id for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()) == ["1", "2"]


def test_frames_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, x, y, 20, 150 if x < 5 else 60, 30) for x in range(10) for y in range(4)], "image_id long, x int, y int, b int, g int, r int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    pixels = lambda: frames.frame_pixels(spark, str(tmp_path / "in"), per_batch=2)
    frames.run(pixels(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    frames.run(pixels(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()  # nothing new: nothing is done again
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    want = frames.frame_cover(spark.read.parquet(str(tmp_path / "in"))).groupBy("image_id").agg(F.count_if("vegetation").alias("v")).collect()
    assert sorted((r.image_id, r.vegetation) for r in out) == sorted((r.image_id, r.v) for r in want) and all(r.pixels == 40 for r in out)


def test_frames_of_images_stream(spark, tmp_path):
    """PNG frames in, counts per frame out; a restart repeats nothing and takes what is new."""
    (tmp_path / "in").mkdir()
    green, soil = (40, 160, 60), (150, 120, 100)
    for k in range(3):
        png(tmp_path / "in" / f"f{k}.png", 6 + k, 4, green if k % 2 else soil)
    (tmp_path / "in" / "broken.png").write_bytes(b"no image")
    files = lambda: frames.frame_files(spark, str(tmp_path / "in"), per_batch=2)
    counts = lambda: sorted((r.image_id, r.pixels, r.vegetation) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = [("f0", 24, 0), ("f1", 28, 28), ("f2", 32, 0)]
    for _ in range(2):
        frames.run_images(files(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert counts() == want
    png(tmp_path / "in" / "f3.png", 2, 2, green)
    frames.run_images(files(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert counts() == [*want, ("f3", 4, 4)]


def test_each_request_is_answered_once(spark, tmp_path):
    """A model that fails at random: attempts are counted, waits grow, and a second run asks nobody."""
    asked, waits = tmp_path / "asked", []
    asked.mkdir()

    def model(request, attempt):
        (asked / f"{request}-{attempt}-{random.random()}").write_text("")
        if zlib.crc32(f"{request}:{attempt}".encode()) % 3 == 0 or request == "q13":
            raise ConnectionError("busy")
        return request.upper()

    requests = spark.createDataFrame([(i, f"q{i}", "x") for i in range(40)] + [(3, "q3", "again"), (None, "q", "x"), (77, None, "x")], "key long, request string, note string")
    run = lambda m: calls.answered(requests, m, str(tmp_path / "ledger"), parallel=3, pause=waits.append)
    first = {(r.key, r.note): r for r in run(model).collect()}
    fails = lambda i, k: i == 13 or zlib.crc32(f"q{i}:{k}".encode()) % 3 == 0
    for i in range(40):
        tries = next((k for k in (1, 2, 3) if not fails(i, k)), None)
        r = first[i, "x"]
        assert (r.answer, r.attempts, r.error is None) == ((f"Q{i}", tries, True) if tries else (None, 3, False))
    assert first[3, "again"].answer == first[3, "x"].answer and first[77, "x"].answer is None and first[77, "x"].attempts == first[None, "x"].attempts == 0
    assert len(list(asked.iterdir())) == sum(r.attempts for k, r in first.items() if k[1] == "x") and waits == [1.0, 2.0]

    def never(request, attempt):
        raise AssertionError("asked again")

    assert sorted(map(str, run(never).collect())) == sorted(map(str, first.values()))
    with pytest.raises(ValueError, match="answer"):
        calls.answered(requests.withColumn("Answer", F.lit(1)), model, str(tmp_path / "other"))
    assert calls.answered(requests.limit(0), model, str(tmp_path / "none")).count() == 0
