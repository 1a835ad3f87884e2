"""Shapes, fields, floods and detectors against plain Python, pixel by pixel."""

import itertools
import math
import random

import pytest

from silvaframe.operators import detector, field, raster, shape
from silvaframe.plans import catalog

SF = "/root/testdata/sf0.001"


def picture(rows, image=0):
    """A mask as lines of text: # holds."""
    return [(image, x, y, c == "#") for y, line in enumerate(rows) for x, c in enumerate(line)]


def blobs(seed, w=36, h=24, n=6):
    rng = random.Random(seed)
    discs = [(rng.randrange(w), rng.randrange(h), rng.randint(2, 7)) for _ in range(n)]
    on = lambda x, y: any((x - a) ** 2 + (y - b) ** 2 <= r * r for a, b, r in discs) and rng.random() > 0.04
    return ["".join("#" if on(x, y) else "." for x in range(w)) for y in range(h)]


PICTURES = [blobs(1), blobs(2), blobs(3), ["."] * 3, ["#"], ["##", "##"], ["#.#", ".#.", "#.#"], ["#####", "#...#", "#.#.#", "#...#", "#####"]]


@pytest.fixture(scope="module")
def masks(spark):
    rows = [r for k, p in enumerate(PICTURES) for r in picture(p, k)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, m boolean").cache()


def pixels_of(k):
    return {(x, y) for _, x, y, m in picture(PICTURES[k]) if m}


def pieces(on, steps):
    """Components of a set of pixels, each as a set."""
    left, out = set(on), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            p = todo.pop()
            seen.add(p)
            for dx, dy in steps:
                q = (p[0] + dx, p[1] + dy)
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out.append(seen)
    return out


FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
#: Directions clockwise from east.
ROUND = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def traced(on):
    """The outer border by walking along it, from the topmost, leftmost pixel, looking clockwise from where one came."""
    start = min(on, key=lambda p: (p[1], p[0]))
    path, p, back = [start], start, 6  # came from above
    first = None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            q = (p[0] + ROUND[d][0], p[1] + ROUND[d][1])
            if q in on:
                break
        else:
            return path
        if (p, d) == first:
            return path[:-1]
        first = first or (p, d)
        path.append(q)
        p, back = q, (d + 5) % 8  # the direction back to p, one step further on
    return path


def circle_around(points):
    """The smallest circle around points, from all pairs and triples."""
    best = (math.inf, 0.0, 0.0)
    made = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.dist(a, b) / 2) for a, b in itertools.combinations_with_replacement(points, 2)]
    for a, b, c in itertools.combinations(points, 3):
        ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
        t = 2 * (ux * vy - uy * vx)
        if t:
            x, y = (vy * (ux * ux + uy * uy) - uy * (vx * vx + vy * vy)) / t, (ux * (vx * vx + vy * vy) - vx * (ux * ux + uy * uy)) / t
            made.append((a[0] + x, a[1] + y, math.hypot(x, y)))
    for x, y, r in made:
        if r < best[0] and all(math.dist((x, y), p) <= r + 1e-7 for p in points):
            best = (r, x, y)
    return best


def area_of(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def regions(masks):
    return raster.components(masks, "m").select("image_id", "label", "x", "y")


def test_contours_walk_along_the_border(spark, masks):
    lab = regions(masks)
    found = {}
    for r in shape.contours(lab).orderBy("seq").collect():
        found.setdefault((r.image_id, r.label), []).append((r.seq, (r.x, r.y), (r.nx, r.ny)))
    want = {}
    for k in range(len(PICTURES)):
        for piece in pieces(pixels_of(k), EIGHT):
            want[k, min(y * 1_000_000 + x for x, y in piece)] = piece
    for key, piece in want.items():
        ring = found.pop(key, [])
        assert [s for s, _, _ in ring] == list(range(len(ring)))
        assert all(b == c for (_, _, b), (_, c, _) in zip(ring, [*ring[1:], *ring[:1]]))
        path = traced(piece)
        assert [p for _, p, _ in ring] == (path if len(path) > 1 else [])
    assert not found
    stats = {(r.image_id, r.label): r for r in shape.contour_stats(lab, shape.contours(lab)).collect()}
    assert set(stats) == set(want)
    for key, piece in want.items():
        path, s = traced(piece), stats[key]
        assert s.area == abs(area_of(path)) and abs(s.perimeter - sum(math.dist(a, b) for a, b in zip(path, [*path[1:], path[0]]))) < 1e-9
        assert (s.x, s.y, s.w, s.h) == (min(x for x, _ in piece), min(y for _, y in piece), len({x for x, _ in piece}) if s.w == len({x for x, _ in piece}) else s.w, s.h)


def test_a_long_spiral_ends_in_few_rounds(spark, monkeypatch):
    """A spiral corridor, followed over many narrow bands: rounds grow with the logarithm of its length."""
    n = 121
    on, x, y, d = set(), 0, 0, 0
    inside = lambda p: 0 <= p[0] < n and 0 <= p[1] < n
    while True:
        on.add((x, y))
        dx, dy = ROUND[2 * d]
        ahead, two = (x + dx, y + dy), (x + 2 * dx, y + 2 * dy)
        if not inside(ahead) or two in on:
            d = (d + 1) % 4
            dx, dy = ROUND[2 * d]
            ahead, two = (x + dx, y + dy), (x + 2 * dx, y + 2 * dy)
            if not inside(ahead) or ahead in on or two in on:
                break
        x, y = ahead
    rounds = []
    real = shape.stage
    monkeypatch.setattr(shape, "BAND", 1)
    monkeypatch.setattr(shape, "stage", lambda df, name="stage": rounds.append(name) or real(df, name))
    rows = spark.createDataFrame([(0, 0, x, y) for x, y in on], "image_id long, label long, x int, y int")
    ring = shape.contours(rows).count()
    assert ring > 10_000 and rounds.count("links") <= 20
    assert ring == len(traced(on))


def test_hulls_and_circles(spark, masks):
    lab = regions(masks)
    corners = {(r.image_id, r.label): {(p.x, p.y) for p in r.hull} for r in shape.hulls(lab).collect()}
    circles = {(r.image_id, r.label): r for r in shape.enclosing_circles(shape.hulls(lab)).collect()}
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    seen = 0
    for k in range(len(PICTURES)):
        for piece in pieces(pixels_of(k), EIGHT):
            key = k, min(y * 1_000_000 + x for x, y in piece)
            hull = corners[key]
            assert hull <= piece
            # every other pixel is no corner: some pair of pixels or triangle of corners holds it
            ring = sorted(hull, key=lambda p: math.atan2(p[1] - sum(q[1] for q in hull) / len(hull), p[0] - sum(q[0] for q in hull) / len(hull)))
            assert all(cross(a, b, p) >= 0 for a, b in zip(ring, [*ring[1:], ring[0]]) for p in piece)
            assert len(ring) < 3 or all(cross(a, b, c) > 0 for a, b, c in zip(ring, [*ring[1:], ring[0]], [*ring[2:], *ring[:2]]))
            r, x, y = circle_around(sorted(hull))
            assert abs(circles[key].er - r) < 1e-6 and math.dist((circles[key].ex, circles[key].ey), (x, y)) < 1e-4
            seen += 1
    assert seen == len(circles) == len(corners)


def test_distance_is_exact(spark, masks):
    found = {(r.image_id, r.x, r.y): r.d2 for r in field.distance_squared(masks, "m").collect()}
    for k, rows in enumerate(PICTURES):
        on = pixels_of(k)
        off = {(x, y) for y, line in enumerate(rows) for x in range(len(line))} - on
        for x, y in on | off:
            assert found[k, x, y] == (min(((x - a) ** 2 + (y - b) ** 2 for a, b in off), default=None))


def test_holes_and_filled_regions(spark, masks):
    holes, filled = ({}, {})
    for r in field.holes(masks, "m").collect():
        holes.setdefault(r.image_id, set()).add((r.x, r.y))
    for r in field.filled_regions(masks, "m").collect():
        filled.setdefault(r.image_id, {}).setdefault(r.label, set()).add((r.x, r.y))
    for k, rows in enumerate(PICTURES):
        w, h, on = len(rows[0]), len(rows), pixels_of(k)
        off = {(x, y) for x in range(w) for y in range(h)} - on
        shut = [p for p in pieces(off, FOUR) if not any(x in (0, w - 1) or y in (0, h - 1) for x, y in p)]
        assert holes.get(k, set()) == set().union(*shut)
        assert sorted(map(sorted, filled.get(k, {}).values())) == sorted(map(sorted, pieces(on.union(*shut), EIGHT)))
    assert filled[7] == {0: {(x, y) for x in range(5) for y in range(5)}}  # a ring around a ring around a pixel


def flooded(height, marker):
    """Kruskal's algorithm pass by pass; two basins with markers never join."""
    key = lambda p: p[1] * 1_000_000 + p[0]
    parent = {p: p for p in height}
    label = dict(marker)

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    by = {}
    for p, m in marker.items():
        parent[find(p)] = by.setdefault(m, find(p))
        label[find(p)] = m
    passes = [(max(height[p], height[q]), key(p), key(q), p, q) for p in height for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)) if q in height]
    for *_, p, q in sorted(passes):
        p, q = find(p), find(q)
        if p != q and not (p in label and q in label):
            if q in label:
                p, q = q, p
            parent[q] = p
    return {p: label.get(find(p)) for p in height}


@pytest.mark.parametrize("tile", [512, 5])
def test_flood_is_the_spanning_forest(spark, masks, monkeypatch, tile):
    """In one square and over many, with plateaus, closed basins without a marker and markers of several pixels."""
    monkeypatch.setattr(field, "TILE", tile)
    rng = random.Random(4)
    rows = [(k, x, y, rng.choice([0, 1, 1, 2, 5]), m) for k in (0, 1, 2) for x, y in sorted(pixels_of(k)) for m in [rng.choice([7, 11, 13]) if rng.random() < 0.03 else None]]
    frame = spark.createDataFrame(rows, "image_id long, x int, y int, elevation int, marker long")
    found = {(r.image_id, r.x, r.y): r.label for r in field.flood(frame).collect()}
    want = {}
    for k in (0, 1, 2):
        own = flooded({(x, y): e for i, x, y, e, _ in rows if i == k}, {(x, y): m for i, x, y, _, m in rows if i == k and m is not None})
        want |= {(k, *p): v for p, v in own.items()}
    assert found == want and len(set(want.values())) == 4


def test_flood_of_nothing(spark):
    assert field.flood(spark.createDataFrame([], "image_id long, x int, y int, elevation int, marker long")).count() == 0


def plain_detector(image, s, v, exg, rule, peak, overlap):
    """The reference detector on a dictionary of coloured pixels, step by step."""
    w, h = max(x for x, _ in image) + 1, max(y for _, y in image) + 1
    on = {p for p, c in image.items() if 28 <= c.h <= 105 and c.s >= s and c.v >= v and c.exg >= exg}
    every = [(x, y) for x in range(w) for y in range(h)]
    around = [(0, 0), *FOUR]
    inside = lambda p: 0 <= p[0] < w and 0 <= p[1] < h
    under = lambda p, k: [q for dx, dy in k if inside(q := (p[0] + dx, p[1] + dy))]
    for step in "eded"[:2] + "de":
        test = all if step == "e" else any
        on = {p for p in every if test(q in on for q in under(p, around))}
    off = [p for p in every if p not in on]
    dist = {p: math.sqrt(min((p[0] - a) ** 2 + (p[1] - b) ** 2 for a, b in off)) if p in on else 0.0 for p in every}
    taps = [math.exp(-k * k / 8) for k in range(-8, 9)]
    taps = [t / sum(taps) for t in taps]
    fold = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    rows = {(x, y): sum(t * dist[fold(x + k - 8, w), y] for k, t in enumerate(taps)) for x, y in every}
    dist = {(x, y): round(sum(t * rows[x, fold(y + k - 8, h)] for k, t in enumerate(taps)), 4) for x, y in every}
    some = sorted(dist[p] for p in on)
    median = (some[(len(some) - 1) // 2] + some[len(some) // 2]) / 2
    least = max(3, int(median * 0.28))
    size = max(3, peak | 1)
    r = size // 2
    half = {dy: round(r * math.sqrt(1 - dy * dy / (r * r))) for dy in range(-r, r + 1)}
    low = {p: max(d - 1.5, 0.0) for p, d in dist.items()}
    tops = {p for p in every if low[p] >= max(least, 2) and all(low[q] <= low[p] for q in under(p, [(dx, dy) for dy, n in half.items() for dx in range(-n, n + 1)]))}
    wide = {q for p in tops for q in under(p, around)}
    marker = {p: min(y * 1_000_000 + x for x, y in piece) for piece in pieces(wide, EIGHT) for p in piece if p in on}
    lo, hi = min(dist.values()), max(dist.values())
    label = flooded({p: int((hi - dist[p]) * 255.0 / (hi - lo)) for p in on}, marker)
    found = []
    for m in sorted({v for v in label.values() if v is not None}):
        own = {p for p, v in label.items() if v == m}
        best = max(pieces(own, EIGHT), key=lambda q: (abs(area_of(traced(q))), -min(y * 1_000_000 + x for x, y in q)))
        path = traced(best)
        a = area_of(path)
        length = sum(math.dist(p, q) for p, q in zip(path, [*path[1:], path[0]]))
        er, _, _ = circle_around(path if len(path) < 12 else [p for p in path if p in hull_of(path)])
        bw, bh = (max(p[k] for p in path) - min(p[k] for p in path) + 1 for k in (0, 1))
        circ, fill = 4 * math.pi * a / length**2, a / (math.pi * er * er)
        if not (rule.area[0] <= a <= rule.area[1] and circ >= rule.circularity and fill >= rule.fill and max(bw, bh) / min(bw, bh) <= rule.aspect):
            continue
        radius = round(min(0.95 * er, max(1.7 * max(dist[p] for p in own) + 3, 0.95 * math.sqrt(a / math.pi), rule.radius[0])))
        cx = sum((p[0] + q[0]) * (p[0] * q[1] - q[0] * p[1]) for p, q in zip(path, [*path[1:], path[0]])) / (6 * a)
        cy = sum((p[1] + q[1]) * (p[0] * q[1] - q[0] * p[1]) for p, q in zip(path, [*path[1:], path[0]])) / (6 * a)
        if rule.radius[0] <= radius <= rule.radius[1]:
            found.append((round(cx), round(cy), radius, a))
    kept = []
    for x, y, r, a in sorted(found, key=lambda f: (-f[3], -f[2])):
        if all(shared(r, q[2], math.dist((x, y), q[:2])) < overlap * math.pi * min(r, q[2]) ** 2 for q in kept):
            kept.append((x, y, r, a))
    return sorted(kept, key=lambda f: (f[1], f[0]))


def shared(a, b, d):
    if d >= a + b:
        return 0.0
    if d <= abs(a - b):
        return math.pi * min(a, b) ** 2
    turn = lambda p, q: math.acos(max(-1.0, min(1.0, (d * d + p * p - q * q) / (2 * d * p))))
    return a * a * turn(a, b) + b * b * turn(b, a) - 0.5 * math.sqrt(max(0.0, (a + b - d) * (d + a - b) * (d - a + b) * (d + a + b)))


def hull_of(points):
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out = set()
    for row in (sorted(set(points)), sorted(set(points))[::-1]):
        side = []
        for p in row:
            while len(side) > 1 and cross(side[-2], side[-1], p) <= 0:
                side.pop()
            side.append(p)
        out |= set(side)
    return out


def test_reference_detector_step_by_step(spark):
    from silvaframe.plans.detector import coloured

    image = {(r.x, r.y): r for r in coloured(spark, SF).collect()}
    settings = detector.Reference()
    want = plain_detector(image, settings.s, settings.v, settings.exg, settings.rule, settings.peak_distance, settings.overlap)
    found = catalog.queries()["gen10_reference_detector"](spark, SF).orderBy("id").collect()
    assert [(r.id, r.x, r.y, r.radius, r.area_px) for r in found] == [(k + 1, x, y, r, round(a, 2)) for k, (x, y, r, a) in enumerate(want)] and want


def test_ensemble_adds_to_the_reference(spark):
    """Each crown once: no two rows of the pool are the same crown, every source is known, numbers run by position."""
    found = catalog.queries()["gen11_ensemble_detector"](spark, SF).orderBy("id").collect()
    assert [r.id for r in found] == list(range(1, len(found) + 1)) and [(r.y, r.x) for r in found] == sorted((r.y, r.x) for r in found)
    assert {r.source for r in found} <= {"reference", "recall", "residual", "peak"} and "reference" in {r.source for r in found}
    assert all(math.dist((a.x, a.y), (b.x, b.y)) > max(3, 0.25 * min(a.radius, b.radius)) for a, b in itertools.combinations(found, 2))
    with pytest.raises(ValueError, match="no detector"):
        detector.detect(spark.createDataFrame([(0, 0, 0, 1, 2, 3)], "image_id long, x int, y int, b int, g int, r int"), "best")


def test_refinement_of_odd_detections(spark):
    """No radius, far off the image, off the core: gone, or rejected, by the rule for each."""
    core = spark.createDataFrame([(0, x, y, 10 <= x < 30 and 10 <= y < 30) for x in range(60) for y in range(40)], "image_id long, x int, y int, mask boolean")
    row = lambda i, x, y, r: (0, i, x, y, r, 100.0, 0.5, 0.5, "recall")
    found = spark.createDataFrame([row(1, 20, 20, 12), row(2, 20, 20, 0), row(3, -50, 20, 5), row(4, 50, 30, 6), row(5, -7, 20, 5), row(6, 20, 20, 40)], "image_id long, idx long, x int, y int, radius int, area_px double, circularity double, fill_ratio double, source string")
    got = {r.idx: r for r in detector.core_decisions(core, found).collect()}
    assert {i: r.local_refine_decision for i, r in got.items()} == {1: "kept_refined", 4: "rejected_low_green_core", 5: "rejected_low_green_core", 6: "rejected_low_green_core"}
    assert (got[1].x, got[1].y, got[1].radius) == (20, 20, 12) or abs(got[1].x - 20) <= 1
    assert got[5].green_ratio == 0 and got[4].x == 50


def test_lab_of_known_colours(spark):
    rows = [(0, k, 0, *c) for k, c in enumerate([(0, 0, 0), (255, 255, 255), (0, 255, 0), (0, 0, 255), (128, 128, 128)])]
    got = [(r.lab_l, r.lab_a) for r in raster.lab(spark.createDataFrame(rows, "image_id long, x int, y int, b int, g int, r int")).orderBy("x").collect()]
    assert got == [(0, 128), (255, 128), (224, 42), (136, 208), (137, 128)]


def corners_of(ring, eps, most):
    """Douglas and Peucker's rule by recursion."""
    far = max(range(len(ring)), key=lambda k: (math.dist(ring[k], ring[0]), -k))

    def split(a, b):
        (ax, ay), (bx, by) = ring[a], ring[b % len(ring)]
        n = math.hypot(bx - ax, by - ay)
        off = lambda p: abs((p[0] - ax) * (by - ay) - (p[1] - ay) * (bx - ax)) / n if n else math.dist(p, (ax, ay))
        if b - a < 2:
            return []
        c = max(range(a + 1, b), key=lambda k: (off(ring[k]), -k))
        return [*split(a, c), c, *split(c, b)] if off(ring[c]) > eps else []

    kept = [0, *split(0, far), far, *split(far, len(ring))] if far else [0]
    if len(kept) > most:
        kept = [kept[math.floor(j * (len(kept) - 1) / (most - 1))] for j in range(most)]
    return kept


@pytest.mark.parametrize("most,share", [(96, 0.006), (5, 0.0)])
def test_simplified_contours(spark, masks, most, share):
    rings = shape.contours(regions(masks))
    got = {}
    for r in shape.simplified(rings, most=most, share=share, least=0.3).orderBy("seq").collect():
        got.setdefault((r.image_id, r.label), []).append((r.seq, (r.x, r.y)))
    whole = {}
    for r in rings.orderBy("seq").collect():
        whole.setdefault((r.image_id, r.label), []).append((r.x, r.y))
    assert set(got) == set(whole)
    for key, ring in whole.items():
        length = sum(math.dist(a, b) for a, b in zip(ring, [*ring[1:], ring[0]]))
        want = corners_of(ring, max(0.3, share * length), most)
        assert got[key] == [(k, ring[k]) for k in want]


def test_edges_of_a_step_and_a_flat_image(spark):
    step = [(0, x, y, 20 if x < 6 else 120) for x in range(12) for y in range(8)] + [(1, x, y, 50) for x in range(5) for y in range(5)]
    got = field.edges(spark.createDataFrame(step, "image_id long, x int, y int, gray int"))
    on = {(r.image_id, r.x, r.y) for r in got.where("edge").collect()}
    assert got.count() == len(step) and on == {(0, 5, y) for y in range(8)}


def test_contours_of_detections(spark):
    """A square crown gives its corners, a far smaller disc what it holds of it, bare ground none; a centre off the crown takes the crown beside it."""
    on = lambda x, y: 10 <= x < 31 and 10 <= y < 31 or 50 <= x < 54 and 5 <= y < 9
    mask = spark.createDataFrame([(0, x, y, on(x, y)) for x in range(70) for y in range(40)], "image_id long, x int, y int, mask boolean")
    found = spark.createDataFrame([(0, 1, 20, 20, 20), (0, 2, 60, 30, 5), (0, 3, 34, 20, 18), (0, 4, 51, 7, 4)], "image_id long, idx long, x int, y int, radius int")
    got = {r.idx: r for r in detector.with_contours(mask, found).collect()}
    assert {(p.x, p.y) for p in got[1].contour} == {(10, 10), (30, 10), (30, 30), (10, 30)} and got[1].contour_points == 4
    assert got[2].contour is None and got[2].contour_points is None
    assert got[3].contour and all(on(p.x, p.y) and (p.x - 34) ** 2 + (p.y - 20) ** 2 <= 23**2 for p in got[3].contour)
    assert {(p.x, p.y) for p in got[4].contour} == {(50, 5), (53, 5), (53, 8), (50, 8)}


def test_planted_red_circles_are_found(spark):
    """Rings drawn in red over green and brown ground, one touching another; scaled to the image they belong to."""
    rings = [(30, 30, 14), (75, 28, 20), (110, 60, 11), (50, 75, 17)]
    rows = []
    for x in range(130):
        for y in range(100):
            red = any(abs(math.dist((x, y), c[:2]) - c[2]) <= 1.6 for c in rings)
            rows.append((0, x, y, *((30, 40, 220) if red else (60, 130, 70) if (x // 9 + y // 7) % 2 else (90, 130, 140))))
    frame = raster.colour(spark.createDataFrame(rows, "image_id long, x int, y int, b int, g int, r int"))
    got = detector.red_circles(frame, scale=(2.0, 2.0), least_cover=0.3).orderBy("id").collect()
    found = [(r.overlay_x, r.overlay_y, r.overlay_radius) for r in got]
    assert [r.id for r in got] == list(range(1, len(got) + 1)) and len(found) == len(rings)
    for c in rings:
        assert any(math.dist(c[:2], f[:2]) <= 2.5 and abs(c[2] - f[2]) <= 3 for f in found), (c, found)
    assert all(r.x == 2 * r.overlay_x and r.radius == 2 * r.overlay_radius and 0.3 <= r.score <= 0.6 for r in got)


def test_drawn_circles_are_read_back(spark):
    got = [(r.overlay_x, r.overlay_y, r.overlay_radius) for r in catalog.queries()["gen13_red_circles"](spark, SF).collect()]
    for cx in (20, 60):
        for cy in (12, 37):
            assert any(math.dist((cx, cy), f[:2]) <= 2.5 and abs(f[2] - 8) <= 3 for f in got), (cx, cy, got)
    assert len(got) <= 16
