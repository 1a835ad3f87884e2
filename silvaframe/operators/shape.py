"""Shapes of labelled pixels: ordered outer contours, their measures, convex hulls and smallest enclosing circles.

A labelled table holds the pixels (*by, x, y) of regions; `by` names the columns that tell a region, whose pixels hang
together by sides or corners. Regions may overlap: pixels of another region are no neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from silvaframe.plans.scratch import stage

REGION = ("image_id", "label")
#: Rows of an image that are looked at, and whose links are followed, together.
BAND = 256


def pixel_key(x: Column, y: Column) -> Column:
    return y.cast("long") * 1_000_000 + x


def neighbours(labelled: DataFrame, by: tuple[str, ...] = REGION) -> DataFrame:
    """Adds nb: bit 3 * (dy + 1) + (dx + 1) tells whether the pixel at (dx, dy) belongs to the region.

    Bands of rows are looked at together, each with the rows above and below it.
    """
    names, rows = [*by, "x", "y"], BAND
    bands = F.explode(F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor((F.col("y") + d) / rows))))
    schema = StructType([*labelled.select(*names).schema.fields, StructField("nb", IntegerType())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, y = table["x"].to_numpy().astype(np.int64), table["y"].to_numpy().astype(np.int64)
        space = _spaces(table, list(by))
        wide, high = x.max() - x.min() + 3, y.max() - y.min() + 3
        at = (space * high + y - y.min() + 1) * wide + x - x.min() + 1
        there, nb = np.sort(at), np.zeros(len(at), np.int32)
        for bit in range(9):
            sought = at + (bit // 3 - 1) * wide + bit % 3 - 1
            place = np.minimum(np.searchsorted(there, sought), len(there) - 1)
            nb |= (there[place] == sought).astype(np.int32) << bit
        return table.select(names).append_column("nb", pa.array(nb)).filter(pa.array(y // rows == key[1].as_py()))

    return labelled.select(*names).withColumn("_band", bands).groupBy(by[0], "_band").applyInArrow(run, schema)


#: Sides of a pixel, and for each the places, counted from the pixel, of what lies across, ahead on the region's side and
#: ahead across. Sides follow each other clockwise: top, right, bottom, left.
SIDES = [((0, -1), (1, 0), (1, -1)), ((1, 0), (0, 1), (1, 1)), ((0, 1), (-1, 0), (-1, 1)), ((-1, 0), (0, -1), (-1, -1))]


def cracks(labelled: DataFrame, by: tuple[str, ...] = REGION) -> DataFrame:
    """(*by, c, s, x, y, nx, ny): the sides of pixels across which the region ends, with the side that follows each.

    A crack's number c is its pixel's key times four plus the side. Its successor lies on the pixel ahead across, if that
    belongs to the region, else on the one straight ahead, else on the same pixel's next side. So corners connect,
    and each crack has one successor and one predecessor. (nx, ny) is the successor's pixel.
    """
    bit = lambda place: F.col("nb").bitwiseAND(1 << (3 * (place[1] + 1) + place[0] + 1)) != 0
    rows = []
    for side, (across, ahead, beyond) in enumerate(SIDES):
        step = lambda d, to: F.struct((F.col("x") + d[0]).alias("x"), (F.col("y") + d[1]).alias("y"), F.lit(to).alias("side"))
        to = F.when(bit(beyond), step(beyond, (side + 3) % 4)).when(bit(ahead), step(ahead, side)).otherwise(step((0, 0), (side + 1) % 4))
        rows.append(F.when(~bit(across), F.struct(F.lit(side).alias("side"), to.alias("to"))))
    each = neighbours(labelled, by).select(*by, "x", "y", F.explode(F.array_compact(F.array(*rows))).alias("e"))
    number = lambda x, y, side: pixel_key(x, y) * 4 + side
    return each.select(*by, number(F.col("x"), F.col("y"), F.col("e.side")).alias("c"), number(F.col("e.to.x"), F.col("e.to.y"), F.col("e.to.side")).alias("s"), "x", "y", F.col("e.to.x").alias("nx"), F.col("e.to.y").alias("ny"))


def _hops(by: list[str]):
    """Links of one band as links that leave it, or end. Rings that lie in the band have no end and go."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        space = frame.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        own = pd.MultiIndex.from_arrays([space, frame["c"]])
        ends = frame["next"].isna().to_numpy()
        to = own.get_indexer(pd.MultiIndex.from_arrays([space, frame["next"].fillna(-1).astype("int64")]))
        d, last = frame["d"].to_numpy().copy(), np.arange(len(frame))  # last: the link whose own next is that of the chain so far
        hop = np.where(ends, -1, to)
        for _ in range(len(frame).bit_length()):
            go = hop >= 0
            d = np.where(go, d + d[hop], d)
            last = np.where(go, last[hop], last)
            hop = np.where(go, hop[hop], hop)
        out = frame[[*by, "c"]].assign(next=frame["next"].to_numpy()[last], d=d)
        return out[hop < 0]

    return run


def ranked(links: DataFrame, by: list[str]) -> DataFrame:
    """(*by, c, d): for each link (*by, c, next, d) the sum of d from it to the end of its list, whose next is null.

    Pointer doubling: each round every open link takes over the sum of the link it points to, and then points where that
    one points. A list of n links is done after log2(n) rounds. Links of a band of rows are followed where they lie
    first, so that only lists that leave their band go through rounds, and these by their ways through bands; each round is
    written and reread. Links of rings have no end and are left out: the rounds stop when no list has got an end nearer.
    """
    band = F.expr(f"c div {4_000_000 * BAND}")
    followed = links.groupBy(by[0], band.alias("_band")).applyInPandas(_hops(by), links.select(*by, "c", "next", "d").schema)
    now, done = stage(followed, "links"), -1
    while now.where("next is not null").limit(1).count() and (ended := now.where("next is null").count()) != done:
        done = ended
        to = now.select(*by, F.col("c").alias("next"), F.col("next").alias("further"), F.col("d").alias("more"))
        moved = now.where("next is not null").join(to.hint("merge"), [*by, "next"]).select(*by, "c", F.col("further").alias("next"), (F.col("d") + F.col("more")).alias("d"))
        now = stage(moved.unionByName(now.where("next is null")), "links")
    return now.where("next is null").select(*by, "c", "d")


def _spaces(table: pa.Table, by: list[str]) -> np.ndarray:
    """A number from 0 on for each row's region."""
    return table.select(by).to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy()


def _traced(labelled: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, seq, x, y, nx, ny): the rings of regions that lie in one band of rows; one row without seq for each band of any other region."""
    keys, rows = list(by), BAND
    bands = F.explode(F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor((F.col("y") + d) / rows))))
    fields = labelled.select(*keys).schema.fields
    schema = StructType([*fields, StructField("seq", LongType()), *[StructField(c, IntegerType()) for c in ("x", "y", "nx", "ny")]])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, y = table["x"].to_numpy().astype(np.int64), table["y"].to_numpy().astype(np.int64)
        space, inside = _spaces(table, keys), y // rows == key[1].as_py()
        wide = np.bincount(space, ~inside) > 0
        some = np.flatnonzero(wide[space] & inside)
        open_ = some[np.unique(space[some], return_index=True)[1]]
        closed = np.flatnonzero(~wide[space])
        ring, seq, then = _rings(space[closed], x[closed], y[closed])
        ring, then = closed[ring], closed[then]
        out = table.select(keys).take(pa.array(np.concatenate([ring, open_])))
        for name, of, at in (("seq", None, None), ("x", x, ring), ("y", y, ring), ("nx", x, then), ("ny", y, then)):
            found = seq if of is None else of[at]
            type_ = pa.int64() if name == "seq" else pa.int32()
            out = out.append_column(name, pa.concat_arrays([pa.array(found, type_), pa.nulls(len(open_), type_)]))
        return out

    return labelled.select(*keys, "x", "y").withColumn("_band", bands).groupBy(keys[0], "_band").applyInArrow(run, schema)


def _rings(space: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pixel, place, next pixel) of the steps of the outer contour of each region that lies here as a whole; pixels by their place in the input."""
    if not len(x):
        none = np.empty(0, np.int64)
        return none, none, none
    wide, high = x.max() - x.min() + 3, y.max() - y.min() + 3
    at = (space * high + y - y.min() + 1) * wide + x - x.min() + 1
    order = np.argsort(at)
    there = at[order]

    def pixel(d: tuple[int, int]) -> np.ndarray:
        place = np.minimum(np.searchsorted(there, at + d[1] * wide + d[0]), len(at) - 1)
        return np.where(there[place] == at + d[1] * wide + d[0], order[place], -1)

    beside, own = {d: pixel(d) for side in SIDES for d in side}, np.arange(len(at))
    to, crack = np.empty((len(at), 4), np.int64), np.empty((len(at), 4), bool)
    for side, (across, ahead, beyond) in enumerate(SIDES):
        crack[:, side] = beside[across] < 0
        to[:, side] = np.where(beside[beyond] >= 0, beside[beyond] * 4 + (side + 3) % 4, np.where(beside[ahead] >= 0, beside[ahead] * 4 + side, own * 4 + (side + 1) % 4))
    which = np.flatnonzero(crack.ravel())
    number = np.full(4 * len(at), -1)
    number[which] = np.arange(len(which))
    hop = number[to.ravel()[which]]
    first = order[np.append(True, space[order][1:] != space[order][:-1])]  # the topmost, leftmost pixel of each region
    start = number[first * 4]
    begins = np.zeros(len(which), bool)
    begins[start] = True
    last, then = begins[hop], to.ravel()[which] // 4
    leaves = then != which // 4
    d, hop = leaves.astype(np.int64), np.where(last, -1, hop)
    for _ in range(len(which).bit_length()):
        go = hop >= 0
        if not go.any():
            break
        d[go], hop[go] = d[go] + d[hop[go]], hop[hop[go]]
    n = np.empty(space.max() + 1, np.int64)
    n[space[first]] = d[start]
    out = np.flatnonzero(leaves & (hop < 0))
    here = which[out] // 4
    return here, n[space[here]] - d[out], then[out]


def contours(labelled: DataFrame, by: tuple[str, ...] = REGION) -> DataFrame:
    """(*by, seq, x, y, nx, ny): each region's outer contour as a ring of border pixels in clockwise order from the
    topmost, leftmost one, with the next pixel of the ring. Regions of one pixel have no ring.

    The ring of cracks around a region is cut before the top side of its first pixel; then all cracks are ranked by pointer
    doubling, and those that lead to another pixel make up the contour. Rings around holes do not reach the cut. Regions that
    lie in one band of rows are followed there, in one pass; only those that reach over bands go through joins.
    """
    keys = list(by)
    traced = stage(_traced(labelled, by), "rings")
    done, wide = traced.where("seq is not null").select(*keys, "seq", "x", "y", "nx", "ny"), labelled.join(traced.where("seq is null").select(*keys).hint("merge"), keys, "left_semi")
    if not traced.where("seq is null").limit(1).count():
        return done
    c = stage(cracks(wide, by), "cracks")
    first = stage(c.groupBy(*keys).agg(F.min("c").alias("start")), "starts")
    leaves = ((F.col("x") != F.col("nx")) | (F.col("y") != F.col("ny"))).cast("long")
    links = c.join(first.hint("merge"), keys).select(*keys, "c", F.when(F.col("s") != F.col("start"), F.col("s")).alias("next"), leaves.alias("d"))
    rank = stage(ranked(links, keys), "rank")
    whole = rank.join(first.hint("merge"), keys).where("c = start").select(*keys, F.col("d").alias("n"))
    moves = c.where((F.col("x") != F.col("nx")) | (F.col("y") != F.col("ny"))).select(*keys, "c", "x", "y", "nx", "ny")
    rest = moves.join(rank.hint("merge"), [*keys, "c"]).join(whole.hint("merge"), keys)
    return done.unionByName(rest.select(*keys, (F.col("n") - F.col("d")).alias("seq"), "x", "y", "nx", "ny"))


def contour_stats(labelled: DataFrame, rings: DataFrame, by: tuple[str, ...] = REGION) -> DataFrame:
    """(*by, area, perimeter, x, y, w, h, cx, cy) of each region: area and centroid of the polygon through its outer contour's
    pixels, the contour's length and its bounding box. The centroid is null where the area is none."""
    x, y, nx, ny = (F.col(c).cast("double") for c in ("x", "y", "nx", "ny"))
    cross = x * ny - nx * y
    sums = rings.groupBy(*by).agg(F.sum(cross).alias("_a"), F.sum((x + nx) * cross).alias("_mx"), F.sum((y + ny) * cross).alias("_my"), F.sum(F.sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))).alias("perimeter"))
    box = labelled.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    over = F.nullif(3 * F.col("_a"), F.lit(0.0))
    return box.join(sums.hint("merge"), list(by), "left").select(*by, (F.abs(F.coalesce("_a", F.lit(0.0))) / 2).alias("area"), F.coalesce("perimeter", F.lit(0.0)).alias("perimeter"), "x", "y", "w", "h", (F.col("_mx") / over).alias("cx"), (F.col("_my") / over).alias("cy"))


_POINTS = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, x, y) of the points in a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    points = column.flatten()
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return row, points.field("x").to_numpy(), points.field("y").to_numpy()


def _corners(row: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The places of the points on one side of each row's hull; points come sorted. A point on or behind the line between its neighbours is no
    corner whatever else goes, so all of these go at once, until none is left."""
    kept = np.arange(len(x))
    while len(kept) > 2:
        o, p, q = kept[:-2], kept[1:-1], kept[2:]
        turn = (x[p] - x[o]) * (y[q] - y[o]) - (y[p] - y[o]) * (x[q] - x[o])
        flat = np.append(np.append(False, (row[o] == row[q]) & (turn <= 0)), False)
        if not flat.any():
            break
        kept = kept[~flat]
    return kept


def _hulls(batches):
    for batch in batches:
        row, x, y = (c.astype(np.int64) for c in _lists(batch.column("p")))
        order = np.lexsort((y, x, row))
        row, x, y = row[order], x[order], y[order]
        new = np.append(True, (np.diff(row) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0))[: len(row)]
        row, x, y = row[new], x[new], y[new]
        few = np.bincount(row, minlength=batch.num_rows) < 3
        low = _corners(row, x, y)
        high = len(row) - 1 - _corners(row[::-1], x[::-1], y[::-1])
        # the last point of either side is the first one of the other
        ends = lambda side: np.append(row[side][1:] != row[side][:-1], True)[: len(side)]
        low = low[~ends(low) | few[row[low]]]
        high = high[~ends(high) & ~few[row[high]]]
        high = high[np.argsort(row[high], kind="stable")]
        side = np.append(low, high)
        side = side[np.argsort(row[side], kind="stable")]
        offsets = np.append(0, np.cumsum(np.bincount(row[side], minlength=batch.num_rows)))
        points = pa.StructArray.from_arrays([pa.array(x[side], pa.int32()), pa.array(y[side], pa.int32())], ["x", "y"])
        hull = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), points).cast(_POINTS)
        at = batch.schema.get_field_index("p")
        yield pa.RecordBatch.from_arrays([hull if k == at else c for k, c in enumerate(batch.columns)], names=["hull" if k == at else n for k, n in enumerate(batch.schema.names)])


def hulls(labelled: DataFrame, by: tuple[str, ...] = REGION) -> DataFrame:
    """(*by, hull: array<struct<x, y>>): corners of each region's convex hull in order. Only the ends of the region's rows
    take part, two for each row, so a region's list is as long as the image is high at most."""
    ends = labelled.groupBy(*by, "y").agg(F.min("x").alias("x1"), F.max("x").alias("x2"))
    at = lambda c: F.struct(F.col(c).cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    points = ends.groupBy(*by).agg(F.flatten(F.collect_list(F.array(at("x1"), at("x2")))).alias("p"))
    schema = StructType([StructField("hull" if f.name == "p" else f.name, f.dataType) for f in points.schema.fields])
    return points.mapInArrow(_hulls, schema)


def _circle_of(px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, ...]:
    """(r2, cx, cy, corners it rests on) of the smallest circle around up to four points a row (NaN: no point): the least of those through two or three of them that hold all."""
    none, found = np.full(len(px), -np.inf), []
    for i in range(4):
        for j in range(i):
            ax, ay, bx, by = px[:, i], py[:, i], px[:, j], py[:, j]
            found.append([((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / 4, (ax + bx) / 2, (ay + by) / 2, ax, ay, bx, by, none, none])
            for k in range(j):
                # with the third point as origin
                kx, ky = px[:, k], py[:, k]
                ux, uy, vx, vy = ax - kx, ay - ky, bx - kx, by - ky
                twice = 2 * (ux * vy - uy * vx)
                twice = np.where(twice == 0, np.nan, twice)
                x, y = (vy * (ux * ux + uy * uy) - uy * (vx * vx + vy * vy)) / twice, (ux * (vx * vx + vy * vy) - vx * (ux * ux + uy * uy)) / twice
                found.append([x * x + y * y, kx + x, ky + y, ax, ay, bx, by, kx, ky])
    all_ = np.array(found)  # [circle, value, row]
    dx, dy = px.T[None] - all_[:, 1, None], py.T[None] - all_[:, 2, None]
    with np.errstate(invalid="ignore"):
        holds = ~(dx * dx + dy * dy > (all_[:, 0] + 1e-9 * (1 + all_[:, 0]))[:, None]).any(axis=1) & ~np.isnan(all_[:, 0])
    best = np.zeros(len(px), np.int64)
    least = np.where(holds[0], all_[0], np.inf)
    for k in range(1, len(all_)):
        other = np.where(holds[k], all_[k], np.inf)
        differs = other != least
        at = differs.argmax(axis=0)
        less = differs.any(axis=0) & (np.take_along_axis(other, at[None], 0)[0] < np.take_along_axis(least, at[None], 0)[0])
        best, least = np.where(less, k, best), np.where(less, other, least)
    on = np.where(np.isinf(least[3:]), np.nan, least[3:])
    return least[0], least[1], least[2], on[0::2].T, on[1::2].T


def _circles(batches):
    for batch in batches:
        row, x, y = _lists(batch.column("hull"))
        x, y, n = x.astype(float), y.astype(float), batch.num_rows
        first = np.searchsorted(row, np.arange(n))
        cx, cy, r2 = x[first].copy(), y[first].copy(), np.zeros(n)
        onx, ony = np.full((n, 3), np.nan), np.full((n, 3), np.nan)
        onx[:, 0], ony[:, 0] = cx, cy
        live, row_, x_, y_ = np.arange(n), row, x, y
        while len(live):
            starts = np.searchsorted(row_, live)
            size = np.diff(np.append(starts, len(row_)))
            # the farthest corner, of equal ones that of the largest x, then y
            c = (x_ - cx[row_]) * (x_ - cx[row_]) + (y_ - cy[row_]) * (y_ - cy[row_])
            d2 = np.maximum.reduceat(c, starts)
            near = c == np.repeat(d2, size)
            fx = np.maximum.reduceat(np.where(near, x_, -np.inf), starts)
            fy = np.maximum.reduceat(np.where(near & (x_ == np.repeat(fx, size)), y_, -np.inf), starts)
            out = d2 > r2[live] + 1e-9 * (1 + r2[live])
            stays = np.repeat(out, size)
            live, fx, fy = live[out], fx[out], fy[out]
            row_, x_, y_ = row_[stays], x_[stays], y_[stays]
            if len(live):
                r2[live], cx[live], cy[live], onx[live], ony[live] = _circle_of(np.column_stack([onx[live], fx]), np.column_stack([ony[live], fy]))
        rest = [batch.column(k) for k, name in enumerate(batch.schema.names) if name != "hull"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(cx), pa.array(cy), pa.array(np.sqrt(r2))], names=[*[name for name in batch.schema.names if name != "hull"], "ex", "ey", "er"])


def enclosing_circles(hulled: DataFrame, by: tuple[str, ...] = REGION) -> DataFrame:
    """(*by, ex, ey, er): the smallest circle around each region's hull.

    A circle rests on up to three corners. As long as a corner lies outside, the farthest one and those it rests on are given
    a new circle, which is larger each time, so this ends. The regions of a batch go on side by side until all corners are inside.
    """
    some = hulled.where(F.size("hull") > 0).select(*by, "hull")
    return some.mapInArrow(_circles, StructType([*some.schema.fields[:-1], *[StructField(c, DoubleType()) for c in ("ex", "ey", "er")]]))


def simplified(rings: DataFrame, by: tuple[str, ...] = REGION, most: int = 96, share: float = 0.006, least: float = 0.8) -> DataFrame:
    """(*by, seq, x, y): the corners of each ring (*by, seq, x, y) that tell its shape to within max(least, share of its length), in order.

    Douglas and Peucker's rule in rounds. A ring is opened at its first point and the one farthest from it, of equal ones the first. In a round each open stretch
    between two corners is split at its farthest point, the first of equals, if that is farther off the chord than the tolerance; otherwise it is done, and
    its points take part no more. All stretches of all rings go on at once. If more than `most` corners are left, so many are taken, evenly spread.
    """
    keys = list(by)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    follow = Window.partitionBy(*keys).orderBy("seq")
    span = rings.withColumns({"_nx": F.lead("x").over(follow), "_ny": F.lead("y").over(follow)}) if "nx" not in rings.columns else rings.withColumnsRenamed({"nx": "_nx", "ny": "_ny"})
    first = span.where("seq = 0").select(*keys, F.col("x").alias("_x0"), F.col("y").alias("_y0"))
    span = span.join(first.hint("merge"), keys).withColumns({"_nx": F.coalesce("_nx", "_x0"), "_ny": F.coalesce("_ny", "_y0")})
    away = lambda a, b: F.sqrt((F.col(a) - x) * (F.col(a) - x) + (F.col(b) - y) * (F.col(b) - y))
    whole = span.groupBy(*keys).agg(F.greatest(F.lit(least), F.sum(away("_nx", "_ny")) * share).alias("eps"), F.max(F.struct(away("_x0", "_y0").alias("d"), (-F.col("seq")).alias("s"))).alias("far"), (F.max("seq") + 1).alias("n"), F.min(F.struct("_x0", "_y0")).alias("o"))
    whole = stage(whole.select(*keys, "eps", (-F.col("far.s")).alias("far"), "n", F.col("o._x0").alias("x0"), F.col("o._y0").alias("y0")), "rings")
    at = rings.select(*keys, "seq", "x", "y")
    far = whole.join(at.withColumnRenamed("seq", "far").hint("merge"), [*keys, "far"]).select(*keys, "eps", "far", "n", "x0", "y0", F.col("x").alias("xf"), F.col("y").alias("yf"))
    # stretches from a to b: the last one ends at the first point, which has number n there
    stretch = lambda a, b: F.struct(*[c.alias(k) for k, c in zip(("a", "b", "ax", "ay", "bx", "by"), (*a[:1], *b[:1], *a[1:], *b[1:]))])
    p0, pf, pn = (F.lit(0).cast("long"), F.col("x0"), F.col("y0")), (F.col("far"), F.col("xf"), F.col("yf")), (F.col("n"), F.col("x0"), F.col("y0"))
    open_ = far.select(*keys, "eps", F.inline(F.array(stretch(p0, pf), stretch(pf, pn))))
    points = at.join(open_.hint("merge"), keys).where("seq > a and seq < b")
    corners = [far.select(*keys, F.lit(0).cast("long").alias("seq"), F.col("x0").alias("x"), F.col("y0").alias("y")), far.where("far > 0").select(*keys, F.col("far").alias("seq"), F.col("xf").alias("x"), F.col("yf").alias("y"))]
    while True:
        points = stage(points, "points")
        if not points.limit(1).count():
            break
        bx, by_ = (F.col("bx") - F.col("ax")).cast("double"), (F.col("by") - F.col("ay")).cast("double")
        px, py = x - F.col("ax"), y - F.col("ay")
        length = F.sqrt(bx * bx + by_ * by_)
        off = F.when(length > 0, F.abs(px * by_ - py * bx) / length).otherwise(F.sqrt(px * px + py * py))
        split = points.withColumn("off", off).groupBy(*keys, "a", "b").agg(F.max(F.struct("off", (-F.col("seq")).alias("s"), "x", "y")).alias("m"), F.first("eps").alias("eps")).where("m.off > eps")
        split = stage(split.select(*keys, "a", "b", (-F.col("m.s")).alias("c"), F.col("m.x").alias("cx"), F.col("m.y").alias("cy")), "split")
        corners.append(split.select(*keys, F.col("c").alias("seq"), F.col("cx").alias("x"), F.col("cy").alias("y")))
        left = F.col("seq") < F.col("c")
        pick = lambda then, other: F.when(left, then).otherwise(other)
        points = points.join(split.hint("merge"), [*keys, "a", "b"]).where("seq <> c").select(
            *keys, "seq", "x", "y", "eps", pick(F.col("a"), F.col("c")).alias("a"), pick(F.col("c"), F.col("b")).alias("b"),
            pick(F.col("ax"), F.col("cx")).alias("ax"), pick(F.col("ay"), F.col("cy")).alias("ay"), pick(F.col("cx"), F.col("bx")).alias("bx"), pick(F.col("cy"), F.col("by")).alias("by"),
        )
    kept = corners[0]
    for more in corners[1:]:
        kept = kept.unionByName(more)
    kept = kept.withColumns({"_k": F.row_number().over(follow) - 1, "_m": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    # number k of m is taken if it is the whole part of one of `most` even steps from the first to the last
    step = F.lit(most - 1)
    j = F.ceil(F.col("_k") * step / F.nullif(F.col("_m") - 1, F.lit(0)))
    even = F.floor(j * (F.col("_m") - 1) / step) == F.col("_k")
    return kept.where((F.col("_m") <= most) | even).select(*keys, "seq", "x", "y")
