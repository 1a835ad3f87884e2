"""Fields over pixels: exact distances, blur of any width, peaks, floods from markers, holes and filled regions.

Images are whole rectangles of pixels. Lines of an image, 64 rows or columns at a time, are worked on side by side in
one task; nothing needs an image as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from silvaframe.operators import raster
from silvaframe.operators.raster import PIXEL, components, ellipse, in_band, in_discs, placed, tiled, under
from silvaframe.operators.shape import pixel_key
from silvaframe.operators.suppress import suppress
from silvaframe.plans.scratch import stage

#: Rows or columns that are worked on together; decimals to which heights are kept, so that equal ones stay equal.
LINES, DECIMALS = 64, 4


def _along(pixels: DataFrame, axis: str, value: str, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(image_id, x, y, value): `work` on arrays [place along the axis, line] of the value; what is missing or null is infinite."""
    across = "y" if axis == "x" else "x"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = frame[axis].to_numpy() - frame[axis].min(), frame[across].to_numpy() - frame[across].min()
        grid = np.full((a.max() + 1, b.max() + 1), np.inf)
        grid[a, b] = frame[value].astype("float64").fillna(np.inf)
        return frame[PIXEL].assign(**{value: work(grid)[a, b]})

    kind = pixels.schema["image_id"].dataType.simpleString()
    narrow = pixels.select(*PIXEL, F.col(value).cast("double").alias(value), F.expr(f"{across} div {LINES}").alias("_block"))
    return narrow.groupBy("image_id", "_block").applyInPandas(run, f"image_id {kind}, x int, y int, {value} double")


def _envelope(across: np.ndarray) -> np.ndarray:
    """The least of across² at each place plus the square of the way there: only ways shorter than what is known are tried."""
    square, k = across * across, 1
    out = square.copy()
    while k < len(out) and k * k < out.max():
        np.minimum(out[k:], square[:-k] + k * k, out=out[k:])
        np.minimum(out[:-k], square[k:] + k * k, out=out[:-k])
        k += 1
    return out


def distance_squared(pixels: DataFrame, mask: str) -> DataFrame:
    """(image_id, x, y, d2): the exact squared distance of each pixel to the nearest one where the mask does not hold; null where it holds everywhere.

    The nearest such pixel of the own row is found by windows along rows, from the left and from the right; then each
    column takes the lower envelope of the parabolas that stand on its rows.
    """
    row = Window.partitionBy("image_id", "y")
    off = F.when(~F.coalesce(F.col(mask), F.lit(False)), F.col("x"))
    left, right = F.max(off).over(row.orderBy("x")), F.min(off).over(row.orderBy(F.desc("x")))
    near = pixels.select(*PIXEL, mask).select(*PIXEL, F.least(F.col("x") - left, right - F.col("x")).alias("d2"))
    found = _along(near, "y", "d2", _envelope)
    return found.select(*PIXEL, F.when(F.col("d2") < float("inf"), F.col("d2").cast("long")).alias("d2"))


def gaussian(sigma: float, size: int) -> list[float]:
    """Weights of a Gaussian of odd size, which add up to one."""
    w = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return (w / w.sum()).tolist()


def blurred(pixels: DataFrame, value: str, weights: list[float]) -> DataFrame:
    """(image_id, x, y, value): weighted sums along rows, then along columns; beyond the border the image is mirrored about its edge pixel."""
    work = lambda grid: _smooth(grid, weights)
    return _along(_along(pixels, "x", value, work), "y", value, work)


#: How far around a square background is looked for before lines of the whole image are.
REACH = 64


def _smooth(grid: np.ndarray, weights: list[float]) -> np.ndarray:
    reach = len(weights) // 2
    wide = np.pad(grid, ((reach, reach), (0, 0)), mode="reflect" if len(grid) > 1 else "edge")
    return sum(w * wide[k : k + len(grid)] for k, w in enumerate(weights))


def _distances(pixels: DataFrame, mask: str, sigma: float = 2.0, size: int = 17) -> DataFrame:
    """(image_id, x, y, _mask, distance) of all pixels; distance is null in images without background.

    Squares see REACH pixels and the blur's width around them. Where no pixel that counts has its background farther off than what the
    square does not see, all is known in one pass; the other images go by whole lines (`distance_squared`, `blurred`).
    """
    weights, blur = gaussian(sigma, size), size // 2
    around, side = REACH + blur, raster.TILE

    def work(rows: pa.Table, grid, own: np.ndarray) -> pa.Table:
        off = placed(~rows["_mask"].to_numpy(), grid)
        high, wide = off.shape
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        x0, y0, at = x.min(), y.min(), np.arange(wide)
        tx, ty = x[own][0] // side * side, y[own][0] // side * side
        # ends of what is seen that need not be the image's
        cut = [x0 == tx - around, x.max() == tx + side - 1 + around, y0 == ty - around, y.max() == ty + side - 1 + around]
        sure, found = not any(cut), None
        if off.any():
            left = at - np.maximum.accumulate(np.where(off, at, -np.inf), axis=1)
            right = np.minimum.accumulate(np.where(off, at, np.inf)[:, ::-1], axis=1)[:, ::-1] - at
            d2 = _envelope(np.minimum(left, right))
            if any(cut):
                gap = np.full(off.shape, np.inf)
                for is_cut, line in zip(cut, (at[None] + 1, wide - at[None], np.arange(high)[:, None] + 1, high - np.arange(high)[:, None])):
                    gap = np.minimum(gap, line) if is_cut else gap
                near = (slice(max(0, y[own].min() - y0 - blur), y[own].max() - y0 + blur + 1), slice(max(0, x[own].min() - x0 - blur), x[own].max() - x0 + blur + 1))
                sure = bool((d2[near] <= gap[near] * gap[near]).all())
            found = _smooth(_smooth(np.sqrt(d2).T, weights).T, weights)[grid]
        values = pa.array(found, pa.float64()) if sure and found is not None else pa.nulls(len(rows), pa.float64())
        return rows.append_column("distance", values).append_column("_sure", pa.array(np.full(len(rows), sure))).filter(pa.array(own))

    p = pixels.select(*PIXEL, F.coalesce(F.col(mask), F.lit(False)).alias("_mask"))
    found = tiled(p, around, work, StructType([*p.schema.fields, StructField("distance", DoubleType()), StructField("_sure", BooleanType())]))
    found = stage(found.withColumn("distance", F.round("distance", DECIMALS)), "distance")
    known = found.select(*PIXEL, "_mask", "distance")
    far = found.where("not _sure").select("image_id").distinct()
    if not far.limit(1).count():
        return known
    far = stage(far, "far")
    rest = stage(known.join(far, "image_id", "left_semi").select(*PIXEL, "_mask"), "mask")
    field = distance_squared(rest, "_mask").where("d2 is not null").select(*PIXEL, F.sqrt("d2").alias("distance"))
    field = blurred(field, "distance", weights).withColumn("distance", F.round("distance", DECIMALS))
    return known.join(far, "image_id", "left_anti").unionByName(stage(rest.join(field.hint("merge"), PIXEL, "left"), "distance"))


def distance(pixels: DataFrame, mask: str, sigma: float = 2.0, size: int = 17) -> DataFrame:
    """(image_id, x, y, distance): the distance field, blurred and kept to DECIMALS. An image without background counts as infinitely far and is left out."""
    return _distances(pixels, mask, sigma, size).where("distance is not null").select(*PIXEL, "distance")


def medians(field: DataFrame, value: str) -> DataFrame:
    """(image_id, n, median) of the positive values: counts by whole numbers tell where the middle lies, and only there values are ranked."""
    positive = field.where(F.col(value) > 0).withColumn("_bin", F.floor(value))
    bins = positive.groupBy("image_id", "_bin").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("image_id").orderBy("_bin"))
    bins = bins.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy("image_id")))
    low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")
    bins = bins.withColumn("before", F.col("upto") - F.col("c")).where((F.col("before") <= high) & (low < F.col("upto")))
    place = F.row_number().over(Window.partitionBy("image_id", "_bin").orderBy(value)) - 1 + F.col("before")
    ranked = positive.join(bins.select("image_id", "_bin", "before", "n").hint("shuffle_hash"), ["image_id", "_bin"]).withColumn("place", place)
    return ranked.where((F.col("place") == low) | (F.col("place") == high)).groupBy("image_id").agg(F.first("n").alias("n"), F.avg(value).alias("median"))


def highest(pixels: DataFrame, value: str, kernel: list[tuple[int, int]] | str, out: str) -> DataFrame:
    """Adds the largest value under a kernel whose rows are whole and centred, or under the ellipse whose size a column tells for each image."""
    reach = (F.col(kernel) / 2).cast("int") if isinstance(kernel, str) else max(max(abs(dx), abs(dy)) for dx, dy in kernel)

    def work(rows: pa.Table, grid, own: np.ndarray) -> pa.Table:
        shape = ellipse(rows[kernel][0].as_py()) if isinstance(kernel, str) else kernel
        values = placed(np.nan_to_num(rows[value].to_numpy().astype("float64"), nan=-np.inf), grid, -np.inf)
        return rows.append_column(out, pa.array(under(values, shape)[grid])).filter(pa.array(own))

    return tiled(pixels, reach, work, StructType([*pixels.schema.fields, StructField(out, pixels.schema[value].dataType)]))


def markers(field: DataFrame, mask: DataFrame, peak_distance: int = 0, least_peak: int = 0, dome: float = 1.5) -> DataFrame:
    """(image_id, x, y, marker): pixels of the peaks of a distance field, a pixel wider than they are; marker numbers a peak.

    A peak is the highest under an elliptic kernel as wide as the peak distance, and high enough. Where these are not given
    they follow from the median of the image's distances; images with fewer than 50 pixels of the mask take wide ones.
    """
    return _peaks(field, medians(field.join(mask.select(*PIXEL).hint("merge"), PIXEL), "distance"), peak_distance, least_peak, dome)


def _peaks(field: DataFrame, size: DataFrame, peak_distance: int, least_peak: int, dome: float = 1.5) -> DataFrame:
    tiny = F.col("n") < 50
    wide, least = F.when(tiny, max(peak_distance, 25)).otherwise(peak_distance), F.when(tiny, max(least_peak, 5)).otherwise(least_peak)
    size = size.select("image_id", "median", wide.alias("wide"), least.alias("least"))
    wide = F.when(F.col("wide") <= 0, F.greatest(F.lit(13), (F.col("median") * 1.35).cast("int"))).otherwise(F.col("wide"))
    least = F.when(F.col("least") <= 0, F.greatest(F.lit(3), (F.col("median") * 0.28).cast("int"))).otherwise(F.col("least"))
    size = stage(size.select("image_id", F.greatest(F.lit(3), wide.bitwiseOR(1)).alias("size"), F.greatest(least, F.lit(2)).alias("least")), "peaks")
    low = field.join(size.hint("shuffle_hash"), "image_id").select(*PIXEL, F.greatest(F.col("distance") - dome, F.lit(0.0)).alias("height"), "size", "least")
    found = highest(low, "height", "size", "top").where((F.col("height") == F.col("top")) & (F.col("height") >= F.col("least")))
    # a cross around each peak pixel
    cross = F.inline(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ellipse(3)]))
    ends = field.groupBy("image_id").agg(F.min("x").alias("_x1"), F.max("x").alias("_x2"), F.min("y").alias("_y1"), F.max("y").alias("_y2"))
    spread = found.select("image_id", cross).distinct().join(ends.hint("shuffle_hash"), "image_id").where("x between _x1 and _x2 and y between _y1 and _y2").select(*PIXEL)
    return components(spread.withColumn("_on", F.lit(True)), "_on").select(*PIXEL, F.col("label").alias("marker"))


#: Side of the squares whose pixels are contracted together before any round.
TILE = 512


def _contracted(frame: pd.DataFrame) -> pd.DataFrame:
    """Pixels (key, x, y, elevation, basin, open) of a square with their basins joined as far as the square alone can tell.

    A basin without a marker and without a pixel whose neighbours lie outside joins the one across its lowest pass."""
    x, y, height, key = frame["x"].to_numpy(), frame["y"].to_numpy(), frame["elevation"].to_numpy(), frame["key"].to_numpy()
    grid = np.full((y.max() - y.min() + 2, x.max() - x.min() + 2), -1)
    grid[y - y.min(), x - x.min()] = np.arange(len(frame))
    pairs = np.concatenate([np.stack([grid[:, :-1].ravel(), grid[:, 1:].ravel()]), np.stack([grid[:-1].ravel(), grid[1:].ravel()])], axis=1)
    u, v = pairs[:, (pairs >= 0).all(axis=0)]
    order = np.lexsort((key[v], key[u], np.maximum(height[u], height[v])))[::-1]  # the lowest last
    u, v = u[order], v[order]
    names, own = np.unique(frame["basin"].to_numpy(), return_inverse=True)
    stays = names < 0
    np.logical_or.at(stays, own, frame["open"].to_numpy())
    rooted = names < 0
    while True:
        a, b = own[u], own[v]
        live = (a != b) & ~(rooted[a] & rooted[b])
        u, v, a, b = u[live], v[live], a[live], b[live]
        to = np.arange(len(names))
        both, other = np.stack([a, b], axis=1).ravel(), np.stack([b, a], axis=1).ravel()
        to[both] = other  # of equal places the last counts, which is the lowest pass
        to[stays] = np.flatnonzero(stays)
        if (to == np.arange(len(names))).all():
            break
        mutual = (to[to] == np.arange(len(names))) & (np.arange(len(names)) < to)
        to[mutual] = np.flatnonzero(mutual)
        while ((further := to[to]) != to).any():
            to = further
        np.logical_or.at(stays, to, stays.copy())
        np.logical_or.at(rooted, to, rooted.copy())
        own = to[own]
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, own, frame["basin"].to_numpy())  # the marker, or the least pixel
    return frame[["image_id", "x", "y", "key", "elevation"]].assign(basin=least[own], open=frame["open"])


def flood(pixels: DataFrame) -> DataFrame:
    """(image_id, x, y, label): each pixel of (image_id, x, y, elevation, marker) gets the marker that the water comes from; null where none comes.

    Water passes between pixels with a common side at the height of the higher one. It takes the lowest pass first; of
    equal ones that of the least first pixel, then of the least second one, pixels being counted row by row. What each
    marker floods is its tree in the minimum spanning forest of these passes, so it is worked out by Borůvka rounds: every
    basin that holds no marker joins the one across its lowest pass, all of them at once. Squares of an image are contracted
    first, where each basin that ends within the square can tell its lowest pass there, which is all for images of one square. What reaches over squares goes on in
    rounds of joins, chains of basins being followed by pointer doubling. Each round at least halves the basins without a
    marker. Rounds are written and reread.
    """
    by = ["image_id"]
    key = pixel_key(F.col("x"), F.col("y"))
    basin = F.when(F.col("marker").isNotNull(), -1 - F.col("marker")).otherwise(key)  # below zero: has a marker
    v = pixels.select(*PIXEL, key.alias("key"), F.col("elevation").cast("int").alias("elevation"), basin.alias("basin"))
    border = lambda c: ((F.col(c) % TILE == 0) & (F.col(c) > 0)) | (F.col(c) % TILE == TILE - 1)
    v = v.withColumn("open", border("x") | border("y"))
    square = v.groupBy("image_id", F.expr(f"x div {TILE}"), F.expr(f"y div {TILE}"))
    whole = stage(square.applyInPandas(_contracted, v.schema), "basins")
    done = whole.select(*PIXEL, F.when(F.col("basin") < 0, -1 - F.col("basin")).alias("label"))
    wide = stage(whole.where("open").select("image_id").distinct(), "wide")
    if not wide.limit(1).count():  # every image lies within one square
        return done
    v, done = whole.join(wide, "image_id", "left_semi").drop("open"), done.join(wide, "image_id", "left_anti")
    ways = []
    for window, c in ((Window.partitionBy("image_id", "y").orderBy("x"), "x"), (Window.partitionBy("image_id", "x").orderBy("y"), "y")):
        then = F.lead(F.struct(c, "key", "elevation", "basin")).over(window)
        way = v.withColumn("t", then).where(F.col(f"t.{c}") == F.col(c) + 1)
        ways.append(way.select(*by, F.struct(F.greatest("elevation", "t.elevation").alias("h"), F.col("key").alias("u"), F.col("t.key").alias("v")).alias("pass"), F.col("basin").alias("a"), F.col("t.basin").alias("b")))
    passes = ways[0].unionByName(ways[1])
    where = v.select(*by, "key", "basin")
    while True:
        # between two basins only the lowest pass counts; between two with markers none does
        open_ = passes.where("a <> b and (a >= 0 or b >= 0)").groupBy(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("pass").alias("pass"))
        open_ = stage(open_, "passes")
        both = open_.unionByName(open_.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "pass")).where("a >= 0")
        lowest = stage(both.groupBy(*by, "a").agg(F.min_by("b", "pass").alias("b")), "lowest")
        if not lowest.limit(1).count():
            break
        # two that chose each other: the lesser number stays
        mutual = lowest.select(*by, F.col("b").alias("a"), F.col("a").alias("b")).where("b < a")
        to = stage(lowest.join(mutual.select(*by, F.col("b").alias("a"), F.col("a").alias("b")).hint("merge"), [*by, "a", "b"], "left_anti"), "to")
        while True:
            further = to.select(*by, F.col("a").alias("b"), F.col("b").alias("further"))
            new = stage(to.join(further.hint("merge"), [*by, "b"], "left").select(*by, "a", F.coalesce("further", "b").alias("b"), F.col("further").isNotNull().alias("moved")), "to")
            to = new.select(*by, "a", "b")
            if not new.where("moved").limit(1).count():
                break

        def renamed(df: DataFrame, c: str) -> DataFrame:
            name = to.select(*by, F.col("a").alias(c), F.col("b").alias("_to"))
            return df.join(name.hint("merge"), [*by, c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")

        where = stage(renamed(where, "basin"), "where")
        passes = renamed(renamed(open_, "a"), "b")
    named = where.select(*by, "key", F.when(F.col("basin") < 0, -1 - F.col("basin")).alias("label")).hint("merge")
    return done.unionByName(v.select(*PIXEL, "key").join(named, [*by, "key"]).select(*PIXEL, "label"))


def holes(pixels: DataFrame, mask: str) -> DataFrame:
    """(image_id, x, y, label): pixels off the mask from which no way by sides, off the mask, leads to the border of the image."""
    edge = pixels.groupBy("image_id").agg(F.min("x").alias("_x1"), F.max("x").alias("_x2"), F.min("y").alias("_y1"), F.max("y").alias("_y2"))
    off = components(pixels.select(*PIXEL, (~F.coalesce(F.col(mask), F.lit(False))).alias("_off")), "_off", diagonal=False).select(*PIXEL, "label")
    out = off.join(edge.hint("shuffle_hash"), "image_id").where("x = _x1 or x = _x2 or y = _y1 or y = _y2").select("image_id", "label").distinct()
    return off.join(out.hint("merge"), ["image_id", "label"], "left_anti").select(*PIXEL, "label")


def filled_regions(pixels: DataFrame, mask: str) -> DataFrame:
    """(image_id, x, y, label): the mask with its holes filled, in 8-connected regions: what the outermost contours hold.

    Images of one square are filled and labelled there, in one pass; wider ones go through `holes` and `components`."""
    side = raster.TILE

    def work(rows: pa.Table, grid, own: np.ndarray) -> pa.Table:
        x, y = rows["x"].to_numpy().astype(np.int64), rows["y"].to_numpy().astype(np.int64)
        if _at_border(x, y, side).any():
            return rows.append_column("label", pa.nulls(len(rows), pa.int64()))
        on = rows["_mask"].to_numpy().copy()
        off = np.flatnonzero(~on)
        if len(off):
            part = in_band(np.zeros(len(off), np.int64), x[off], y[off], False)
            edge = (x == x.min()) | (x == x.max()) | (y == y.min()) | (y == y.max())
            out = np.zeros(len(off), bool)
            out[part[edge[off]]] = True
            on[off[~out[part]]] = True
        whole = np.flatnonzero(on)
        label = (y * 1_000_000 + x)[whole[in_band(np.zeros(len(whole), np.int64), x[whole], y[whole], True)]] if len(whole) else whole
        return rows.take(pa.array(whole)).append_column("label", pa.array(label))

    p = pixels.select(*PIXEL, F.coalesce(F.col(mask), F.lit(False)).alias("_mask"))
    found = stage(tiled(p, 0, work, StructType([*p.schema.fields, StructField("label", LongType())])), "filled")
    done, wide = found.where("label is not null").select(*PIXEL, "label"), found.where("label is null").select(*PIXEL, "_mask")
    if not wide.limit(1).count():
        return done
    whole = wide.where("_mask").select(*PIXEL).unionByName(holes(wide, "_mask").select(*PIXEL))
    return done.unionByName(components(whole.withColumn("_on", F.lit(True)), "_on").select(*PIXEL, "label"))


def _at_border(x: np.ndarray, y: np.ndarray, side: int) -> np.ndarray:
    """Which pixels have neighbours, or may have, in another square."""
    return (x % side == side - 1) | (y % side == side - 1) | ((x % side == 0) & (x > 0)) | ((y % side == 0) & (y > 0))


def edges(pixels: DataFrame, value: str = "gray", low: int = 70, high: int = 150, gradients: bool = False) -> DataFrame:
    """(image_id, x, y, edge, and gx, gy if asked for): thin edges of a plane of whole numbers, weak ones only where they hang together with a strong one (Canny 1986).

    Gradients are those of Sobel's kernels, the border being repeated, and count by the sum of their amounts. A pixel stays if
    it is the highest across its edge, in one of four directions: along a row or a column one side may be as high, on a diagonal none.
    Squares see two pixels around them, as far as an answer reaches; weak components are labelled and kept if they hold a strong pixel:
    within the square where they touch none of its borders, and by rounds where they reach into another one.
    """
    side = raster.TILE

    def work(rows: pa.Table, grid, own: np.ndarray) -> pa.Table:
        v = np.pad(placed(rows["_v"].to_numpy().astype(np.int64), grid), 1, mode="edge")
        smooth, step = v[:-2] + 2 * v[1:-1] + v[2:], v[2:] - v[:-2]
        gx, gy = smooth[:, 2:] - smooth[:, :-2], step[:, :-2] + 2 * step[:, 1:-1] + step[:, 2:]
        ax, ay = np.abs(gx), np.abs(gy)
        wide = np.pad(ax + ay, 1)
        m = wide[1:-1, 1:-1]
        at = lambda dy, dx: wide[1 + dy : wide.shape[0] - 1 + dy, 1 + dx : wide.shape[1] - 1 + dx]
        # tan of 22.5 degrees in units of 2^-15, and that of 67.5 degrees, which is two more
        flat, steep, same = ay * 32768 < ax * 13573, ay * 32768 > ax * (13573 + 65536), (gx < 0) == (gy < 0)
        thin = np.select([flat, steep, same], [(m > at(0, -1)) & (m >= at(0, 1)), (m > at(-1, 0)) & (m >= at(1, 0)), (m > at(-1, -1)) & (m > at(1, 1))], (m > at(-1, 1)) & (m > at(1, -1)))
        weak, strong = (thin & (m > low))[grid][own], (m > high)[grid][own]
        out = rows.select(PIXEL).filter(pa.array(own))
        at, edge, known = np.flatnonzero(weak), np.zeros(len(weak), bool), np.ones(len(weak), bool)
        if len(at):
            x, y = out["x"].to_numpy().astype(np.int64)[at], out["y"].to_numpy().astype(np.int64)[at]
            part, holds, open_ = in_band(np.zeros(len(at), np.int64), x, y, True), np.zeros(len(at), bool), np.zeros(len(at), bool)
            holds[part[strong[at]]] = True
            open_[part[_at_border(x, y, side)]] = True
            edge[at], known[at] = holds[part], ~open_[part]
        for name, plane in (("gx", gx[grid][own]), ("gy", gy[grid][own]), ("_strong", strong)):
            out = out.append_column(name, pa.array(plane))
        return out.append_column("edge", pa.array(edge, mask=~known))

    p = pixels.select(*PIXEL, F.col(value).cast("int").alias("_v"))
    schema = StructType([*p.schema.fields[:3], StructField("gx", IntegerType()), StructField("gy", IntegerType()), StructField("_strong", BooleanType()), StructField("edge", BooleanType())])
    found = stage(tiled(p, 2, work, schema), "thin")
    rest = ["gx", "gy"] if gradients else []
    done, weak = found.where("edge is not null").select(*PIXEL, "edge", *rest), found.where("edge is null")
    if not weak.limit(1).count():
        return done
    lab = components(weak.select(*PIXEL, "_strong", *rest, F.lit(True).alias("_weak")), "_weak")
    real = lab.where("_strong").select("image_id", "label").distinct().withColumn("edge", F.lit(True))
    open_ = lab.join(real.hint("merge"), ["image_id", "label"], "left").select(*PIXEL, F.coalesce("edge", F.lit(False)).alias("edge"), *rest)
    return done.unionByName(open_)


def elevation(distance: Column, low: Column, high: Column) -> Column:
    """Heights from 0 where the distance is largest to 255 where it is smallest, cut to whole numbers."""
    return F.when(high > low, ((high - distance) * 255.0 / F.nullif(high - low, F.lit(0.0)))).otherwise(0.0).cast("int")


def crowns(pixels: DataFrame, mask: str, peak_distance: int = 0, least_peak: int = 0) -> tuple[DataFrame, DataFrame]:
    """((image_id, x, y, label) of the pixels of crowns, (image_id, x, y, distance)): the mask split where crowns grow into each other.

    Water rises from the peaks of the distance field. In images without a peak the filled regions of the mask stand for crowns. Pixels
    of the mask that no water reaches belong to no crown.
    """
    planes = _distances(pixels, mask)
    field = planes.where("distance is not null").select(*PIXEL, "distance")
    on = planes.where("_mask and distance is not null")
    peaks = stage(_peaks(field, medians(on, "distance"), peak_distance, least_peak), "markers")
    span = field.groupBy("image_id").agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
    with_peaks = stage(peaks.select("image_id").distinct(), "with_peaks")
    ground = on.join(span.join(with_peaks, "image_id", "left_semi").hint("shuffle_hash"), "image_id").join(peaks.hint("merge"), PIXEL, "left")
    split = flood(ground.select(*PIXEL, elevation(F.col("distance"), F.col("low"), F.col("high")).alias("elevation"), "marker")).where("label is not null")
    without = planes.join(with_peaks.hint("shuffle_hash"), "image_id", "left_anti")
    if without.where("_mask").limit(1).count():
        split = split.unionByName(filled_regions(without, "_mask"))
    return stage(split, "crowns"), field


def circles(pixels: DataFrame, value: str = "gray", radii: tuple[int, int] = (8, 95), apart: int = 8, low: int = 40, high: int = 80, votes: int = 13, bin_size: float = 1.2) -> DataFrame:
    """(image_id, idx, cx, cy, radius, votes): circles whose edges' gradients point to a common centre.

    Each edge pixel votes along its gradient, both ways, for the bins that a centre within the radii may lie in. Votes are counted before
    they are shuffled. A bin is a centre if it has `votes` or more and as many as any bin around it, the first of equals; of centres
    nearer than `apart` the one with most votes stays. The radius is the distance at which most edge pixels lie around it, for each unit of length;
    these have to be more than `votes`.
    """
    edge = stage(edges(pixels, value, low, high, True).where("edge").select(*PIXEL, "gx", "gy"), "edges")
    n = F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double"))
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    way = edge.where("gx <> 0 or gy <> 0").select(*PIXEL, (F.col("gx") / n).alias("_ux"), (F.col("gy") / n).alias("_uy")).hint("merge").join(size, "image_id")
    steps = F.explode(F.sequence(F.lit(radii[0]), F.lit(radii[1]))).alias("_r")
    at = way.select("*", steps).withColumn("_r", F.explode(F.array("_r", -F.col("_r"))))
    bin_ = lambda c, u: F.floor((F.col(c) + F.col("_r") * F.col(u)) / bin_size).cast("int")
    at = at.select("image_id", bin_("x", "_ux").alias("x"), bin_("y", "_uy").alias("y"), "_w", "_h")
    at = at.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") * bin_size < F.col("_w")) & (F.col("y") * bin_size < F.col("_h")))
    count = at.groupBy(*PIXEL).agg(F.count(F.lit(1)).alias("votes"))
    top = highest(count, "votes", [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)], "top").where((F.col("votes") == F.col("top")) & (F.col("votes") >= votes))
    found = top.select("image_id", pixel_key(F.col("x"), F.col("y")).alias("idx"), ((F.col("x") + 0.5) * bin_size).alias("x"), ((F.col("y") + 0.5) * bin_size).alias("y"), "votes", F.lit(float(apart)).alias("radius"))
    near = lambda p, q: (p("x") - q("x")) * (p("x") - q("x")) + (p("y") - q("y")) * (p("y") - q("y")) < float(apart * apart)
    centre = suppress(found, [-F.col("votes"), F.col("idx")], near, 2.0 * apart).select("image_id", "idx", F.col("x").alias("cx"), F.col("y").alias("cy"), "votes")
    around = in_discs(edge.select(*PIXEL), centre.withColumn("radius", F.lit(float(radii[1] + 1))), 64)
    far = F.bround(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)), 0).cast("int")
    rings = around.select("image_id", "idx", far.alias("r")).where(F.col("r").between(*radii)).groupBy("image_id", "idx", "r").agg(F.count(F.lit(1)).alias("n"))
    best = rings.groupBy("image_id", "idx").agg(F.max(F.struct((F.col("n") / F.col("r")).alias("per"), (-F.col("r")).alias("r"), "n")).alias("m")).where(F.col("m.n") > votes).select("image_id", "idx", (-F.col("m.r")).alias("radius"))
    return centre.join(best.hint("merge"), ["image_id", "idx"]).select("image_id", "idx", "cx", "cy", "radius", "votes")
