"""Pixel tables (image_id, x, y, b, g, r): colour, masks, neighbourhoods, components, regions."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from silvaframe.plans.scratch import stage

PIXEL = ["image_id", "x", "y"]


def colour(pixels: DataFrame) -> DataFrame:
    """Adds h (0..179), s, v (0..255), gray, exg = 2g - r - b and delta = max - min, as 8-bit image code defines them."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    top, low = F.greatest("b", "g", "r"), F.least("b", "g", "r")
    span = (top - low).cast("double")
    turn = F.when(span == 0, 0.0).when(top == r, 60.0 * (g - b) / F.nullif(span, F.lit(0.0))).when(top == g, 120.0 + 60.0 * (b - r) / F.nullif(span, F.lit(0.0))).otherwise(240.0 + 60.0 * (r - g) / F.nullif(span, F.lit(0.0)))
    turn = F.when(turn < 0, turn + 360.0).otherwise(turn)
    # a list of one struct: the planner writes none of this out again in the masks and filters that read it
    found = F.struct(
        (F.rint(turn / 2.0).cast("int") % 180).cast("int").alias("h"),
        F.when(top == 0, 0).otherwise(F.rint(255.0 * span / F.nullif(top, F.lit(0))).cast("int")).alias("s"),
        top.cast("int").alias("v"),
        F.rint(0.114 * b + 0.587 * g + 0.299 * r).cast("int").alias("gray"),
        (2 * g - r - b).cast("int").alias("exg"),
        (top - low).cast("int").alias("delta"),
    )
    return pixels.select("*", F.inline(F.array(found)))


def _between(c: str, low: int, high: int) -> Column:
    return F.col(c).between(low, high)


def vegetation() -> Column:
    return _between("h", 25, 115) & (F.col("s") >= 28) & (F.col("v") >= 35) & (F.col("exg") >= -2) & (F.col("g") >= F.col("r") - 8)


def bare_soil() -> Column:
    return ~vegetation() & (F.col("v") >= 70) & (F.col("s") <= 95) & (F.col("exg") < 12)


def soil_like() -> Column:
    return _between("h", 8, 36) & (F.col("s") <= 115) & (F.col("v") >= 65) & (F.col("exg") < 22)


def colour_anomaly() -> Column:
    white = (F.col("s") <= 48) & (F.col("v") >= 172) & (F.col("delta") <= 58)
    blue = _between("h", 88, 135) & (F.col("s") >= 55) & (F.col("v") >= 82)
    red = ((F.col("h") <= 8) | (F.col("h") >= 170)) & (F.col("s") >= 75) & (F.col("v") >= 90)
    return (white | blue | red) & ~vegetation() & ~soil_like()


def fire_core() -> Column:
    h, s, v, b, g, r = (F.col(c) for c in ("h", "s", "v", "b", "g", "r"))
    first = ((h <= 16) | (h >= 172)) & (s >= 115) & (v >= 165) & (r > g + 38) & (r > b + 55)
    second = h.between(8, 28) & (s >= 130) & (v >= 180) & (r > g + 22) & (r > b + 70)
    return (first | second) & ~vegetation() & ~soil_like()


def smoke_like() -> Column:
    return (F.col("s") <= 45) & _between("v", 105, 218) & (F.col("delta") <= 32)


def tree_mask(s: int = 25, v: int = 40, exg: int = 10) -> Column:
    return _between("h", 28, 105) & (F.col("s") >= s) & (F.col("v") >= v) & (F.col("exg") >= exg)


def vote_mask(a_plane: Column | None = None, lightness: Column | None = None, exg: int = 10, s: int = 0, v: int = 0, shadow: bool = True) -> Column:
    """Two votes of three: a green hue, saturated and lit enough, an excess of green, a greenish plane a of Lab; without that plane it counts
    as a vote. Shadows go: dark pixels, or those of little lightness where it is known."""
    votes = [_between("h", 25, 110) & (F.col("s") >= s) & (F.col("v") >= v), F.col("exg") >= exg, F.lit(True) if a_plane is None else a_plane < 122]
    dark = F.col("v") < 40 if lightness is None else (F.col("v") < 40) | (lightness < 35)
    return (sum((x.cast("int") for x in votes), F.lit(0)) >= 2) & (~dark if shadow else F.lit(True))


def lab(pixels: DataFrame) -> DataFrame:
    """Adds lab_l and lab_a (0..255): lightness, and green against red about 128, of sRGB under daylight, as 8-bit image code defines them."""
    linear = lambda c: F.when(F.col(c) / 255.0 > 0.04045, F.pow((F.col(c) / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(F.col(c) / 255.0 / 12.92)
    rgb = pixels.select("*", F.inline(F.array(F.struct(linear("r").alias("_r"), linear("g").alias("_g"), linear("b").alias("_b")))))
    x = (0.412453 * F.col("_r") + 0.357580 * F.col("_g") + 0.180423 * F.col("_b")) / 0.950456
    y = 0.212671 * F.col("_r") + 0.715160 * F.col("_g") + 0.072169 * F.col("_b")
    bent = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    light = F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)
    byte = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(c).cast("int")))
    found = F.struct(byte(light * 2.55).alias("lab_l"), byte(500 * (bent(x) - bent(y)) + 128).alias("lab_a"))
    return rgb.select(*pixels.columns, F.inline(F.array(found)))


def red_mask() -> Column:
    return (_between("h", 0, 12) | _between("h", 168, 179)) & (F.col("s") >= 70) & (F.col("v") >= 60)


def dark_crown() -> Column:
    s, v = F.col("s"), F.col("v")
    dark = (v < 100) & (v > 24) & (s > 32) & _between("h", 25, 115)
    biased = (v < 78) & (s > 22) & (F.col("exg") > -5) & (F.col("g") >= F.col("r") - 6)
    return (dark | biased) & ~((s < 26) & (v > 68))


def otsu(pixels: DataFrame, value: str = "exg") -> DataFrame:
    """(image_id, threshold): the level from 0 to 255 that best parts each image's stretched values (Otsu 1979).

    A histogram of 256 bins an image, then running sums over the bins: pixels only move as counts.
    """
    span = pixels.groupBy("image_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    level = F.when(F.col("hi") > F.col("lo"), F.bround(255.0 * (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")), 0)).otherwise(0).cast("int")
    bins = pixels.join(span.hint("shuffle_hash"), "image_id").groupBy("image_id", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    upto, whole = Window.partitionBy("image_id").orderBy("level"), Window.partitionBy("image_id")
    sums = bins.select("image_id", "level", F.sum("n").over(upto).alias("w"), F.sum(F.col("n") * F.col("level")).over(upto).alias("m"), F.sum("n").over(whole).alias("all_w"), F.sum(F.col("n") * F.col("level")).over(whole).alias("all_m"))
    rest = F.col("all_w") - F.col("w")
    apart = F.when(rest > 0, F.col("w") * rest * F.pow(F.col("m") / F.col("w") - (F.col("all_m") - F.col("m")) / F.nullif(rest, F.lit(0)), 2.0)).otherwise(0.0)
    return sums.groupBy("image_id").agg(F.max_by("level", F.struct(F.round(apart, 3), -F.col("level"))).alias("threshold"))


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic kernel of odd size."""
    r = size // 2
    out = []
    for dy in range(-r, r + 1):
        half = round(r * (1 - dy * dy / (r * r)) ** 0.5) if r else 0
        out += [(dx, dy) for dx in range(-half, half + 1)]
    return out


def square(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


#: Side of the squares of an image that are worked on in one task.
TILE = 512


def tiled(pixels: DataFrame, reach: Column | int, work, schema) -> DataFrame:
    """`work` on each square of an image with all pixels up to `reach` around it: work(rows, grid, own) -> rows of the schema.

    Pixels move once, those near a square's border in a few copies, and no task sees more than a square and its surroundings.
    rows are an Arrow table; grid (y, x) tells their places in arrays that hold them; own tells which of them the square has to give out.
    """
    reach = reach if isinstance(reach, Column) else F.lit(reach)

    def squares(c: str) -> Column:
        low = F.when(F.col(c) >= 0, F.greatest(F.lit(0), F.col(c) - reach)).otherwise(F.col(c) - reach)  # images begin at 0
        return F.explode(F.sequence(F.floor(low / TILE).cast("int"), F.floor((F.col(c) + reach) / TILE).cast("int")))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        own = (x // side == key[1].as_py()) & (y // side == key[2].as_py())
        if not own.any():
            return kind.empty_table()
        return work(rows.drop(["_tx", "_ty"]), (y - y.min(), x - x.min()), own).select(kind.names).cast(kind)

    side, kind = TILE, to_arrow_schema(schema)
    return pixels.withColumn("_tx", squares("x")).withColumn("_ty", squares("y")).groupBy("image_id", "_tx", "_ty").applyInArrow(run, schema)


def placed(values: np.ndarray, grid: tuple[np.ndarray, np.ndarray], none=0) -> np.ndarray:
    """An array [y, x] of the values, `none` where there is no pixel."""
    out = np.full((grid[0].max() + 1, grid[1].max() + 1), none, values.dtype)
    out[grid] = values
    return out


def under(grid: np.ndarray, kernel: list[tuple[int, int]], most=np.maximum) -> np.ndarray:
    """The largest value under a kernel whose rows are whole and centred."""
    halves = {dy: max(dx for dx, at in kernel if at == dy) for _, dy in kernel}
    high, wide = grid.shape
    along, row, out = {0: grid}, grid.copy(), grid.copy()
    for k in range(1, max(halves.values()) + 1):
        if k < wide:
            most(row[:, k:], grid[:, :-k], out=row[:, k:])
            most(row[:, :-k], grid[:, k:], out=row[:, :-k])
        along[k] = row.copy()
    for dy, half in halves.items():
        if abs(dy) < high:
            to, of = (slice(None, high - dy), slice(dy, None)) if dy >= 0 else (slice(-dy, None), slice(None, dy))
            most(out[to], along[half][of], out=out[to])
    return out


def morphed(pixels: DataFrame, steps: dict[str, list[tuple[str, list[tuple[int, int]]]]]) -> DataFrame:
    """pixels with each mask dilated ("d") or eroded ("e") by kernels, step by step. What is null, or lies outside the image, counts for nothing.

    A kernel's rows have to be whole and centred, as squares, crosses and ellipses have them. All steps of all masks are worked out
    in one pass over squares, which see as far around as their steps reach.
    """
    reach = max(sum(max(max(abs(dx), abs(dy)) for dx, dy in kernel) for _, kernel in todo) for todo in steps.values())

    def work(rows: pa.Table, grid, own: np.ndarray) -> pa.Table:
        for mask, todo in steps.items():
            known = placed(rows[mask].is_valid().to_numpy(), grid)
            on = placed(rows[mask].fill_null(False).to_numpy(), grid)
            every = known.all()
            for step, kernel in todo:
                on = under(on, kernel, np.logical_or) if step == "d" else ~under(known & ~on, kernel, np.logical_or)
                if not every:  # places outside the image never get to know anything
                    known = under(known, kernel, np.logical_or) & placed(np.ones(len(rows), bool), grid)
                    on &= known
            rows = rows.set_column(rows.column_names.index(mask), mask, pa.array(on[grid], mask=~known[grid]))
        return rows.filter(pa.array(own))

    return tiled(pixels, reach, work, pixels.schema)


def _changed(pixels: DataFrame, masks: list[str], steps: str, kernel: list[tuple[int, int]]) -> DataFrame:
    return morphed(pixels, {m: [(s, kernel) for s in steps] for m in masks})


def dilate(pixels: DataFrame, mask: str, kernel: list[tuple[int, int]]) -> DataFrame:
    return _changed(pixels, [mask], "d", kernel)


def erode(pixels: DataFrame, mask: str, kernel: list[tuple[int, int]]) -> DataFrame:
    """mask stays true where no pixel under the kernel is false. Pixels outside the image count for nothing."""
    return _changed(pixels, [mask], "e", kernel)


def opened(pixels: DataFrame, mask: str | list[str], kernel: list[tuple[int, int]]) -> DataFrame:
    """One mask or several, eroded and then dilated."""
    return _changed(pixels, [mask] if isinstance(mask, str) else mask, "ed", kernel)


def closed(pixels: DataFrame, mask: str | list[str], kernel: list[tuple[int, int]]) -> DataFrame:
    """One mask or several, dilated and then eroded."""
    return _changed(pixels, [mask] if isinstance(mask, str) else mask, "de", kernel)


#: Rows of an image whose components are found together.
BAND = 256


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n things the least one that it hangs together with by links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def in_band(space: np.ndarray, x: np.ndarray, y: np.ndarray, diagonal: bool) -> np.ndarray:
    """The place of the first pixel, row by row, of each pixel's component among those of its space: runs of rows are linked to those above them."""
    order = np.lexsort((x, y, space))
    s, r, c = space[order], y[order] - y.min() + 1, x[order] - x.min() + 2
    row, wide = s.astype(np.int64) * (r.max() + 2) + r, int(c.max()) + 4  # the row above the first one of a space is nobody's
    new = np.append(True, (row[1:] != row[:-1]) | (c[1:] - c[:-1] > 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    at, reach = row[first], int(diagonal)
    low = np.searchsorted(at * wide + c[last], (at - 1) * wide + c[first] - reach, "left")
    high = np.searchsorted(at * wide + c[first], (at - 1) * wide + c[last] + reach, "right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(first)), n)
    label = joined(len(first), a, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[a])
    out = np.empty(len(order), np.int64)
    out[order] = order[first[label[np.cumsum(new) - 1]]]
    return out


def components(pixels: DataFrame, mask: str, by: tuple[str, ...] = ("image_id",), diagonal: bool = True) -> DataFrame:
    """The masked pixels with label: the least y * 1e6 + x of their component, 8-connected or by sides only.

    by: the columns that keep pixels apart, so that regions that overlap in one image can be told too; the first one is the image.
    Components of a band of rows are found where they lie, which is all for images of one band. Where pixels meet across
    two bands, their labels are links: labels pass on the least one, with a jump to the label's own label, until nothing
    changes. So what goes through rounds are labels along the borders of bands; each round is written and reread.
    """
    by, rows = list(by), BAND
    on = pixels.where(mask).withColumn("_band", F.floor(F.col("y") / rows))
    rest = [c for c in pixels.columns if c not in by]
    schema = StructType([*pixels.select(*by, *rest).schema.fields, StructField("label", LongType())])

    def run(table: pa.Table) -> pa.Table:
        x, y = table["x"].to_numpy().astype(np.int64), table["y"].to_numpy().astype(np.int64)
        space = table.select(by).to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy() if len(by) > 1 else np.zeros(len(x), np.int64)
        label = (y * 1_000_000 + x)[in_band(space, x, y, diagonal)]
        return table.select([*by, *rest]).append_column("label", pa.array(label))

    on = stage(on.groupBy(by[0], "_band").applyInArrow(run, schema), "bands")
    beside = F.explode(F.array(*[F.lit(d) for d in ((-1, 0, 1) if diagonal else (0,))]))
    under_ = on.where(F.pmod("y", F.lit(rows)) == 0).select(*by, "y", F.col("x").alias("_x"), F.col("label").alias("u"), beside.alias("_d")).select(*by, (F.col("_x") + F.col("_d")).alias("x"), (F.col("y") - 1).alias("y"), "u")
    above = on.where(F.pmod("y", F.lit(rows)) == rows - 1).select(*by, "x", "y", F.col("label").alias("v"))
    stars = stage(under_.join(above.hint("merge"), [*by, "x", "y"]).select(*by, "u", "v").distinct(), "links")
    if not stars.limit(1).count():
        return on
    links = stars.unionByName(stars.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
    label = links.select(*by, F.col("u").alias("run"), F.col("u").alias("label")).distinct()
    while True:
        heard = links.withColumnRenamed("v", "run").join(label.hint("merge"), [*by, "run"]).groupBy(*by, F.col("u").alias("run")).agg(F.min("label").alias("heard"))
        low = label.join(heard.hint("merge"), [*by, "run"], "left").select(*by, "run", F.col("label").alias("was"), F.least("label", "heard").alias("now"))
        jump = low.select(*by, F.col("run").alias("now"), F.col("now").alias("further"))
        new = stage(low.join(jump.hint("merge"), [*by, "now"]).select(*by, "run", "was", F.col("further").alias("label")), "labels")
        if not new.where("was <> label").limit(1).count():
            break
        label = new.select(*by, "run", "label")
    named = new.select(*by, F.col("run").alias("label"), F.col("label").alias("_least"))
    return on.join(named.hint("merge"), [*by, "label"], "left").select(*by, *rest, F.coalesce("_least", "label").alias("label"))


def without_small(pixels: DataFrame, mask: str, least: int) -> DataFrame:
    """(image_id, x, y, mask): the mask without components of fewer than `least` pixels.

    Components that touch no border of their square are counted there; only those that reach into another square are labelled in rounds."""
    side = TILE

    def work(rows: pa.Table, grid, own: np.ndarray) -> pa.Table:
        x, y = rows["x"].to_numpy().astype(np.int64), rows["y"].to_numpy().astype(np.int64)
        on, known = rows[mask].to_numpy().copy(), np.ones(len(rows), bool)
        at = np.flatnonzero(on)
        if len(at):
            part, open_ = in_band(np.zeros(len(at), np.int64), x[at], y[at], True), np.zeros(len(at), bool)
            border = ((x % side == 0) & (x > 0)) | (x % side == side - 1) | ((y % side == 0) & (y > 0)) | (y % side == side - 1)
            open_[part[border[at]]] = True
            on[at], known[at] = np.bincount(part)[part] >= least, ~open_[part]
        return rows.set_column(rows.column_names.index(mask), mask, pa.array(on, mask=~known))

    p = pixels.select(*PIXEL, F.coalesce(F.col(mask), F.lit(False)).alias(mask))
    found = stage(tiled(p, 0, work, StructType([*p.schema.fields[:3], StructField(mask, BooleanType())])), "large")
    done, open_ = found.where(F.col(mask).isNotNull()), found.where(F.col(mask).isNull()).select(*PIXEL, F.lit(True).alias(mask))
    if not open_.limit(1).count():
        return done
    lab = components(open_, mask)
    large = lab.groupBy("image_id", "label").agg((F.count(F.lit(1)) >= least).alias("_large"))
    return done.unionByName(lab.join(large.hint("merge"), ["image_id", "label"]).select(*PIXEL, F.col("_large").alias(mask)))


def component_stats(labelled: DataFrame) -> DataFrame:
    """(image_id, label, area, x, y, w, h, cx, cy) of each component."""
    return labelled.groupBy("image_id", "label").agg(
        F.count(F.lit(1)).alias("area"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max("x") - F.min("x") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"),
        F.avg("x").alias("cx"),
        F.avg("y").alias("cy"),
    )


def cover(pixels: DataFrame, metres: float = 0.10) -> DataFrame:
    """(image_id, total, vegetation_px, bare_px, vegetation_pct, bare_pct) by the masks vegetation and bare."""
    out = pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("vegetation").alias("vegetation_px"), F.count_if("bare").alias("bare_px"))
    pct = lambda c: (F.col(c) / F.col("total") * 100.0)
    return out.withColumn("vegetation_pct", pct("vegetation_px")).withColumn("bare_pct", pct("bare_px"))


def grid(pixels: DataFrame, rows: int = 6, cols: int = 8) -> DataFrame:
    """(image_id, row, col, vegetation, bare): shares in a grid of cells whose borders are cut to whole pixels.

    A pixel's cell is the last one whose first pixel, int(k * size / cells), does not lie beyond it.
    """
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    cell = lambda at, n, k: F.expr(f"int((({at} + 1) * {k} - 1) div {n})")
    out = pixels.join(size.hint("shuffle_hash"), "image_id").withColumn("row", cell("y", "_h", rows)).withColumn("col", cell("x", "_w", cols))
    return out.groupBy("image_id", "row", "col").agg(F.round(F.avg(F.col("vegetation").cast("int")), 3).alias("vegetation"), F.round(F.avg(F.col("bare").cast("int")), 3).alias("bare"))


def in_discs(pixels: DataFrame, discs: DataFrame, cell: int) -> DataFrame:
    """Pixels with each disc (image_id, idx, cx, cy, radius) that holds them: an equi-join on grid squares of side `cell`.

    A disc is copied to the squares that it reaches, so its radius may be anything; `cell` only decides how many these are."""
    p = pixels.withColumn("_gx", F.floor(F.col("x") / cell)).withColumn("_gy", F.floor(F.col("y") / cell))
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("radius")) / cell), F.floor((F.col(c) + F.col("radius")) / cell)))
    d = discs.where("radius >= 0").withColumn("_gx", reach("cx")).withColumn("_gy", reach("cy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return p.hint("merge").join(d, ["image_id", "_gx", "_gy"]).where(dx * dx + dy * dy <= F.col("radius") * F.col("radius")).drop("_gx", "_gy")


def shrink(pixels: DataFrame, factor: int) -> DataFrame:
    """Means over squares of factor x factor pixels, half to even."""
    at = lambda c: F.expr(f"int({c} div {factor})").alias(c)
    mean = lambda c: F.bround(F.avg(c), 0).cast("int").alias(c)
    return pixels.groupBy("image_id", at("x"), at("y")).agg(mean("b"), mean("g"), mean("r"))


def local_maxima(pixels: DataFrame, value: str, radius: int, least: int) -> DataFrame:
    """Pixels whose value is the largest within a square and reaches `least`: windows along rows, then along columns."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    along = pixels.withColumn("_along", F.max(value).over(row.rangeBetween(-radius, radius)))
    top = along.withColumn("_top", F.max("_along").over(column.rangeBetween(-radius, radius)))
    return top.where((F.col(value) >= least) & (F.col(value) == F.col("_top"))).drop("_along", "_top")


def ring_coverage(rings: DataFrame, pixels: DataFrame, mask: str, angles: int = 96, width: int = 3) -> DataFrame:
    """(image_id, idx, coverage): share of the directions of a circle in which the mask holds within `width` of it."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("k")
    at = rings.select("image_id", "idx", "cx", "cy", "radius", turn).withColumn("o", F.explode(F.sequence(F.lit(-width), F.lit(width))))
    a = F.col("k") * (2 * 3.141592653589793 / angles)
    at = at.withColumn("x", F.bround(F.col("cx") + (F.col("radius") + F.col("o")) * F.cos(a), 0).cast("int")).withColumn("y", F.bround(F.col("cy") + (F.col("radius") + F.col("o")) * F.sin(a), 0).cast("int"))
    hit = at.join(pixels.where(mask).select(*PIXEL, F.lit(1).alias("hit")).hint("merge"), PIXEL, "left")
    by = hit.groupBy("image_id", "idx", "k").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return by.groupBy("image_id", "idx").agg(F.avg("hit").alias("coverage"))


def ring_share(rings: DataFrame, pixels: DataFrame, mask: str, angles: int = 96, width: int = 3) -> DataFrame:
    """(image_id, idx, coverage): share of the places on and up to `width` off a circle, in so many directions, where the mask holds; places off the image do not count."""
    at = rings.select("image_id", "idx", "cx", "cy", "radius", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("k")).withColumn("o", F.explode(F.sequence(F.lit(-width), F.lit(width))))
    a, r = F.col("k") * (2 * 3.141592653589793 / angles), F.greatest(F.lit(1), F.col("radius") + F.col("o"))
    at = at.select("image_id", "idx", F.bround(F.col("cx") + r * F.cos(a), 0).cast("int").alias("x"), F.bround(F.col("cy") + r * F.sin(a), 0).cast("int").alias("y"))
    met = at.join(pixels.select(*PIXEL, F.col(mask).cast("int").alias("_met")).hint("merge"), PIXEL)
    return met.groupBy("image_id", "idx").agg(F.avg("_met").alias("coverage"))


def label_near(points: DataFrame, labelled: DataFrame, radius: int = 7) -> DataFrame:
    """(image_id, idx, label): the label at a point, else the most frequent one in the square around it, the least of equals."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in square(2 * radius + 1)])
    at = points.select("image_id", "idx", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(offsets).alias("o"))
    at = at.select("image_id", "idx", (F.col("px") + F.col("o.dx")).alias("x"), (F.col("py") + F.col("o.dy")).alias("y"), ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).alias("exact"))
    n = at.join(labelled.select(*PIXEL, "label").hint("merge"), PIXEL).groupBy("image_id", "idx", "label").agg(F.count(F.lit(1)).alias("n"), F.max("exact").alias("exact"))
    return n.groupBy("image_id", "idx").agg(F.max_by("label", F.struct("exact", "n", -F.col("label"))).alias("label"))


def blurred(pixels: DataFrame, values: dict[str, Column], weights: list[tuple[int, int, float]]) -> DataFrame:
    """Adds weighted sums over a small kernel (dx, dy, weight); beyond the border the image is mirrored about its edge pixel."""
    reach, names = max(max(abs(dx), abs(dy)) for dx, dy, _ in weights), list(values)
    wide = pixels.withColumns({k: v.cast("double") for k, v in values.items()})

    def work(rows: pa.Table, grid, own: np.ndarray) -> pa.Table:
        for k in names:
            v = placed(np.nan_to_num(rows[k].to_numpy()), grid)
            for axis, n in enumerate(v.shape):  # an image without a second row or column has nothing to be mirrored
                v = np.pad(v, [(reach, reach) if axis == at else (0, 0) for at in (0, 1)], **({"mode": "reflect"} if n > 1 else {}))
            at = [(grid[0] + reach + dy, grid[1] + reach + dx) for dx, dy, _ in weights]
            found = sum(w * v[place] for place, (_, _, w) in zip(at, weights))
            rows = rows.set_column(rows.column_names.index(k), k, pa.array(found))
        return rows.filter(pa.array(own))

    return tiled(wide, reach, work, StructType([*pixels.schema.fields, *[StructField(k, DoubleType()) for k in names]]))


#: The 3 x 3 binomial kernel, by which a Gaussian of that size is taken.
BINOMIAL = [(dx, dy, (0.5 if dx == 0 else 0.25) * (0.5 if dy == 0 else 0.25)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def crown_core(pixels: DataFrame, texture: float = 30.0) -> DataFrame:
    """Adds core: green and lit, or dark but saturated; not road-like, not shadow; with local variance above `texture`."""
    p = blurred(pixels, {"_m": F.col("gray"), "_m2": F.col("gray") * F.col("gray")}, BINOMIAL)
    hue, s, v, exg = _between("h", 26, 110), F.col("s"), F.col("v"), F.col("exg")
    lit_core = hue & (s >= 48) & (v >= 52) & (exg >= 10) & (F.col("g") >= F.col("r") + 6)
    dark = hue & (s >= 40) & v.between(38, 75) & (exg >= 6) & (F.col("g") >= F.col("r"))
    ok = (lit_core | dark) & ~((s < 22) & (v > 68)) & ~((v < 30) & (exg < 6))
    varied = F.greatest(F.col("_m2") - F.col("_m") * F.col("_m"), F.lit(0.0)) > texture
    return p.withColumn("core", ok & varied).drop("_m", "_m2")


def original_mask(pixels: DataFrame) -> DataFrame:
    """Adds original: a green hue and an excess-green index above the image's own Otsu level."""
    span = pixels.groupBy("image_id").agg(F.min("exg").alias("_lo"), F.max("exg").alias("_hi"))
    level = F.when(F.col("_hi") > F.col("_lo"), F.bround(255.0 * (F.col("exg") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), 0)).otherwise(0)
    p = pixels.join(span.join(otsu(pixels).hint("merge"), "image_id").hint("shuffle_hash"), "image_id")
    return p.withColumn("original", _between("h", 30, 100) & (level > F.col("threshold"))).drop("_lo", "_hi", "threshold")
