"""Image measures over decoded pixels: rows (item, x, y, r, g, b) with channels 0..255. Decoding itself needs an imaging library and is
left to the source; from here on images are a table like any other, however large."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workers import shipped

# fixed values: linear sRGB to XYZ for D65, its white point, and the bends of the two curves
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
# fixed values: weights of grey
GREY = (0.2989, 0.5870, 0.1140)


def _linear(c: Column) -> Column:
    u = c / F.lit(255.0)
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L, a, b of an sRGB colour."""
    rgb = [_linear(c) for c in (r, g, b)]

    def bend(row: tuple[float, float, float], white: float) -> Column:
        t = reduce(lambda x, y: x + y, [F.lit(w) * c for w, c in zip(row, rgb, strict=True)]) / F.lit(white)
        return F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * F.lit(24389 / 27) + 16) / 116)

    fx, fy, fz = (bend(row, w) for row, w in zip(TO_XYZ, WHITE, strict=True))
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def hue_saturation(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Hue in degrees (0 for grey) and saturation in [0, 1]."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = F.nullif(hi - lo, F.lit(0))
    h = F.when(hi == r, F.pmod((g - b) / d, F.lit(6.0))).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    return F.coalesce(h, F.lit(0.0)), F.coalesce((hi - lo) / F.nullif(hi, F.lit(0)), F.lit(0.0))


def colour_features(pixels: DataFrame, item: str = "item") -> DataFrame:
    """by item the mean of a and b, and the mean point on the hue circle, weighted by saturation."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    _, a, bb = lab(r, g, b)
    h, s = hue_saturation(r, g, b)
    p = pixels.select(item, a.alias("a"), bb.alias("b"), (F.cos(F.radians(h)) * s).alias("cx"), (F.sin(F.radians(h)) * s).alias("cy"))
    return p.groupBy(item).agg(*[F.avg(c).alias(c) for c in ("a", "b", "cx", "cy")])


def statistics(pixels: DataFrame, item: str = "item") -> DataFrame:
    """brightness, saturation, contrast, sharpness (variance of the Laplacian inside the border), blur, warmth, colourfulness,
    greenness. The Laplacian comes from windows over columns and rows, so no image has to fit a task's memory."""
    r, g, b = (F.col(c) / F.lit(255.0) for c in "rgb")
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    grey = reduce(lambda x, y: x + y, [F.lit(w) * c for w, c in zip(GREY, (r, g, b), strict=True)])
    p = pixels.select(item, "x", "y", hi.alias("hi"), ((hi - lo) / (hi + 1e-6)).alias("sat"), grey.alias("v"), (r - b).alias("warm"), (g - (r + b) / 2).alias("green"), (F.col("r") - F.col("g")).cast("double").alias("rg"), ((F.col("r") + F.col("g")) / 2 - F.col("b")).alias("yb"))
    across, down = Window.partitionBy(item, "y").orderBy("x"), Window.partitionBy(item, "x").orderBy("y")
    p = p.withColumn("h", F.lag("v").over(across) + F.lead("v").over(across)).withColumn("w", F.lag("v").over(down) + F.lead("v").over(down))
    g = p.withColumn("lap", F.col("h") + F.col("w") - 4 * F.col("v")).groupBy(item)
    sharp = F.coalesce(F.var_pop("lap"), F.lit(0.0))
    colourful = F.sqrt(F.var_pop("rg") + F.var_pop("yb")) + 0.3 * F.sqrt(F.pow(F.avg("rg"), 2) + F.pow(F.avg("yb"), 2))
    return g.agg(F.avg("hi").alias("brightness"), F.avg("sat").alias("saturation"), F.stddev_pop("v").alias("contrast"), sharp.alias("sharpness"), (1 / (sharp + 1e-6)).alias("blur"), F.avg("warm").alias("warmth"), colourful.alias("colourfulness"), F.avg("green").alias("greenness"))


def contours(grid: DataFrame, levels: list[float], x: str = "gx", y: str = "gy", value: str = "density") -> DataFrame:
    """Marching squares: (level, x1, y1, x2, y2) of the segments in every cell whose corners lie on both sides of a level. Where
    two opposite corners are inside, the cell's mean decides how they connect. Missing grid points count as 0."""
    corner = lambda dx, dy, n: grid.select((F.col(x) - dx).alias("cx"), (F.col(y) - dy).alias("cy"), F.lit(n).alias("n"), F.col(value).alias("v"))
    c = reduce(lambda a, b: a.unionByName(b), [corner(0, 0, 0), corner(1, 0, 1), corner(1, 1, 2), corner(0, 1, 3)])
    at = lambda n: F.coalesce(F.max(F.when(F.col("n") == n, F.col("v"))), F.lit(0.0))
    cells = c.groupBy("cx", "cy").agg(*[at(n).alias(f"v{n}") for n in range(4)]).where("cx >= 0 AND cy >= 0")
    cells = cells.crossJoin(F.broadcast(grid.sparkSession.createDataFrame([(float(v),) for v in levels], "level double")))
    corners = ((0, 0), (1, 0), (1, 1), (0, 1))

    def crossing(i: int) -> Column:
        """The point where the level crosses the edge from corner i to the next, else null."""
        j = (i + 1) % 4
        a, b, t = F.col(f"v{i}"), F.col(f"v{j}"), F.col("level")
        f = (t - a) / F.nullif(b - a, F.lit(0.0))
        point = F.struct(*[(F.col(c) + F.lit(float(corners[i][k])) + f * F.lit(float(corners[j][k] - corners[i][k]))).alias(n) for k, (c, n) in enumerate((("cx", "px"), ("cy", "py")))])
        return F.when((a >= t) != (b >= t), point)

    d = cells.select("*", *[crossing(i).alias(f"e{i}") for i in range(4)])
    points = F.filter(F.array("e0", "e1", "e2", "e3"), lambda p: p.isNotNull())
    d = d.withColumn("p", points).where(F.size("p") >= 2).withColumn("joined", ((F.col("v0") + F.col("v1") + F.col("v2") + F.col("v3")) / 4 >= F.col("level")) == (F.col("v0") >= F.col("level")))
    pair = lambda a, b: F.struct(F.element_at("p", a)["px"].alias("x1"), F.element_at("p", a)["py"].alias("y1"), F.element_at("p", b)["px"].alias("x2"), F.element_at("p", b)["py"].alias("y2"))
    segments = F.when(F.size("p") == 2, F.array(pair(1, 2))).when(F.col("joined"), F.array(pair(1, 2), pair(3, 4))).otherwise(F.array(pair(1, 4), pair(2, 3)))
    return d.select("level", F.inline(segments))


# fixed values: thresholds of the share of edges, weights of the grey that it reads, and the tangent that parts the four directions
WEAK, STRONG = 100, 200
EDGE_GREY = (0.299, 0.587, 0.114)
TANGENT = 0.41421356


def edges(grey: np.ndarray, weak: float = WEAK, strong: float = STRONG) -> np.ndarray:
    """Canny edges of one image: Sobel gradients of 3 x 3 pixels with the border repeated, |dx| + |dy| thinned along its direction, and
    what is above the weak threshold kept where it hangs together, corners included, with something above the strong one."""
    p = np.pad(grey.astype(np.int64), 1, mode="edge")
    row = lambda a: a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:]
    dy = row(p[2:]) - row(p[:-2])
    dx = row(p.T[2:]).T - row(p.T[:-2]).T
    m = np.pad(np.abs(dx) + np.abs(dy), 1)
    at = lambda j, i: m[1 + j : m.shape[0] - 1 + j, 1 + i : m.shape[1] - 1 + i]
    here, flat, steep = at(0, 0), np.abs(dy) < TANGENT * np.abs(dx), np.abs(dy) > (TANGENT + 2) * np.abs(dx)
    down = (dx < 0) == (dy < 0)
    top = np.where(flat, (here > at(0, -1)) & (here >= at(0, 1)), np.where(steep, (here > at(-1, 0)) & (here >= at(1, 0)), np.where(down, (here > at(-1, -1)) & (here > at(1, 1)), (here > at(-1, 1)) & (here > at(1, -1)))))
    thin = top & (here > weak)
    # components of the thinned pixels: each takes the least number around it, until none changes; then numbers of strong ones stay
    label = np.where(thin, np.arange(thin.size).reshape(thin.shape), thin.size)
    while True:
        wide = np.pad(label, 1, constant_values=thin.size)
        least = np.min([wide[j : j + label.shape[0], i : i + label.shape[1]] for j in range(3) for i in range(3)], axis=0)
        least = np.where(thin, least, thin.size)
        # a pixel's number names a pixel of its component, whose own number may be smaller still
        least = np.where(thin, np.append(least.ravel(), thin.size)[least], thin.size)
        if (least == label).all():
            break
        label = least
    return thin & np.isin(label, label[thin & (here > strong)])


def edge_share(pixels: DataFrame, item: str = "item") -> DataFrame:
    """(item, edges): the share of Canny edge pixels of each image, which a task holds as a whole. Pixels that aren't there are black."""
    grey = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for w, c in zip(EDGE_GREY, "rgb", strict=True)])
    p = pixels.select(item, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.round(grey).cast("int").alias("v"))

    def run(t: pa.Table) -> pa.Table:
        x, y, v = (t.column(c).to_numpy() for c in "xyv")
        grid = np.zeros((y.max() + 1, x.max() + 1), int)
        grid[y, x] = v
        return pa.table([t.column(item).slice(0, 1), pa.array([float(edges(grid).mean())])], names=[item, "edges"])

    return shipped(p).groupBy(item).applyInArrow(run, f"{item} {pixels.schema[item].dataType.simpleString()}, edges double")


def _overlaps(at: Column, size: Column, cells: int) -> Column:
    """(cell, share): the cells, of as many over the whole size, that a pixel's own stretch lies in, and how much of it, in cells."""
    lo, hi = at * cells / size, (at + 1) * cells / size
    cell = F.sequence(F.floor(lo).cast("int"), F.greatest(F.floor(lo), F.ceil(hi) - 1).cast("int"))
    return F.transform(cell, lambda c: F.struct(c.alias("cell"), (F.least(hi, c + 1) - F.greatest(lo, c.cast("double"))).alias("share")))


#: rows that a task makes of its pixels, about
SPREAD = 1 << 18


def resampled(pixels: DataFrame, width: int, height: int, item: str = "item") -> DataFrame:
    """(item, x, y, r, g, b) of width x height pixels: means of what they cover of an image of any size, by area. A pixel gives
    a row for each pixel that it reaches into. A small table may become a large one, so the number of tasks follows the rows to be made:
    pixels are dealt out by image, those of a large image by bands of rows, which are added up before the bands meet."""
    sizes = pixels.groupBy(F.col(item).alias("item_")).agg((F.max("x") + 1).cast("double").alias("w_"), (F.max("y") + 1).cast("double").alias("h_"))
    made = (F.col("w_") + width) * (F.col("h_") + height)
    parts = max(1, math.ceil((sizes.agg(F.sum(made)).first()[0] or 0) / SPREAD))
    p = pixels.join(sizes, F.col(item).eqNullSafe(F.col("item_"))).withColumn("band_", F.floor(F.col("y") * F.ceil(made / SPREAD) / F.col("h_"))).repartition(parts, item, "band_")
    p = p.select(item, "band_", *"rgb", F.explode(_overlaps(F.col("x").cast("double"), F.col("w_"), width)).alias("i"), _overlaps(F.col("y").cast("double"), F.col("h_"), height).alias("js"))
    p = p.select(item, "band_", *"rgb", "i", F.explode("js").alias("j")).withColumn("s", F.col("i.share") * F.col("j.share")).where("s > 1e-12")
    p = p.groupBy(item, "band_", F.col("i.cell").alias("x"), F.col("j.cell").alias("y")).agg(*[F.sum(F.col(c) * F.col("s")).alias(c) for c in "rgb"], F.sum("s").alias("s_"))
    return p.repartition(parts, item).groupBy(item, "x", "y").agg(*[(F.sum(c) / F.sum("s_")).alias(c) for c in "rgb"])


def colour_vectors(pixels: DataFrame, size: int = 32, item: str = "item", out: str = "v") -> DataFrame:
    """(item, v): the colours of size x size pixels in [0, 1], row by row: a vector where there is no model to make one."""
    rows = F.array_sort(F.collect_list(F.struct("y", "x", *[(F.col(c) / 255).alias(c) for c in "rgb"])))  # size * size rows
    return resampled(pixels, size, size, item).groupBy(item).agg(F.flatten(F.transform(rows, lambda p: F.array(p["r"], p["g"], p["b"]))).alias(out))


def pooled(cells: DataFrame, image: str, x: str, y: str, vector: str, parts: int) -> DataFrame:
    """(image, i, j, pooled): means over parts x parts equal pieces of each map; columns and rows beyond the last whole piece don't
    count. Channels are averaged as rows, so that a map may be of any size."""
    sizes = cells.groupBy(F.col(image).alias("image_")).agg(F.floor((F.max(y) + 1) / parts).alias("size_"))
    p = cells.join(sizes, F.col(image).eqNullSafe(F.col("image_"))).where("size_ > 0")
    p = p.select(image, F.floor(F.col(y) / F.col("size_")).alias("i"), F.floor(F.col(x) / F.col("size_")).alias("j"), F.posexplode(F.col(vector).cast("array<double>")).alias("c", "v")).where((F.col("i") < parts) & (F.col("j") < parts))
    p = p.groupBy(image, "i", "j", "c").agg(F.avg("v").alias("v"))
    return p.groupBy(image, "i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("pooled"))


def _corners(size: int, cells: int) -> list[tuple[int, int, float]]:
    """(pixel, cell, weight) of linear interpolation between the middles of cells, the outermost ones carried on."""
    out = []
    for p in range(size):
        at = min(max((p + 0.5) * cells / size - 0.5, 0.0), cells - 1.0)
        lo = min(int(at), max(cells - 2, 0))
        out += [(p, c, w) for c, w in ((lo, 1 - (at - lo)), (lo + 1, at - lo)) if w > 0]
    return out


def upsampled(cells: DataFrame, image: str, x: str, y: str, vector: str, width: int, height: int, size: int) -> DataFrame:
    """(image, px, py, feature): maps of width x height vectors at size x size pixels, bilinear. Spines of pixels are as small as maps."""
    spine = lambda p, c, w, n: F.broadcast(cells.sparkSession.createDataFrame(_corners(size, n), f"{p} int, {c} int, {w} double"))
    m = cells.join(spine("px", "cx_", "wx_", width), F.col(x) == F.col("cx_")).join(spine("py", "cy_", "wy_", height), F.col(y) == F.col("cy_"))
    m = m.select(image, "px", "py", F.posexplode(F.transform(F.col(vector).cast("array<double>"), lambda v: v * F.col("wx_") * F.col("wy_"))).alias("c", "v"))
    m = m.groupBy(image, "px", "py", "c").agg(F.sum("v").alias("v"))
    return m.groupBy(image, "px", "py").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("feature"))
