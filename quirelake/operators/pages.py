"""Features, classes and regions of whole pages as Spark jobs over tiles: opened and smoothed masks, components across tiles, shares by page.

Pages are pixel rows (page, y, x, b, g, r) of any size; a task holds a tile with its margin (operators.tiles). Nothing here gathers a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixel as P
from . import classify as C
from . import components as CC
from . import tiles as T
from .raster import ellipse

#: Share of a page from which on a connected dark or coloured region is a figure, and the area under which a component is a speck (fixed values).
FIGURE, SPECK = 0.004, 24
#: By how much a gray figure is darker than paper, and the least deviation of its grays (fixed values).
DARKER, UNEVEN = 35, 12
#: Pixels of strips that are resampled at once.
CELLS = 1 << 20
BINOMIAL = [1, 4, 6, 4, 1]


def offsets(kernel: np.ndarray) -> list[tuple[int, int]]:
    """Offsets of a kernel's pixels from its middle."""
    return [(int(y) - kernel.shape[0] // 2, int(x) - kernel.shape[1] // 2) for y, x in np.argwhere(kernel)]


def _masks(t: T.Tile) -> dict[str, np.ndarray]:
    gray, there = t.planes["gray"], t.there
    near = T.folded(gray < P.INK, there, T.box(3), False)
    step = np.where(there, T.folded(gray, there, T.box(1), False) - T.folded(gray, there, T.box(1), True), 0)
    mid = (t.planes["spread"] <= P.ACHROMATIC) & (gray > P.MID_LOW) & (gray < P.MID_HIGH)
    return {
        "colour": T.opened(t.planes["sat"] > P.SATURATION, there, offsets(ellipse(9))),
        "text": (T.mirrored_sum(step, t.ends(), BINOMIAL) + 128) // 256 > P.GRADIENT,
        "mid": mid,
        "content": mid & (near == 0),
    }


def masks(px: DataFrame, size: int = T.SIZE) -> DataFrame:
    """page, y, x and as 0 or 1: colour (opened by the 9 x 9 ellipse), text (smoothed 5 x 5), mid (mid-gray) and content (mid-gray away from ink)."""
    rows = px.select("page", "y", "x", P.luma().alias("gray"), P.saturation().alias("sat"), P.spread().alias("spread"))
    return T.over(rows, ["gray", "sat", "spread"], _masks, dict.fromkeys(["colour", "text", "mid", "content"], "int"), size, 8)


def ratios(masks: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("double"))
    return masks.groupBy("page").agg(share("colour").alias("color_ratio"), share("text").alias("text_ratio"), share("mid").alias("gray_ratio"), F.count("*").alias("pixels"))


def features(masks: DataFrame, width: int, size: int = T.SIZE) -> DataFrame:
    """Ratios with color_blob and gray_blob, the shares of the largest components, from masks that are kept as a table."""
    out = ratios(masks)
    for mask, name in (("colour", "color_blob"), ("content", "gray_blob")):
        lab = CC.labels(masks.withColumn("m", F.col(mask) == 1), "m", width, size=size)
        top = lab.groupBy("page", "label").count().groupBy("page").agg(F.max("count").alias("n"))
        out = out.join(top, "page", "left").withColumn(name, F.coalesce("n", F.lit(0)) / F.col("pixels").cast("double")).drop("n")
    return out.drop("pixels")


def classified(features: DataFrame) -> DataFrame:
    return features.withColumn("type", C.page_type(F.col("color_blob"), F.col("gray_blob"), F.col("text_ratio")))


def blobs(px: DataFrame, masks: DataFrame, width: int, height: int, most: int = 3, size: int = T.SIZE) -> DataFrame:
    """page, rank, area, mean, std, darkness against paper (the 90th percentile), border of the largest components of content; border: within four pixels of the page's edge."""
    gray = px.select("page", "y", "x", P.luma().alias("gray"))
    lab = CC.labels(masks.withColumn("m", F.col("content") == 1), "m", width, size=size).join(gray, ["page", "y", "x"])
    edge = (F.least("y", "x") <= 4) | (F.col("y") >= height - 5) | (F.col("x") >= width - 5)
    value = F.col("gray").cast("double")
    each = lab.groupBy("page", "label").agg(F.count("*").alias("area"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.bool_or(edge).alias("border"))
    paper = gray.groupBy("page").agg(F.percentile("gray", F.lit(0.9)).alias("p90"))
    rank = F.row_number().over(W.partitionBy("page").orderBy(F.desc("area"), "label"))
    top = each.withColumn("rank", rank).where(F.col("rank") <= most).join(paper, "page")
    r6 = lambda c, name: F.round(c, 6).alias(name)
    return top.select("page", "rank", "area", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"), r6(F.col("p90") - F.col("mean"), "darkness"), "border")


def strict_type(features: DataFrame, blobs: DataFrame) -> DataFrame:
    """features with type and strict: the class where gray asks for a region that is dark and uneven enough for a figure."""
    figure = blobs.where((F.col("darkness") > DARKER) & (F.col("std") > UNEVEN)).select("page", F.lit(1.0).alias("figure")).distinct()
    both = classified(features).join(figure, "page", "left")
    return both.withColumn("strict", C.page_type(F.col("color_blob"), F.coalesce("figure", F.lit(0.0)), F.col("text_ratio"))).drop("figure")


def widened(px: DataFrame, mask: str, kernel: np.ndarray, size: int = T.SIZE) -> DataFrame:
    """page, y, x, c: the mask (0 or 1), dilated by a kernel."""
    f = lambda t: {"c": T.folded(t.planes[mask], t.there, offsets(kernel), False)}
    return T.over(px, [mask], f, {"c": "int"}, size, max(kernel.shape) // 2)


def median(px: DataFrame, value: str, k: int, size: int = T.SIZE) -> DataFrame:
    """Median over k x k, the edge pixel going on beyond the edge."""

    def f(t: T.Tile) -> dict[str, np.ndarray]:
        out, r = np.zeros_like(t.planes[value]), k // 2
        part = np.pad(t.planes[value][t.ends()], r, mode="edge")
        views = np.lib.stride_tricks.sliding_window_view(part, (k, k))
        for i in range(len(views)):  # a row at a time, so that windows of one row are in memory
            out[t.ends()[0].start + i, t.ends()[1]] = np.partition(views[i].reshape(views.shape[1], -1), k * k // 2, axis=1)[:, k * k // 2]
        return {value: out}

    return T.over(px, [value], f, {value: "int"}, size, k // 2)


def local_ink(px: DataFrame, k: int, less: int, size: int = T.SIZE) -> DataFrame:
    """page, y, x, ink: 1 where gray isn't over the Gaussian mean of k x k (rounded) less a constant; the edge pixel goes on beyond the edge."""
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    taps = np.exp(-(np.arange(-(k // 2), k // 2 + 1) ** 2) / (2 * sigma**2))
    taps /= taps.sum()

    def f(t: T.Tile) -> dict[str, np.ndarray]:
        gray, out = t.planes["gray"], np.zeros_like(t.planes["gray"])
        part = gray[t.ends()].astype(np.float64)
        for axis in (1, 0):
            wide = np.pad(part, [(k // 2, k // 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
            part = sum(w * np.take(wide, range(i, i + part.shape[axis]), axis=axis) for i, w in enumerate(taps))
        out[t.ends()] = gray[t.ends()] <= np.rint(part) - less
        return {"ink": out}

    return T.over(px, ["gray"], f, {"ink": "int"}, size, k // 2)


def padded(px: DataFrame, value: str, top: int, left: int) -> DataFrame:
    """Pages with rows added at the top and columns at the left, that repeat the first ones."""
    spread = lambda c, n: F.explode(F.when(F.col(c) == 0, F.sequence(F.lit(0), F.lit(n))).otherwise(F.array(F.col(c) + n)))
    rows = px.withColumn("__y", spread("y", top)).withColumn("__x", spread("x", left))
    return rows.select("page", F.col("__y").cast("int").alias("y"), F.col("__x").cast("int").alias("x"), value)


def lines(px: DataFrame, value: str) -> DataFrame:
    """page, y, xs and grays: the places and values of each line of pixel rows."""
    rows = px.where(f"page IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL AND `{value}` IS NOT NULL").groupBy("page", "y").agg(F.collect_list(F.struct("x", F.col(value).alias("g"))).alias("p"))
    return rows.select("page", "y", F.col("p")["x"].alias("xs"), F.col("p")["g"].alias("grays"))


class Taps:
    """Weights of source places for each new place along a side, as tables (place, tap) of a kind; places of few taps have zeros."""

    def __init__(self, taps: DataFrame) -> None:
        kind, i, src, w = (taps.toArrow().column(c).to_numpy() for c in ("kind", "i", "src", "w"))
        self.sources = int(src.max()) + 1
        self.low, self.high = np.full(i.max() + 1, self.sources), np.zeros(i.max() + 1, np.int64)
        np.minimum.at(self.low, i, src)
        np.maximum.at(self.high, i, src)
        self.span = int(max((self.high - self.low).max(), 0))
        self.kinds = {}
        for k in sorted(set(kind)):
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(i[own], kind="stable")]
            n = np.bincount(i[own], minlength=len(self.low))
            at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            place, weight = np.zeros((len(n), n.max()), np.int64), np.zeros((len(n), n.max()))
            place[i[own], at], weight[i[own], at] = src[own], w[own]
            self.kinds[k] = place, weight

    def along(self, planes: np.ndarray, there: np.ndarray, kind: str, places: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The sums of new places along the last axis, whose first place is top, and where any source is there."""
        place, weight = (x[places] for x in self.kinds[kind])
        out, any_there = np.zeros((*planes.shape[:-1], len(places))), np.zeros((*planes.shape[:-1], len(places)), bool)
        for k in range(place.shape[1]):
            at = np.clip(place[:, k] - top, 0, planes.shape[-1] - 1)
            out += weight[:, k] * planes[..., at]
            any_there |= there[..., at] & (weight[:, k] != 0)
        return out, any_there


def resampled(rows: DataFrame, taps: DataFrame, size: int = T.SIZE) -> DataFrame:
    """page, kind, y and a line's grays, with null where no source is there, of pages given line by line (page, y, xs, grays), by a table of taps (kind, i, src, w): the weights of source places for each new place along a side.

    Pages are dealt out in strips of `size` lines with those below that taps reach, so a task holds strips and never a page. Taps are as many as a side's pixels times a kernel's reach: few, and broadcast. Of values for one pixel all count."""
    weights = Taps(taps)
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def made(t: Taps, pages: list, strip: int, ys: np.ndarray, xs: pa.ListArray, grays: pa.ListArray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Lines of strips of one number; at says which of pages each pixel belongs to, ys its line."""
        height = size + t.span
        planes, there = np.zeros((len(pages), height, t.sources)), np.zeros((len(pages), height, t.sources), bool)
        ok = (xs >= 0) & (xs < t.sources) & (ys >= 0) & (ys < t.sources)
        where = at[ok], ys[ok] - strip * size, xs[ok]
        np.add.at(planes, where, grays[ok])
        there[where] = True
        new = np.flatnonzero(t.low // size == strip)
        if not len(new):
            return
        for kind in t.kinds:
            across, seen = t.along(planes, there, kind, np.arange(len(t.low)), 0)
            down, seen = t.along(across.swapaxes(1, 2), seen.swapaxes(1, 2), kind, new, strip * size)
            level, seen = np.clip(np.rint(down.swapaxes(1, 2)), 0, 255).astype(np.int32), seen.swapaxes(1, 2)
            n, y = np.nonzero(seen.any(axis=2))
            values = pa.array(level[n, y].ravel(), mask=None if seen.all() else ~seen[n, y].ravel())
            ends = np.arange(len(n) + 1, dtype=np.int32) * len(t.low)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(pages)[n], pa.int64()), pa.array([kind] * len(n)), pa.array(new[y].astype(np.int32)), pa.ListArray.from_arrays(ends, values)], names=["page", "kind", "y", "grays"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        most = max(1, CELLS // ((size + t.span) * t.sources))
        for b in batches:
            numbers = b.column("strip").to_numpy()
            for strip in np.unique(numbers):
                own = np.flatnonzero(numbers == strip)
                for i in range(0, len(own), most):
                    part = b.take(pa.array(own[i : i + most]))
                    each = part.column("lines")
                    line = each.flatten()
                    xs, grays = line.field("xs"), line.field("grays")
                    n = xs.value_lengths().to_numpy(zero_copy_only=False)
                    page = np.repeat(np.arange(len(part)), each.value_lengths().to_numpy(zero_copy_only=False))
                    yield from made(t, part.column("page").to_pylist(), int(strip), np.repeat(line.field("y").to_numpy(), n), xs.flatten().to_numpy(), grays.flatten().to_numpy(), np.repeat(page, n))

    strips = F.sequence(F.greatest(F.floor((F.col("y") - weights.span) / size), F.lit(0)).cast("int"), F.floor(F.col("y") / size).cast("int"))
    rows = rows.where("page IS NOT NULL AND y >= 0").select("page", F.explode(strips).alias("strip"), F.struct("y", "xs", "grays").alias("line"))
    return rows.groupBy("page", "strip").agg(F.collect_list("line").alias("lines")).mapInArrow(run, "page long, kind string, y int, grays array<int>")
