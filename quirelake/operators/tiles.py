"""Pages cut into tiles, with borders copied to their neighbours: any operator of a bounded reach over pages of any size.

Pixel rows (page, y, x, ...) are dealt out by tile of `size` x `size` pixels; each pixel goes to every tile that it is within `reach` of, by one explode and one shuffle, so a task holds a tile with its margin and never a page. What a function makes of a tile is
kept for the tile's own pixels alone. A tile knows where the page ends: outside it nothing is there.

Nulls and edge cases. Pixels need page, y and x; rows without are dropped. Of rows for one pixel the last of an arbitrary order counts. Pages may lack pixels: these are not there, and have no result. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 256


@dataclass
class Tile:
    """Planes of a tile with its margin, which pixels are there, and the place of the first one on the page."""

    page: int
    top: int
    left: int
    there: np.ndarray
    planes: dict[str, np.ndarray]

    def ends(self) -> tuple[slice, slice]:
        """The part of the tile within the page's rectangle."""
        y, x = np.flatnonzero(self.there.any(axis=1)), np.flatnonzero(self.there.any(axis=0))
        return slice(y[0], y[-1] + 1), slice(x[0], x[-1] + 1)


def cut(px: DataFrame, values: list[str], size: int = SIZE, reach: int = 0) -> DataFrame:
    """page, ty, tx, pixels (array of structs of p, the place within the tile and its margin, and the values) of each tile that has pixels of its own."""
    side = size + 2 * reach
    tiles = lambda c: F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size))
    rows = px.where("page IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL")
    rows = rows.withColumn("ty", F.explode(tiles("y"))).withColumn("tx", F.explode(tiles("x"))) if reach else rows.withColumn("ty", F.floor(F.col("y") / size)).withColumn("tx", F.floor(F.col("x") / size))
    own = (F.floor(F.col("y") / size) == F.col("ty")) & (F.floor(F.col("x") / size) == F.col("tx"))
    place = ((F.col("y") - F.col("ty") * size + reach) * side + F.col("x") - F.col("tx") * size + reach).cast("int")
    out = rows.groupBy("page", "ty", "tx").agg(F.bool_or(own).alias("own"), F.collect_list(F.struct(place.alias("p"), *values)).alias("pixels"))
    return out.where("own").select("page", "ty", "tx", "pixels")


def over(px: DataFrame, values: list[str], f: Callable[[Tile], dict[str, np.ndarray]], out: dict[str, str], size: int = SIZE, reach: int = 0) -> DataFrame:
    """page, y, x and the planes that f makes of each tile (names and types in out), for the tile's own pixels. f gets a Tile with a margin of reach."""
    side = size + 2 * reach
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("pixels")
            flat, ends = lists.flatten(), np.cumsum([0, *lists.value_lengths().to_pylist()])
            columns = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("p", *values)}
            parts = []
            for i, (page, ty, tx) in enumerate(zip(*(b.column(c).to_pylist() for c in ("page", "ty", "tx")))):
                at = slice(ends[i], ends[i + 1])
                p = columns["p"][at]
                there = np.zeros(side * side, bool)
                there[p] = True
                planes = {}
                for n in values:
                    plane = np.zeros(side * side, columns[n].dtype if columns[n].dtype != object else np.int64)
                    plane[p] = columns[n][at]
                    planes[n] = plane.reshape(side, side)
                tile = Tile(page, ty * size - reach, tx * size - reach, there.reshape(side, side), planes)
                made = f(tile)
                y, x = np.nonzero(tile.there[reach : reach + size, reach : reach + size])
                parts.append([np.full(len(y), page), y + ty * size, x + tx * size, *(made[n][reach + y, reach + x] for n in out)])
            if parts:
                whole = [np.concatenate(c) for c in zip(*parts)]
                kinds = [pa.int64(), pa.int32(), pa.int32(), *(types[t] for t in out.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(whole, kinds)], names=["page", "y", "x", *out])

    schema = ", ".join(["page long, y int, x int", *(f"{n} {t}" for n, t in out.items())])
    return cut(px, values, size, reach).mapInArrow(run, schema)


# -- functions of a tile ----------------------------------------------------------------------------------------------


def shifted(plane: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """plane, moved so that each place holds the one dy below and dx to the right of it."""
    h, w = plane.shape
    out = np.full_like(plane, fill)
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = plane[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def folded(plane: np.ndarray, there: np.ndarray, offsets: list[tuple[int, int]], least: bool) -> np.ndarray:
    """The least or largest value that is there within the offsets of each place."""
    plane = plane.astype(np.int64)
    worst = np.iinfo(np.int64).max if least else np.iinfo(np.int64).min
    inside, fold = np.where(there, plane, worst), np.minimum if least else np.maximum
    out = np.full_like(inside, worst)
    for dy, dx in offsets:
        fold(out, shifted(inside, dy, dx, worst), out=out)
    return out


def opened(plane: np.ndarray, there: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Erosion, then dilation. It reaches twice as far as the offsets."""
    return folded(folded(plane, there, offsets, True), there, offsets, False)


def box(radius: int) -> list[tuple[int, int]]:
    d = range(-radius, radius + 1)
    return [(y, x) for y in d for x in d]


def mirrored_sum(plane: np.ndarray, ends: tuple[slice, slice], weights: list[int]) -> np.ndarray:
    """Weighted sums along x, then y, within the page's rectangle; beyond its ends it goes on mirrored, without the edge itself. True where the tile's margin reaches as far as the weights or the page ends."""
    k, out = len(weights) // 2, np.zeros_like(plane, np.int64)
    part = plane[ends].astype(np.int64)
    for axis in (1, 0):
        n = part.shape[axis]
        wide = np.pad(part, [(k, k) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if n > k else "symmetric")
        part = sum(w * np.take(wide, range(i, i + n), axis=axis) for i, w in enumerate(weights))
    out[ends] = part
    return out
