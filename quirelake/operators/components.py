"""Connected components of masked pixels, 8 neighbours, over pages of any size.

Each tile labels its own pixels; pairs of labels that touch across tile borders are links, found by a join of border pixels alone; rounds of stars give each label its root. No task holds more than a tile, and no driver more than a count. A label is the least position
(y * width + x) of its component, whatever the tiles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialised
from . import tiles as T
from .contraction import roots


def label_mask(mask: np.ndarray) -> np.ndarray:
    """Labels (least position in the component, -1 outside) of a boolean plane: least-label spreading with pointer jumping."""
    h, w = mask.shape
    own = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:
        pad = np.pad(own, 1, constant_values=h * w)
        near = np.minimum.reduce([pad[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)])
        new = np.where(mask, near, h * w)
        flat = np.append(new.ravel(), h * w)
        new = np.where(mask, flat[flat[new]], h * w)
        if (new == own).all():
            return np.where(mask, own, -1)
        own = new


def _own_labels(width: int):
    def run(tile: T.Tile) -> dict[str, np.ndarray]:
        lab = label_mask(tile.there)
        y, x = lab // lab.shape[1] + tile.top, lab % lab.shape[1] + tile.left
        return {"label": y * width + x}

    return run


def labels(df: DataFrame, mask: str, width: int, height: int | None = None, size: int = T.SIZE) -> DataFrame:
    """page, y, x, label of the pixels whose column `mask` is true. Pages are at most width wide; where they are known to fit one tile by height, too, nothing needs to be merged."""
    own = T.over(df.where(F.col(mask)).select("page", "y", "x"), [], _own_labels(width), {"label": "long"}, size)
    if width <= size and height is not None and height <= size:
        return own.withColumn("label", F.col("label").cast("int"))
    own = materialised(own, "labels")
    last, first = lambda c: F.col(c) % size == size - 1, lambda c: F.col(c) % size == 0
    edge = own.where(last("y") | last("x") | first("y") | first("x"))
    steps = [(0, 1), (1, -1), (1, 0), (1, 1)]
    near = F.filter(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps]), lambda p: (F.floor(p["y"] / size) != F.floor(F.col("y") / size)) | (F.floor(p["x"] / size) != F.floor(F.col("x") / size)))
    asked = edge.where(last("y") | last("x") | first("x")).select("page", F.col("label").alias("u"), F.explode(near).alias("n")).select("page", "u", "n.*")
    links = asked.join(edge.select("page", "y", "x", F.col("label").alias("v")), ["page", "y", "x"]).select("page", "u", "v").distinct()
    root = roots(links, ["page"]).withColumnRenamed("node", "label")
    return own.join(root, ["page", "label"], "left").select("page", "y", "x", F.coalesce("root", "label").cast("int").alias("label"))


def stats(labelled: DataFrame) -> DataFrame:
    """Area and bounding box by component."""
    size = lambda c: (F.max(c) - F.min(c) + 1).alias({"x": "w", "y": "h"}[c])
    return labelled.groupBy("page", "label").agg(F.count("*").alias("area"), F.min("x").alias("left"), F.min("y").alias("top"), size("x"), size("y"))


def largest_ratio(pages: DataFrame, labelled: DataFrame, pixels: int) -> DataFrame:
    """page, ratio of the largest component to the page (0 without any), for each row of pages."""
    top = labelled.groupBy("page", "label").count().groupBy("page").agg(F.max("count").alias("n"))
    return pages.join(top, "page", "left").select("page", (F.coalesce("n", F.lit(0)) / F.lit(float(pixels))).alias("ratio"))
