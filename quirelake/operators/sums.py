"""Sums over rectangles of pages by summed-area tables: two windows make the table, four look-ups answer any rectangle, so the cost doesn't depend on its size.

A window holds one row or one column of a page, never the page. Look-ups are requests that travel to their place of the table by page, y and x and come back as signed sums, by partial sums.

Nulls and edge cases. Pages are rectangles from (0, 0) without gaps; a null value counts as zero. Rectangles are cut off at the page's ends. Sums are 64-bit integers. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def summed(px: DataFrame, value: str) -> DataFrame:
    """page, y, x, s: the sum of the values above and to the left, the place's own included."""
    before = lambda part, order: W.partitionBy("page", part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = px.select("page", "y", "x", F.sum(F.coalesce(F.col(value).cast("long"), F.lit(0))).over(before("y", "x")).alias("s"))
    return rows.withColumn("s", F.sum("s").over(before("x", "y")))


def looked_up(asked: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """keys and total, the sum of weight * s over the requests (keys, page, y, x, weight) of each key; places above or left of the page are zero."""
    rows = asked.join(table, ["page", "y", "x"], "left")
    return rows.groupBy(*keys).agg(F.sum(F.coalesce(F.col("weight") * F.col("s"), F.lit(0))).alias("total"))


def box_sums(px: DataFrame, value: str, radius: int) -> DataFrame:
    """page, y, x, total and n: sum and number of pixels of the box around each pixel, within the page."""
    sizes = px.groupBy("page").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    rows = px.select("page", "y", "x").join(sizes, "page")
    low = lambda c: F.greatest(F.col(c) - radius, F.lit(0))
    high = lambda c, most: F.least(F.col(c) + radius, F.col(most))
    corner = lambda y, x, sign: F.struct(y.alias("y"), x.alias("x"), F.lit(sign).alias("weight"))
    top, left, bottom, right = low("y") - 1, low("x") - 1, high("y", "h"), high("x", "w")
    asked = rows.select("page", F.col("y").alias("py"), F.col("x").alias("px"), ((bottom - top) * (right - left)).cast("long").alias("n"), F.explode(F.array(corner(bottom, right, 1), corner(top, right, -1), corner(bottom, left, -1), corner(top, left, 1))).alias("c"))
    found = looked_up(asked.select("page", "py", "px", "n", "c.*"), ["page", "py", "px", "n"], summed(px, value))
    return found.select("page", F.col("py").alias("y"), F.col("px").alias("x"), "total", "n")


def mean_ink(px: DataFrame, radius: int, less: int) -> DataFrame:
    """page, y, x, ink: 1 where gray isn't over the mean of the box less a constant, in whole numbers."""
    rows = px.join(box_sums(px, "gray", radius), ["page", "y", "x"])
    return rows.select("page", "y", "x", (F.col("gray") * F.col("n") <= F.col("total") - less * F.col("n")).cast("int").alias("ink"))


def area_resized(px: DataFrame, value: str, side: int, new: int) -> DataFrame:
    """page, y, x, value: square pages of `side` pixels shrunk to `new` by area means, halves up. A bound between pixels is a weighted mean of the table's entries on both sides of it, in whole numbers."""

    def bounds(c: Column) -> Column:
        """The table's entries (place, weight) that make up the sum up to c * side / new pixels, in units of 1 / new pixel."""
        whole, part = F.floor(c * side / new).cast("int"), (c * side) % new
        entry = lambda at, w: F.struct(at.cast("int").alias("at"), w.cast("long").alias("w"))
        return F.filter(F.array(entry(whole - 1, new - part), entry(whole, part)), lambda e: (e["w"] > 0) & (e["at"] >= 0))

    cells = px.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(new - 1))).alias("i")).select("page", "i", F.explode(F.sequence(F.lit(0), F.lit(new - 1))).alias("j"))
    ends = lambda c: F.flatten(F.array(F.transform(bounds(F.col(c) + 1), lambda e: F.struct(e["at"].alias("at"), e["w"].alias("w"))), F.transform(bounds(F.col(c)), lambda e: F.struct(e["at"].alias("at"), (-e["w"]).alias("w")))))
    asked = cells.select("page", "i", "j", F.explode(ends("i")).alias("a")).select("page", "i", "j", "a", F.explode(ends("j")).alias("b"))
    asked = asked.select("page", "i", "j", F.col("a.at").alias("y"), F.col("b.at").alias("x"), (F.col("a.w") * F.col("b.w")).alias("weight"))
    found = looked_up(asked, ["page", "i", "j"], summed(px, value))
    area = side * side
    return found.select("page", F.col("i").alias("y"), F.col("j").alias("x"), F.floor((F.col("total") * 2 + area) / (2 * area)).cast("int").alias(value))
