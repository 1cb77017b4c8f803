"""Column expressions on pixels: integer channels b, g, r in 0..255 and gray."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds that define page classes (fixed values).
SATURATION, ACHROMATIC, INK, MID_LOW, MID_HIGH, GRADIENT, DARK = 45, 12, 100, 40, 220, 40, 170


def div(a: Column, b: Column | int) -> Column:
    """Integer division of non-negative values, inside whole-stage code."""
    return F.floor(a / b).cast("int")


def luma(b: str = "b", g: str = "g", r: str = "r") -> Column:
    return div(114 * F.col(b) + 587 * F.col(g) + 299 * F.col(r), 1000)


def spread(b: str = "b", g: str = "g", r: str = "r") -> Column:
    return F.greatest(b, g, r) - F.least(b, g, r)


def saturation(b: str = "b", g: str = "g", r: str = "r") -> Column:
    top = F.greatest(b, g, r)
    return F.when(top == 0, 0).otherwise(div(255 * spread(b, g, r), top))


def hue(b: str = "b", g: str = "g", r: str = "r") -> Column:
    """0..179: half the hue angle, rounded down; 0 where there is no colour."""
    B, G, R, s = F.col(b), F.col(g), F.col(r), spread(b, g, r)
    top = F.greatest(b, g, r)
    angle = F.when(s == 0, 0.0).when(top == R, 60.0 * (G - B) / s).when(top == G, 120 + 60.0 * (B - R) / s).otherwise(240 + 60.0 * (R - G) / s)
    return F.floor(F.when(angle < 0, angle + 360).otherwise(angle) / 2).cast("int")


def colourful() -> Column:
    return saturation() > SATURATION


def achromatic() -> Column:
    return spread() <= ACHROMATIC


def mid_gray() -> Column:
    return achromatic() & (F.col("gray") > MID_LOW) & (F.col("gray") < MID_HIGH)


def ink() -> Column:
    return F.col("gray") < INK


def share(mask: str | Column) -> Column:
    """Mean of a mask over the rows of a group."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    return F.avg(mask.cast("double"))
