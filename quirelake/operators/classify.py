"""Page classes from shares of masks, and what follows from them (all comparisons strict)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOB = 0.0008


def page_type(colour_blob: Column, gray_blob: Column, text: Column) -> Column:
    colour = F.when(text > 0.03, "mixed").when(text > 0.01, "color-text").otherwise("color-image")
    gray = F.when(text > 0.005, "gray-text").otherwise("gray-image")
    return F.when(colour_blob > BLOB, colour).when(gray_blob > BLOB, gray).otherwise("bw-text")


def coarse_type(text: Column) -> Column:
    return F.when(text < 0.005, "image").otherwise("text")


def plane_scale(mode: Column) -> Column:
    """Background shrink factor: a number, or 2 for auto."""
    return F.when(F.lower(mode) == "auto", 2).otherwise(mode.try_cast("int"))


def plane_denoise(mode: Column, kind: Column) -> Column:
    """Median size for the background: a number, or for auto 5 on gray text and 0 elsewhere."""
    return F.when(F.lower(mode) == "auto", F.when(kind == "gray-text", 5).otherwise(0)).otherwise(mode.try_cast("int"))
