"""Neighbourhood operators over pixel rows (page, y, x, ...).

A box kernel is two windows, along x and then along y. Rows are dealt out by page once: windows over (page, y) and (page, x) both find
their rows together then, so a chain of such operators shuffles once. Range frames make page edges and gaps mean `no neighbour there`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Fold = Callable[[Column], Column]


def row():
    return W.partitionBy("page", "y").orderBy("x")


def column():
    return W.partitionBy("page", "x").orderBy("y")


def by_page(df: DataFrame) -> DataFrame:
    return df.repartition("page")


def box(df: DataFrame, value: str, radius: int, fold: Fold, out: str) -> DataFrame:
    """fold (F.max, F.min, F.sum) of `value` over the box of the radius around each pixel."""
    mid = df.withColumn("__row", fold(F.col(value)).over(row().rangeBetween(-radius, radius)))
    return mid.withColumn(out, fold(F.col("__row")).over(column().rangeBetween(-radius, radius))).drop("__row")


def dilate(df: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    return box(df, value, radius, F.max, out)


def erode(df: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    return box(df, value, radius, F.min, out)


def gradient(df: DataFrame, value: str, out: str) -> DataFrame:
    """Morphological gradient over 3 x 3: largest less smallest."""
    df = erode(dilate(df, value, 1, "__hi"), value, 1, "__lo")
    return df.withColumn(out, F.col("__hi") - F.col("__lo")).drop("__hi", "__lo")


def taps(df: DataFrame, value: str, weights: list[int], axis, out: str) -> DataFrame:
    """Weighted sum along one axis of gap-free pixels; beyond the edge the edge pixel goes on."""
    k = len(weights) // 2

    def at(d: int) -> Column:
        step = F.lag if d < 0 else F.lead
        return F.coalesce(*[step(value, i).over(axis) for i in range(abs(d), 0, -1)], F.col(value))

    return df.withColumn(out, sum((w * at(d) for d, w in zip(range(-k, k + 1), weights) if w), F.lit(0)))


def separable(df: DataFrame, value: str, across: list[int], down: list[int], out: str) -> DataFrame:
    return taps(taps(df, value, across, row(), "__taps"), "__taps", down, column(), out).drop("__taps")


def shrink(df: DataFrame, value: str, factor: int, out: str) -> DataFrame:
    """Area means, rounded down, of factor x factor cells."""
    cell = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("y", "x")]
    return df.groupBy("page", *cell).agg(F.floor(F.sum(value) / F.count("*")).cast("int").alias(out))


def enlarge(df: DataFrame, value: str, factor: int, out: str) -> DataFrame:
    """Each pixel factor x factor times."""
    d = F.sequence(F.lit(0), F.lit(factor - 1))
    df = df.withColumn("__dy", F.explode(d)).withColumn("__dx", F.explode(d))
    return df.select("page", (F.col("y") * factor + F.col("__dy")).alias("y"), (F.col("x") * factor + F.col("__dx")).alias("x"), F.col(value).alias(out))


def otsu(df: DataFrame, value: str = "gray") -> DataFrame:
    """page, threshold: the level that parts the histogram with the largest variance between its parts; the least such level."""
    hist = df.groupBy("page", F.col(value).alias("level")).agg(F.count("*").alias("n"))
    run = W.partitionBy("page").orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("page")
    moment = F.col("level") * F.col("n")
    hist = hist.select("page", "level", F.sum("n").over(run).alias("n0"), F.sum(moment).over(run).alias("m0"), F.sum("n").over(whole).alias("n1"), F.sum(moment).over(whole).alias("m1"))
    d = lambda c: F.col(c).cast("double")
    between = F.when(F.col("n0") == F.col("n1"), 0.0).otherwise(F.pow(d("m1") * d("n0") - d("m0") * d("n1"), 2.0) / (d("n0") * (d("n1") - d("n0"))))
    best = F.max(F.struct(between.alias("v"), (-F.col("level")).alias("l")))
    return hist.groupBy("page").agg(best.alias("best")).select("page", (-F.col("best.l")).alias("threshold"))


def origins(size: Column, tile: int, overlap: int) -> Column:
    """Where tiles begin along one side: every tile - overlap, the last one flush with the end; one tile if all fits."""
    last = F.greatest(size - tile, F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), last, F.lit(tile - overlap)), lambda o: o <= last), F.array(last))))
