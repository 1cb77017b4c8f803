"""Ranks over a whole table, without a window over it: rows are range-partitioned, sorted and numbered within their partition, and partitions' counts, added up, give each one's first rank.

The sorted rows are a table in the shared folder, so that both readings see the same partitions. The counts are a row a partition. Rows that agree in the order are ranked in an arbitrary order; give an order that no two rows share where that matters. Range bounds are
taken from the whole order, so one value that many rows share is still dealt out if the order goes on behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialised


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with the rank of each row, from 0, in that order."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of such an id number the partition, the lower 33 its rows.
    parts = materialised(parts.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)), "ranked")
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    first = counts.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    rows = parts.join(F.broadcast(first), "__part")  # a row for each partition
    return rows.withColumn(name, F.col("__first") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__id", "__first")
