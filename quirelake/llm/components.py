"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

All rounds are joins and aggregations; nothing about links is gathered on the driver but a count and a checksum a round. Each round is
written to the shared folder, so a lost executor costs one stage. A hub with very many links is the hot key of a join between two
plain exchanges, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _star(pairs: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """(pairs with each u's least neighbour m, itself included; the table of m to drop)."""
    least = written(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), tag)
    return pairs.join(least, "u"), least


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the least node of its component. Nulls, loops and repeated links are dropped; no links, no rows."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if state == before or not state.n:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star, least = _star(both, "large")
        large = written(star.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        drop(least), drop(edges)
        star, least = _star(large, "small")
        small = star.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        edges = written(small.where("u <> v").distinct(), "edges")
        drop(least), drop(large)
    member = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return member.unionByName(member.select(F.col("root").alias("node"), "root").distinct())
