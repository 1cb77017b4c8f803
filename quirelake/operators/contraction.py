"""Roots of linked nodes within a key, by rounds of stars: every node passes its larger neighbours, then its smaller ones, on to the least node it knows.

Each round is two joins with partial minima and a table in the shared folder; a hub's links are the hot key of a join between plain exchanges, which adaptive execution splits. The driver sees a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialised


def _star(links: DataFrame, keys: list[str], larger: bool) -> DataFrame:
    least = links.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    known = links.join(least, [*keys, "u"])
    if larger:
        out = known.where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = known.select(*keys, F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select(*keys, "s.*")
    return out.where("u <> v").distinct()


def roots(links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, root (the least node it is linked with) for the nodes of links (keys, u, v); nodes without a link to another have no row."""
    state, before = materialised(links.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"), None
    while True:
        now = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*keys, "u", "v")).alias("x")).first()
        if now == before or not now.n:
            break
        before = now
        both = state.unionByName(state.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        state = materialised(_star(_star(both, keys, True), keys, False), "links")
    own = state.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(*keys, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own)
