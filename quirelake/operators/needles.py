"""Passages of one table found in the texts of another, every hit, by an index of word pairs.

A passage that stands in a text brings its inner words with it whole, whatever its first and last word are glued to. Of its pairs of neighbouring inner words (or its one inner word), the one that texts hold least often is its key; texts give their pairs with
their places, and only those that are some passage's key meet it. Each such place says where the passage would have to begin, and the text there is compared. Pairs are counted by partial sums; a frequent pair is a key only where a passage has no rarer one, and
adaptive execution splits it. No passage meets a text that doesn't hold its key.

Nulls and edge cases. Null texts and null passages have no hits. Case and white space count. A passage of fewer than three words (parted by single spaces) has no inner word: an error, not a miss. Hits may overlap. Ids that repeat are rows of their own: their
hits add up. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialised


def _pairs(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, n (words of the row), pos, at (characters before the word), w and next of each word."""
    words = df.select(*keys, F.posexplode(F.split(text, " ", -1)).alias("pos", "w"), F.size(F.split(text, " ", -1)).alias("n"))
    row = W.partitionBy(*keys).orderBy("pos")
    at = F.coalesce(F.sum(F.char_length("w") + 1).over(row.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return words.select(*keys, "n", "pos", at.cast("int").alias("at"), "w", F.lead("w").over(row).alias("next"))


def hits(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id, at (from 1) of each place of texts (doc_id, text) where a passage (item_id, passage) stands."""
    texts = materialised(texts.where("text IS NOT NULL").withColumn("__row", F.monotonically_increasing_id()), "texts")
    passages = materialised(passages.where("passage IS NOT NULL").withColumn("__item", F.monotonically_increasing_id()), "passages")
    inner = _pairs(passages.withColumn("p", F.when(F.size(F.split("passage", " ", -1)) < 3, F.raise_error(F.concat(F.lit("passage of under three words: "), F.col("passage")))).otherwise(F.col("passage"))), ["__item"], "p")
    # Of four words or more, pairs of inner words; of three, the middle one with nothing behind it.
    pairs = inner.where("pos >= 1 AND (pos <= n - 3 OR n = 3 AND pos = 1)").select("__item", "at", "w", F.when(F.col("n") > 3, F.col("next")).alias("next"))
    asked = pairs.select("w", "next").distinct()
    own = _pairs(texts, ["__row"], "text").select("__row", "at", "w", F.explode(F.array_distinct(F.array(F.col("next"), F.lit(None).cast("string")))).alias("next"))
    same = lambda a, b: (a["w"] == b["w"]) & a["next"].eqNullSafe(b["next"])
    seen = materialised(own.join(asked, same(own, asked), "left_semi"), "pairs")
    counts = seen.groupBy("w", "next").agg(F.count("*").alias("c")).withColumnsRenamed({"w": "cw", "next": "cn"})
    counted = pairs.join(counts, (F.col("w") == F.col("cw")) & F.col("next").eqNullSafe(F.col("cn")), "left")
    key = counted.groupBy("__item").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "at", "w", "next")).alias("k")).where("k.c > 0").select("__item", F.col("k.at").alias("off"), F.col("k.w").alias("kw"), F.col("k.next").alias("kn"))
    near = seen.join(key, (F.col("w") == F.col("kw")) & F.col("next").eqNullSafe(F.col("kn"))).select("__row", "__item", (F.col("at") - F.col("off") + 1).alias("at")).where("at >= 1")
    both = near.join(texts, "__row").join(passages, "__item")
    return both.where(F.expr("substring(text, at, char_length(passage)) = passage")).select("doc_id", "item_id", "at")
