"""Comparison of two libraries of books, layer by layer and bit by bit, by trees of hashes.

A layer comes as its rows: book, page, layer, w, h, bits, filter, y, data (the bytes of row y). Rows hash into layers, these into pages and these into books, by sums without carry (XOR) of two 64-bit hashes each, so partial sums do most of it before any exchange.
Books meet first, a row each; only where their hashes differ do pages meet, then layers, then rows. Two libraries that are equal cost one scan each and a join of a row a book.

Nulls and edge cases. A book, page or layer on one side alone is a mismatch. Null books, pages and layers meet their like. Rows of one layer are told apart by y; a layer's rows that repeat with other data are all part of its hash. Empty libraries are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = ["w", "h", "bits", "filter"]


def _xor(*parts) -> list[Column]:
    return [F.bit_xor(F.xxhash64(F.lit(i), *parts)).alias(f"h{i}") for i in range(2)]


def layers_of(rows: DataFrame) -> DataFrame:
    """book, page, layer, shape, h0, h1 of each layer. Shapes that rows of a layer give differently are layers apart."""
    return rows.groupBy("book", "page", "layer", *SHAPE).agg(*_xor("y", "data"))


def pages_of(layers: DataFrame) -> DataFrame:
    kinds = [F.count_if(F.col("bits") == 1).alias("templates"), F.count_if(F.col("bits") != 1).alias("photos")]
    return layers.groupBy("book", "page").agg(*_xor("layer", *SHAPE, "h0", "h1"), *kinds)


def books_of(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book").agg(*_xor("page", "h0", "h1"), F.count("*").alias("pages"), F.sum("templates").alias("templates"), F.sum("photos").alias("photos"))


def met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full join on keys, nulls with nulls: the keys, and each side's other columns as structs a and b, null where it has none."""
    side = lambda df, name: df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    on = [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys]
    both = side(a, "a").join(side(b, "b"), on, "full")
    return both.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], "a", "b")


def _differ(both: DataFrame) -> DataFrame:
    same = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a.h0") == F.col("b.h0")) & (F.col("a.h1") == F.col("b.h1"))
    return both.where(~F.coalesce(same, F.lit(False)))


def _within(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df whose keys are in found."""
    few = found.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return df.join(few, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_semi")


def bits_between(p: str, q: str) -> Column:
    """Number of bits in which two binary columns differ; bytes that one lacks count as zero."""
    byte = lambda c: f"coalesce(cast(conv(hex(substring({c}, i, 1)), 16, 10) AS int), 0)"
    return F.expr(f"aggregate(sequence(1, greatest(length({p}), length({q}), 1)), 0L, (s, i) -> s + bit_count({byte(p)} ^ {byte(q)}))")


def differing_layers(a: DataFrame, b: DataFrame) -> DataFrame:
    """book, page, layer, why, bits of each layer that isn't the same on both sides: missing in a or b, another shape, or bits of its rows."""
    la, lb = layers_of(a), layers_of(b)
    pa, pb = pages_of(la), pages_of(lb)
    books = _differ(met(books_of(pa), books_of(pb), ["book"]))
    pages = _differ(met(_within(pa, books, ["book"]), _within(pb, books, ["book"]), ["book", "page"]))
    at = ["book", "page"]
    keyed = lambda df: df.withColumn("shape", F.struct(*SHAPE)).drop(*SHAPE)
    layers = _differ(met(keyed(_within(la, pages, at)), keyed(_within(lb, pages, at)), [*at, "layer", "shape"]))
    key = [*at, "layer"]
    # A layer with another shape on each side came as two rows.
    each = layers.groupBy(*key).agg(F.count("a").alias("in_a"), F.count("b").alias("in_b"), F.count("*").alias("n"))
    why = F.when(F.col("in_b") == 0, "missing in b").when(F.col("in_a") == 0, "missing in a").when(F.col("n") > 1, "other shape").otherwise("other bits")
    each = each.select(*key, why.alias("why"))
    changed = each.where("why = 'other bits'")
    rows = met(_within(a.select(*key, "y", "data"), changed, key), _within(b.select(*key, "y", "data"), changed, key), [*key, "y"])
    bits = rows.select(*key, F.col("a.data").alias("p"), F.col("b.data").alias("q")).where("NOT (p <=> q)").select(*key, bits_between("coalesce(p, X'')", "coalesce(q, X'')").alias("bits")).groupBy(*key).agg(F.sum("bits").alias("bits"))
    both = met(each, bits, key)
    return both.select(*key, "a.why", F.col("b.bits").alias("bits"))


def report(a: DataFrame, b: DataFrame) -> DataFrame:
    """A row for each book of either side: pages on both, templates (1-bit layers) and photo layers compared, layers that differ, bits that differ, verdict."""
    books = met(books_of(pages_of(layers_of(a))), books_of(pages_of(layers_of(b))), ["book"])
    diff = differing_layers(a, b).withColumn("alone", F.col("why") != "other bits")
    kind = layers_of(a).groupBy("book", "page", "layer").agg(F.min(F.col("bits")).alias("depth"))
    diff = met(diff, kind, ["book", "page", "layer"]).where("a IS NOT NULL").select("book", "a.*", "b.depth")
    lost = lambda test: F.count_if(F.col("alone") & (F.col("why") != "missing in a") & test)
    sums = diff.groupBy("book").agg(F.count("*").alias("mismatches"), F.coalesce(F.sum("bits"), F.lit(0)).alias("bits"), lost(F.col("depth") == 1).alias("templates"), lost(F.col("depth") != 1).alias("photos"))
    both = met(books.select("book", F.col("a").alias("x"), F.col("b").alias("y")), sums, ["book"]).select("book", "a.x", "a.y", F.col("b").alias("s"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    done = lambda c: F.when(F.col("x").isNull() | F.col("y").isNull(), F.lit(0)).otherwise(n(f"x.{c}") - n(f"s.{c}")).cast("long")
    verdict = F.when(n("s.mismatches") > 0, "MISMATCH").otherwise("IDENTICAL")
    return both.select("book", n("x.pages").alias("pages_a"), n("y.pages").alias("pages_b"), done("templates").alias("templates_compared"), done("photos").alias("photo_layers_compared"), n("s.mismatches").alias("mismatches"), n("s.bits").alias("bits_differ"), verdict.alias("verdict"))
