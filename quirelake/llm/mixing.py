"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source that holds the share s of all rows and is to hold the share t of the mixture repeats its rows t / s times in the mean. Each row draws its own number of
copies from the Poisson distribution of that mean, by inverting it at a uniform number made of a hash of seed and id, so that any run, retry or layout of
the data gives the same copies. Copies are dealt out to partitions by a hash of seed, id and copy and sorted by it there: a global shuffle of fixed order.

Target shares default to the sources' shares raised to `power` (0.7) and scaled to sum to one: sources differ less than before, none vanishes. `epochs`
scales all means. Means over STEP are sums of several draws, so that exp(-mean) never underflows.

Nulls and edge cases. Rows without a source form a source of their own. A row without an id draws by the MD5 of its other columns, so such rows draw apart unless they agree in all of them. A null or empty text
counts as a row. Repeated rows draw the same numbers and stay distinct rows. Sources named in the weights but not in the table have no rows to repeat; sources not named have weight zero
when weights are given. Columns named copy or shuffle_key in the input are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POWER, SEED, STEP = 0.7, 17, 64.0
#: Sources up to which their rates are broadcast; beyond, they are joined by a shuffle.
BROADCAST = 5000


def uniform(*parts: Column | int | str) -> Column:
    """In [0, 1): 52 bits of the MD5 of the parts, which SQL engines agree on."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where what is left is under 1e-17."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("t"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["t"], F.array(acc["c"] + p)).alias("t"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["t"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """__source, mean, and the table and number of draws to invert; a row for each source, marked for broadcast if these are few."""
    n = docs.groupBy(F.col(source_col).alias("__source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else None
        n = n.withColumn("w", F.coalesce(given[F.col("__source")], F.lit(0.0)) if weights else F.lit(0.0))
    total = n.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("sources")).first()
    scale = epochs * (total["n"] or 0) / (total["w"] or 1.0)
    n = n.withColumn("mean", F.col("w") * F.lit(float(scale)) / F.col("n"))
    n = n.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("mean") / STEP)).cast("int"))
    n = n.select("__source", "mean", "draws", poisson_table(F.col("mean") / F.col("draws")).alias("cdf"))
    return F.broadcast(n) if total["sources"] <= BROADCAST else n


def drawn_by(docs: DataFrame, id_col: str) -> Column:
    """What a row's numbers are drawn by: its id, or else its other columns."""
    rest = [F.col(f"`{c}`").cast("string") for c in docs.columns if c != id_col]
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null|"), F.md5(F.concat_ws("|", *rest))))


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, epochs: float = 1.0, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs, each row once for each of its copies, with copy (from 0) and shuffle_key, globally shuffled."""
    docs = docs.drop("copy", "shuffle_key")
    rate = rates(docs, weights, power, epochs, source_col).withColumnRenamed("mean", "__mean").withColumnRenamed("draws", "__draws").withColumnRenamed("cdf", "__cdf")
    # Beyond BROADCAST sources adaptive execution splits hot sources of the join.
    rows = docs.join(rate, F.col(source_col).eqNullSafe(F.col("__source")), "left")
    key = drawn_by(docs, id_col)
    one = lambda i: F.size(F.filter("__cdf", lambda c: c < uniform(seed, key, i)))
    copies = F.when(F.col("__draws") == 1, one(F.lit(0))).otherwise(F.aggregate(F.sequence(F.lit(0), F.col("__draws") - 1), F.lit(0), lambda a, i: a + one(i)))
    rows = rows.withColumn("__copies", copies).where("__copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    rows = rows.withColumn("shuffle_key", uniform(seed, "order", key, F.col("copy"))).select(*docs.columns, "copy", "shuffle_key")
    return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS w FROM documents GROUP BY source),
tot AS (SELECT sum(n) AS n, sum(w) AS w FROM n),
rate AS (SELECT source, n.w * (1.0::DOUBLE * tot.n / tot.w) / n.n AS mean FROM n, tot),
cdf AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM rate
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
u AS (
  SELECT *, ('0x' || substr(md5('17|' || row_key || '|0'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM (SELECT *, coalesce(doc_id::VARCHAR, 'null|' || md5(concat_ws('|', text, lang, source, n_chars::VARCHAR))) AS row_key FROM documents)),
k AS (
  SELECT u.row_key, u.doc_id, u.text, u.lang, u.source, u.n_chars,
    (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND cdf.c < u.u) AS copies FROM u),
x AS (SELECT row_key, doc_id, text, lang, source, n_chars, unnest(range(copies))::INTEGER AS copy FROM k WHERE copies > 0)
SELECT * EXCLUDE (row_key), ('0x' || substr(md5('17|order|' || row_key || '|' || copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key FROM x
"""
