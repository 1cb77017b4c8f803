"""Quality rules with host verdicts.

Each text is measured and held against RULES. Failures of each rule, and of any of them, are counted by host (column source); hosts
with few documents are drawn towards all hosts by a beta prior fitted to the hosts' own rates of that rule, so that one bad page
doesn't condemn a host. A host is rejected, and with it all of its documents, if the shrunk rate of a rule stands out: if it is over the
prior's mean by more than SPREADS of its standard deviations. That limit is never under half (clean documents of a host that
mostly holds clean ones stay) nor over nine in ten. By itself a document goes for the base rules alone, too few words or too many
repeated ones; symbols and repeated lines count against hosts.

Nulls and edge cases. A null or empty text has no words: all its counts are 0 and it fails. Documents without a host are judged
by the base rules alone. Repeated rows and ids each get their row and count each time. An empty table gives an empty result.
Only the id, text and host columns are read; other columns, whatever their names, are left out of the measures.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, word_blocks, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, SYMBOL_PERCENT, LINE_PERCENT, WIDTH = 50, 50, 10, 30, 3
SPREADS, LIMITS = 3.0, (0.5, 0.9)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*MEASURES, "n_lines"]
#: What makes a text fail each rule, over COUNTS, as Spark and DuckDB read it.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {SYMBOL_PERCENT} * word_chars",
    "dup_lines": f"100 * n_dup_lines > {LINE_PERCENT} * n_lines",
}
RULES["any_rule"] = " OR ".join(RULES.values())
BASE = f"{RULES['few_words']} OR {RULES['repeats']}"


def repeated_words(words: list[bytes], width: int = WIDTH) -> int:
    """Words that lie in a window of `width` words found twice or more, first finds included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == n:
        return 0
    again = {w for w, k in Counter(windows).items() if k > 1}
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in again:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """COUNTS of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = list(chain.from_iterable(word_blocks(text.encode())))
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        lines = text.split("\n")
        if len(set(lines)) < len(lines):
            for line in lines:
                if line in seen:
                    dup += bool(line.strip(SPACES))
                seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words), text.count("\n") + 1


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(t.as_py()) for t in b.column("__text")]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *cols], names=[*b.schema.names[:-1], *COUNTS])


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs, COUNTS and base_failed."""
    df = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    df = df.mapInArrow(_measure, f"{schema}, " + ", ".join(f"{m} long" for m in COUNTS))
    return df.withColumn("base_failed", F.expr(BASE))


def hosts(rows: DataFrame, host_col: str = "source") -> DataFrame:
    """n_docs and the failures of each rule by host; documents without a host are left out."""
    failed = [F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()]
    return rows.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), *failed)


def beta_prior(n: int, mean: float | None, var: float | None) -> tuple[float, float]:
    """Beta(a, b) by the moments of n hosts' failure rates; a prior worth one document where rates don't vary as a beta's would."""
    if not n:
        return 0.5, 0.5
    if n < 2 or not var or not 0 < mean < 1 or var >= mean * (1 - mean):
        return max(mean, 1e-3), max(1 - mean, 1e-3)
    k = mean * (1 - mean) / var - 1
    return mean * k, (1 - mean) * k


def reject_limit(a: float, b: float) -> float:
    """The shrunk rate over which a host stands out from Beta(a, b)."""
    low, high = LIMITS
    return min(high, max(low, a / (a + b) + SPREADS * sqrt(a * b / (a + b + 1)) / (a + b)))


def host_verdicts(by_host: DataFrame) -> DataFrame:
    """host, n_docs, the shrunk rate of each rule (rate_ and its name) and host_rejected."""
    rate = {name: F.col(name) / F.col("n_docs") for name in RULES}
    moments = [f(rate[name]).alias(f"{part}_{name}") for name in RULES for part, f in (("mean", F.avg), ("var", F.var_samp))]
    m = by_host.agg(F.count("*").alias("n"), *moments).first()
    shrunk, over = [], F.lit(False)
    for name in RULES:
        a, b = beta_prior(m["n"], m[f"mean_{name}"], m[f"var_{name}"])
        drawn = (F.col(name) + F.lit(a)) / (F.col("n_docs") + F.lit(a) + F.lit(b))
        shrunk.append(drawn.alias(f"rate_{name}"))
        over |= drawn > reject_limit(a, b)
    return by_host.select("host", "n_docs", *shrunk, over.alias("host_rejected"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed, kept and host_rate (shrunk, of any rule; null without a host) for each row of docs."""
    rows = written(measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host")), ["doc_id", "host"]), "measures")
    verdict = written(host_verdicts(hosts(rows, "host")).select("host", F.col("rate_any_rule").alias("host_rate"), "host_rejected"), "hosts")
    kept = ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))
    return rows.join(verdict, "host", "left").select("doc_id", *MEASURES, "base_failed", kept.alias("kept"), "host_rate")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host_rate")


SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines FROM t),
win AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
tri AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM win),
again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM tri),
pos AS (SELECT DISTINCT rid, i + d AS p FROM again, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1),
rep AS (SELECT rid, count(*) AS n FROM pos GROUP BY rid),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM t),
dup AS (SELECT rid, sum(k - 1) AS n FROM (SELECT rid, l, count(*) AS k FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid, l) GROUP BY rid),
m AS (
  SELECT w.doc_id, w.source, n_lines, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup ON dup.rid = w.rid LEFT JOIN rep ON rep.rid = w.rid),
f AS (SELECT *, {BASE} AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, [{", ".join(f"count(*) FILTER ({rule})" for rule in RULES.values())}] AS failed FROM f WHERE source IS NOT NULL GROUP BY source),
hr AS (SELECT source, n, unnest(failed) AS k, unnest(range({len(RULES)})) AS rule FROM h),
p AS (SELECT rule, count(*) AS c, avg(k / n) AS mu, var_samp(k / n) AS v FROM hr GROUP BY rule),
flat AS (SELECT *, c < 2 OR v = 0 OR mu <= 0 OR mu >= 1 OR v >= mu * (1 - mu) AS one FROM p),
ab AS (
  SELECT rule, CASE WHEN one THEN greatest(mu, 1e-3) ELSE mu * (mu * (1 - mu) / v - 1) END AS a,
    CASE WHEN one THEN greatest(1 - mu, 1e-3) ELSE (1 - mu) * (mu * (1 - mu) / v - 1) END AS b FROM flat),
lim AS (SELECT *, least({LIMITS[1]}, greatest({LIMITS[0]}, a / (a + b) + {SPREADS} * sqrt(a * b / (a + b + 1)) / (a + b))) AS most FROM ab),
bad AS (SELECT source FROM hr JOIN lim USING (rule) WHERE (k + a) / (n + a + b) > most)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM f
"""
