"""Dropping lines that stand in many documents, in DataFrame functions alone.

A line's key is the line without white space (U+0020, U+0009 to U+000D) at both ends, its letters A-Z lower-cased. Keys of `least_chars` code points or more that `least_docs` documents or more hold lose
all their lines, everywhere; other lines stay, joined by \\n.

Texts stay where they are until the end: a line travels as 128 bits of its key's hashes, its document and its place, 64 places of a document and key in one word of bits. These marks are range-partitioned by
key and document, so that a key that a third of all lines share is dealt out over partitions by document, and sorted by key, document and place. In that order the first mark of a document for a key is told by
its row number as the rows stream by; neither the word aggregation nor the window needs another exchange. First marks are counted by key with partial sums before their exchange; marks of popular keys meet their keys in a
plain join, whose hot keys adaptive execution splits, and become one bitmap a document: words of 64 lines, 1 for a line that stays, cut off after the last word that drops anything. Only these bitmaps are joined with the texts.

Nulls and edge cases. A null or empty text is one empty line, which stays. A document is an id with its text: rows that repeat both count once towards `least_docs` and each get their result; rows of one id, or without one, that differ in text
count apart. A text of any length is split within its row; a document's bitmap has a bit a line. An empty table gives an empty result. Columns other than id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, written

#: Code points of a key, and documents that hold it, from which on its lines go.
LEAST_CHARS, LEAST_DOCS = 1, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is. ASCII strings, where lower() does just that, take its faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def line_marks(texts: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """key1, key2, doc_id, text_hash, word, bits, first: 64 places of a document that share a key, sorted; first marks the first of a document and key."""
    lines = texts.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = lines.select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(SPACES)).alias("bare")).where(F.char_length("bare") >= least_chars)
    keys = bare.select("doc_id", "text_hash", "pos", lowered(F.col("bare")).alias("key"))
    marks = keys.select(F.xxhash64("key").alias("key1"), F.xxhash64(F.lit(1), "key").alias("key2"), "doc_id", "text_hash", F.shiftright("pos", 6).alias("word"), F.expr("shiftleft(1L, pos & 63)").alias("bit"))
    of = ["key1", "key2", "doc_id", "text_hash"]
    words = marks.repartitionByRange(*of).groupBy(*of, "word").agg(F.bit_or("bit").alias("bits")).sortWithinPartitions(*of, "word")
    return words.withColumn("first", F.row_number().over(W.partitionBy(*of).orderBy("word")) == 1)


def popular_keys(marks: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """key1, key2 of keys that so many documents hold."""
    return marks.where("first").groupBy("key1", "key2").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs).select("key1", "key2")


def keep_bitmaps(marks: DataFrame, popular: DataFrame) -> DataFrame:
    """doc_id, text_hash, keep: of each document that loses lines, words of 64 lines in order, 1 for a line that stays; lines after the last word stay."""
    gone = marks.join(popular, ["key1", "key2"]).groupBy("doc_id", "text_hash", "word").agg(F.bit_or("bits").alias("bits"))
    lists = gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
    full = "flatten(transform(w, (x, i) -> concat(array_repeat(-1L, x.word - if(i = 0, 0, w[i - 1].word + 1)), array(~x.bits))))"
    return lists.select("doc_id", "text_hash", F.expr(full).alias("keep"))


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and text, what is left, for each row of docs."""
    texts = _texts(docs, id_col, text_col)
    marks = written(line_marks(texts, least_chars), "lines")
    maps = keep_bitmaps(marks, popular_keys(marks, least_docs)).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    rows = texts.join(maps, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    kept = F.expr("filter(split(text, '\\n', -1), (x, i) -> coalesce(shiftright(get(keep, shiftright(i, 6)), i & 63) & 1L, 1L) = 1L)")
    rows = rows.select("doc_id", "text", (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.when(F.col("keep").isNotNull(), kept).alias("kept"))
    left = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    return rows.select("doc_id", "n_lines", F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), left.alias("text"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, md5(coalesce(text, '')) AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, t, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
p AS (SELECT key FROM (SELECT DISTINCT key, doc_id, t FROM k WHERE length(key) >= 1) x GROUP BY key HAVING count(*) >= 10),
g AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(p.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE p.key IS NULL), '') AS kept FROM k LEFT JOIN p USING (key) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM g
"""
