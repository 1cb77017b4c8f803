"""Corpus pipeline: five stages over documents, each an operator of quirelake.llm.

Each stage is a function of (spark, docs, sf_dir). run() writes what a stage returns as Parquet in the shared folder and reads it back as the next one's docs. All stages but the
last return the columns of their docs. Null texts, null ids and repeated rows are handled as the operators say; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import bpe, langid, mixing, near_copies, quality
from quirelake.llm.common import drop, written

#: Documents whose leading language holds less of the text are rejected.
LEAST_SHARE = 0.5


def _packed(docs: DataFrame) -> DataFrame:
    """The columns of docs in one struct d, so that none clashes with a stage's own, and the text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col("text").cast("string").alias("text"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined or whose leading language has under LEAST_SHARE of the text."""
    model = langid.learned(docs.where(~langid.held_out()).select("lang", "text"))
    judged = langid.predicted(_packed(docs), model)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select("d.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose host is rejected."""
    packed = _packed(docs).select("d", "text", F.col("d.source").alias("host"))
    # Texts are measured twice, once for the hosts alone, rather than written once more with their measures.
    bad = quality.host_verdicts(written(quality.hosts(quality.measured(packed, ["host"]), "host"), "hosts")).where("host_rejected").select("host")
    return quality.measured(packed, ["d", "host"]).where("NOT base_failed").join(bad, "host", "left_anti").select("d.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (similarity 0.8 or more over five-word shingles), the one with the least doc_id."""
    return near_copies.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by source towards the target shares."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), "doc_id", "source")
    return mixing.replicated(packed).select("d.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's tokens, and digest of what they decode to."""
    return bpe.digests(docs, *bpe.vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: SQL can't state language inference, components or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop(last)
        last = docs
    return docs
