"""Language identification as inference of a multilingual mixture.

A language is a distribution over hashed character trigrams, learned from all labelled rows that are not held out. A text is seen as a mixture: each of its trigrams
comes from one of a few languages. Expectation-maximisation estimates the proportions; the set of languages is the one whose likelihood, less half the logarithm
of the text's length for each further language (times PENALTY), is highest among the sets of the leading 1, 2, ... languages, up to all. The language with the largest proportion in the chosen set is
the prediction and the proportion its score.

Texts are lower-cased, everything but letters counts as one space. Trigrams are hashed to 2**BITS classes, so a language takes a fixed amount of memory; the model that is
broadcast has one column for each language and is bounded by the number of languages, not by the rows.

Nulls and edge cases. A null text or one without a letter is `und` with score 0, and so is every text where nothing was learned. A null lang is not learned from, nor is a row with a null
id, which counts as held out. Ties go to the language that comes first by name. Texts of any length are read whole, in blocks. Repeated rows count each time. An empty
table gives an empty result. Only id, text and lang are read, lang for learning alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

BITS, ALPHA, PENALTY, ROUNDS, TOLERANCE, FOLDS = 15, 0.5, 3.0, 60, 1e-3, 5
BLOCK = 1 << 21
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """Classes of all trigrams of a whole text, between spaces; none if it has no letter."""
    out, letters = [], _letters()
    last = np.array([32], np.uint32)
    for at in range(0, len(text), BLOCK):
        code = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters[code]
        code = np.concatenate([last, np.where(letter, code, 32).astype(np.uint32)])
        code = code[np.concatenate([[True] * len(last), (code[len(last) :] != 32) | (code[len(last) - 1 : -1] != 32)])]
        if at + BLOCK >= len(text) and code[-1] != 32:
            code = np.append(code, np.uint32(32))
        if len(code) > 2:
            x = code.astype(np.uint64)
            mixed = (x[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x[2:] * np.uint64(0x165667B19E3779F9))
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
        last = code[-2:]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            if len(x := trigrams(text.as_py() or "")):
                total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                total[lang] += np.bincount(x, minlength=1 << BITS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "class", "n"])


class Mixture:
    """Distributions of the learned languages and what can be inferred with them."""

    def __init__(self, langs: list[str], count: np.ndarray) -> None:
        self.langs = langs  # in order of name
        n = count.astype(np.float64) + ALPHA
        self.p = n / n.sum(axis=0)

    def infer(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Proportions (texts x languages) of the chosen sets; found: classes and their counts of texts with at least one trigram."""
        length = np.array([len(c) for c, _ in found])
        starts = np.cumsum([0, *length[:-1]])
        own = np.repeat(np.arange(len(found)), length)
        p, n = self.p[np.concatenate([c for c, _ in found])], np.concatenate([k for _, k in found]).astype(np.float64)
        total = np.add.reduceat(n, starts)

        def rounds(share: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
            """Settled proportions and their log-likelihood."""
            share, open_ = share.copy(), np.arange(len(found))
            at, rows, begin = slice(None), own, starts
            for _ in range(most):
                w = p[at] * share[rows]
                w *= (n[at] / w.sum(axis=1))[:, None]
                new = np.add.reduceat(w, begin, axis=0) / total[open_][:, None]
                moving = np.abs(new - share[open_]).max(axis=1) >= TOLERANCE
                share[open_] = new
                if not moving.any():
                    break
                if not moving.all():
                    open_ = open_[moving]
                    at = np.concatenate([np.arange(starts[i], starts[i] + length[i]) for i in open_])
                    rows, begin = own[at], np.cumsum([0, *length[open_][:-1]])
            return share, np.add.reduceat(n * np.log((p * share[own]).sum(axis=1)), starts)

        full, _ = rounds(np.full((len(found), len(self.langs)), 1 / len(self.langs)), ROUNDS)
        place = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
        best, best_value = None, None
        for k in range(1, len(self.langs) + 1):
            share = np.where(place < k, full + 1e-12, 0.0)
            share, value = rounds(share / share.sum(axis=1, keepdims=True), 0 if k == 1 else ROUNDS)
            value = value - PENALTY * 0.5 * (k - 1) * np.log(total)
            if best is None:
                best, best_value = share, value
            else:
                better = value > best_value
                best, best_value = np.where(better[:, None], share, best), np.where(better, value, best_value)
        return best

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        held: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []

        def close() -> None:
            for (i, _), share in zip(held, self.infer([x for _, x in held])):
                lang[i], score[i] = self.langs[int(share.argmax())], min(1.0, float(share.max()))
            held.clear()

        size = 0
        for i, t in enumerate(texts):
            if self.langs and t and len(x := trigrams(t)):
                n = np.bincount(x, minlength=1 << BITS)
                at = np.flatnonzero(n)
                held.append((i, (at, n[at])))
                size += len(at)
                if size > 1 << 17:
                    close()
                    size = 0
        if held:
            close()
        return lang, score


def learned(rows: DataFrame):
    """Broadcast Mixture of rows (lang, text); the counts that reach the driver are 2**BITS rows a language at most."""
    counts = rows.where("lang IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(_learn, "lang string, class int, n long")
    counts = written(counts.groupBy("lang", "class").agg(F.sum("n").alias("n")), "trigrams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().toLocalIterator())
    place = {x: i for i, x in enumerate(langs)}
    count = np.zeros((1 << BITS, len(langs)), np.int64)
    for b in counts.toArrow().to_batches():
        count[b.column(1).to_numpy(), [place[x] for x in b.column(0).to_pylist()]] = b.column(2).to_numpy()
    return rows.sparkSession.sparkContext.broadcast(Mixture(langs, count))


def _predict(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = held.value.predict(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return run


def predicted(rows: DataFrame, model) -> DataFrame:
    """The columns of rows but the last, which holds the text, with lang_pred and score."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_predict(model), f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(True))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs, learned from the rows of docs that aren't held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    model = learned(rows.where("NOT held_out").select("lang", "text"))
    return predicted(rows.select("doc_id", "held_out", "text"), model)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))
