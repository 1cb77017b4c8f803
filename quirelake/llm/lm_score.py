"""Language-model scoring by cross-entropy difference.

Two word-bigram models of one form, one of the target texts and one of the background (all texts), share one vocabulary. A word is its 64-bit hash, a bigram a 64-bit mix of
its two words' hashes: every word and every bigram of the corpus has its own count, however many there are. Both models are interpolated the same way:

    p(w) = (c(w) + 1) / (n + V)          p(w | v) = (c(v w) + STRENGTH * p(w)) / (c(v) + STRENGTH)

V is the number of distinct words of all texts. Both p(w) and, for each v, p(w | v) add up to one over these words: c(v) in the second formula counts v as first word of a pair.
A text's score is the mean over its words of target loss minus background loss in nats; low scores look like the target.

How it is spread. Texts are dealt out to packs. A pack adds up its own counts and asks the buckets of hashes in which it has keys for the sums over all packs, one row for
each such bucket; the bucket answers in the order asked, and the pack scores its texts with the answers. A very common word is one entry of each pack. The sizes of both models and of the
vocabulary are summed up over the buckets and reach each pack in one row. Rows grow with the keys of the packs, never with packs times buckets; packs grow from PACK bytes with the root of the
corpus up to MOST bytes, so that a row keeps several keys. Nothing is broadcast and nothing but the size of the texts reaches the driver.

Nulls and edge cases. A null or empty text, or one without words, has n_tokens 0 and null losses. Rows that match no target row are background alone; a
null id is never a target. Repeated rows count each time. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import word_blocks

STRENGTH = 20.0
#: Least and most bytes of a pack's texts, with the bytes of the corpus for each of their squares; a small corpus has up to PACKS smaller ones.
PACK, MOST, ROOT, PACKS = 4 << 20, 64 << 20, 160, 64


def hashes(text: str) -> np.ndarray:
    """Hashes of all words of a whole text."""
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(word_blocks(text.encode()))), np.uint64)


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs."""
    x = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 64 bits by planes of bytes, which shuffles compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, len(data) // 8).T).view(kind).ravel()


class Pack:
    """Words and pairs of some texts: distinct keys, and the place of each occurrence among them."""

    def __init__(self, texts: list[str | None]) -> None:
        found = [hashes(t or "") for t in texts]
        self.n = np.array([len(h) for h in found], np.int64)
        h = np.concatenate([np.zeros(0, np.uint64), *found])
        self.own = np.repeat(np.arange(len(found)), self.n)  # text of each word
        self.words, self.word = np.unique(h, return_inverse=True)
        self.second = np.flatnonzero(self.own[1:] == self.own[:-1]) + 1  # words with one before them
        self.pairs, self.pair = np.unique(mixed(h[self.second - 1], h[self.second]), return_inverse=True)

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words x (background, target, the same as first of a pair) and pairs x (background, target)."""

        def both(at: np.ndarray, own: np.ndarray, size: int) -> list[np.ndarray]:
            return [np.bincount(at, minlength=size), np.bincount(at[target[own]], minlength=size)]

        first = self.second - 1
        word = both(self.word, self.own, len(self.words)) + both(self.word[first], self.own[first], len(self.words))
        return np.stack(word, axis=1).astype(np.int64), np.stack(both(self.pair, self.own[self.second], len(self.pairs)), axis=1).astype(np.int64)

    def loss(self, word: np.ndarray, first: np.ndarray, pair: np.ndarray, total: int, size: int) -> np.ndarray:
        """Mean loss of each text's words under one model, whose sums come in the order of the keys; a text's first word has no word before it."""
        p = (word + 1) / (total + size)
        prob = p[self.word]
        prob[self.second] = (pair[self.pair] + STRENGTH * prob[self.second]) / (first[self.word[self.second - 1]] + STRENGTH)
        return -np.bincount(self.own, np.log(prob), len(self.n)) / self.n.clip(1)


_ASKED = "pack long, kind int, bucket int, keys binary, counts binary"
_ANSWER = "pack long, kind int, bucket int, counts binary"


def packs_of(size: int) -> int:
    """Packs of a corpus of so many bytes."""
    wanted = min(MOST, max(PACK, math.isqrt(size * ROOT)))
    return max(1, -(-size // max(1, min(wanted, -(-size // PACKS)))))


def _ask(buckets: tuple[int, int]):
    """Rows of a pack for each bucket in which it has words (kind 0) or pairs (kind 1)."""

    def run(key: tuple, docs: pa.Table, targets: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            own = set(targets.column("doc_id").to_pylist()) if targets.num_rows else ()
            pack = Pack(docs.column("text").to_pylist())
            count = pack.counts(np.array([i in own for i in docs.column("doc_id").to_pylist()], bool))
            for kind, (keys, n) in enumerate(zip((pack.words, pack.pairs), count)):
                edge = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets[kind]) >> np.uint64(32), np.arange(buckets[kind] + 1))
                for i, (a, b) in enumerate(zip(edge, edge[1:])):
                    if a < b:
                        rows.append((key[0].as_py(), kind, i, _planes(np.diff(keys[a:b], prepend=np.uint64(0))), _planes(n[a:b])))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names=["pack", "kind", "bucket", "keys", "counts"])

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """The sums of one bucket for each pack, in the order asked."""
    width = 2 if asked.column("kind")[0].as_py() else 4
    keys = [np.cumsum(_numbers(k, np.uint64), dtype=np.uint64) for k in asked.column("keys").to_pylist()]
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros((len(found), width), np.int64)
    at = np.cumsum([0, *map(len, keys)])
    for c, a, b in zip(asked.column("counts").to_pylist(), at, at[1:]):
        total[place[a:b]] += _numbers(c).reshape(-1, width)  # a pack has each key once
    out = [_planes(total[place[a:b]]) for a, b in zip(at, at[1:])]
    return pa.table([asked.column("pack"), asked.column("kind"), asked.column("bucket"), pa.array(out, pa.binary())], names=["pack", "kind", "bucket", "counts"])


def _totals(asked: pa.Table) -> pa.Table:
    """Distinct words of a bucket, and how often they occur in the background and in the target; no row for pairs."""
    rows = []
    if not asked.column("kind")[0].as_py():
        keys = [np.cumsum(_numbers(k, np.uint64), dtype=np.uint64) for k in asked.column("keys").to_pylist()]
        occur = sum(_numbers(c).reshape(-1, 4)[:, :2].sum(axis=0) for c in asked.column("counts").to_pylist())
        rows.append((len(np.unique(np.concatenate(keys))), *occur.tolist()))
    return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["size", "background", "target"])


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    if not docs.num_rows:
        n, losses = np.zeros(0, np.int64), [np.zeros(0)] * 2
        ids = pa.array([], pa.int64())
    else:
        pack = Pack(docs.column("text").to_pylist())
        rows = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds = rows.column("kind").to_pylist()
        size, *total = (rows.column(c)[-1].as_py() for c in ("size", "background", "target"))  # kind 2
        count = [_numbers(b"").reshape(-1, w) for w in (4, 2)]
        for kind, width in enumerate((4, 2)):
            parts = [_numbers(c).reshape(-1, width) for c, k in zip(rows.column("counts").to_pylist(), kinds) if k == kind]
            count[kind] = np.concatenate([count[kind], *parts])
        word, pair = count
        n, losses, ids = pack.n, [pack.loss(word[:, m], word[:, 2 + m], pair[:, m], total[m], size) for m in (1, 0)], docs.column("doc_id")
    return pa.table([ids, pa.array(n, pa.int64()), *(pa.array(x, pa.float64(), mask=n == 0) for x in losses)], names=["doc_id", "n_tokens", "loss_target", "loss_background"])


def scored(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and ce_diff for each row of docs; targets holds the ids of the target texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packs = packs_of(size)
    by_id = F.pmod(F.xxhash64("doc_id"), F.lit(packs)).alias("pack")
    # Texts without an id are dealt out by text; they are never targets.
    pack = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(packs))).otherwise(by_id).alias("pack")
    dealt = rows.select(pack, "doc_id", "text")
    own = targets.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().select(by_id, "doc_id")
    buckets = (max(1, packs // 8), packs)
    asked = dealt.groupBy("pack").cogroup(own.groupBy("pack")).applyInArrow(_ask(buckets), _ASKED)
    by_bucket = asked.groupBy("kind", "bucket")  # one exchange for both of its readers
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "background", "target")]
    total = by_bucket.applyInArrow(_totals, "size long, background long, target long").agg(*sums)
    total = total.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long"))).alias("pack"), F.lit(2).alias("kind"), F.lit(0).alias("bucket"), F.lit(b"").alias("counts"), "size", "background", "target")
    empty = [F.lit(None).cast("long").alias(c) for c in ("size", "background", "target")]
    answers = by_bucket.applyInArrow(_answer, _ANSWER).select("*", *empty).unionByName(total)
    out = dealt.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(_score, "doc_id long, n_tokens long, loss_target double, loss_background double")
    return out.withColumn("ce_diff", F.col("loss_target") - F.col("loss_background"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good and not toxic; background: all documents."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), good)
