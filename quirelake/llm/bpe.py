"""Byte-level BPE encoding and decoding.

The merging is done by the tokenizers library over Arrow batches. A text is first cut where a match of the pattern surely begins: before a space that is followed by a character
other than white space, before what follows white space, and between a leading run of Latin letters or digits and an ASCII sign; matches never cross such a place, so the pieces can be encoded one by one, each match of the pattern in
them separately, and pieces met again come from a bounded table of the worker. These cuts hold for the pattern of vocabulary() alone; with any other pattern whole texts are encoded. Ids are turned back through the reversed byte table: a token's characters
stand for bytes, the bytes of all tokens are joined and only the joined bytes are read as UTF-8, so characters split between tokens come back whole.

Vocabulary and merges come from the rank file, whose path is a parameter; merges are restored from the ranks: the two parts of a token are those at which merging by rank of its bytes stops just before it.

Nulls and edge cases. A null text is encoded as an empty one: no tokens. Special tokens' strings in a text are ordinary text. Texts of any length are encoded whole. Repeated rows each get
their row. An empty table gives an empty result. Columns other than id and text aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces that a worker keeps: half of them new or met since the last time the table was full, half from before that.
PIECES = 200_000
#: Characters with the Unicode property White_Space (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
#: Letters and digits of Latin texts: all of them letters or numbers to the pattern, in any version of Unicode (fixed values).
_LATIN = "0-9A-Za-zÀ-ÖØ-öø-ɏ"
_ASCII_SIGN = r"!-/:-@\[-`{-~"
_PIECE = re.compile(f" ?(?:[{_LATIN}]++(?![^{WHITE}{_ASCII_SIGN}])|[^{WHITE}]+)|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 characters for themselves, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that the last merge of a token joins."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= ranks[token]:
            raise ValueError(f"no merges lead to {token!r}")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Bpe:
    """Encoder and decoder of one vocabulary, with its table of pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        shown = byte_characters()
        as_text = lambda b: "".join(shown[x] for x in b)
        vocab = {as_text(t): i for t, i in ranks.items()}
        merges = [tuple(map(as_text, merge_pair(t, ranks))) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
        self.tokenizer = Tokenizer(models.BPE(vocab, merges, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        byte = {c: b for b, c in enumerate(shown)}
        self.bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in t)
        self.cuts = pattern == known_pattern()
        self.held: dict[str, tuple[tuple[int, ...], str]] = {}
        self.before: dict[str, tuple[tuple[int, ...], str]] = {}

    def forget(self) -> None:
        self.held, self.before = {}, {}

    def pieces(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """(ids, the ids as text) of each piece of a whole text."""
        if not self.cuts:
            ids = tuple(self.tokenizer.encode(text, add_special_tokens=False).ids)
            return [(ids, " ".join(map(str, ids)))] if ids else []
        found = _PIECE.findall(text)
        new = set(found).difference(self.held)
        if len(self.held) + len(new) > PIECES // 2:
            self.held, self.before = {}, self.held
            new = set(found)
        held, before = self.held, self.before
        if known := [p for p in new if p in before]:
            held.update((p, before[p]) for p in known)
            new.difference_update(known)
        if new:
            new = list(new)
            for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                ids = e.ids
                held[p] = tuple(ids), " ".join(map(str, ids))
        return [held[p] for p in found]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(x[0] for x in self.pieces(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def offsets(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Characters [start, end) that each token covers, in part or whole; a split character belongs to all tokens that hold a byte of it."""
        ends = np.cumsum([len(self.bytes[i]) for i in ids], dtype=np.int64)
        data = np.frombuffer(self.decode(ids), np.uint8)
        begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before each byte
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        inside = np.append((data & 0xC0) == 0x80, False)  # a byte that goes on with a character
        return begun[starts] - inside[starts], begun[ends]


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def known_pattern() -> str | None:
    """The pattern that _PIECE was made for, where its library is there."""
    try:
        import public_tokenizers
    except ImportError:
        return None
    return public_tokenizers.PATTERN


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _encode(path: str, pattern: str, with_offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for b in batches:
            ids = [coder.encode(t.as_py() or "") for t in b.column(1)]
            cols = [b.column(0), pa.array(ids, pa.list_(pa.int32()))]
            names = ["doc_id", "ids"]
            if with_offsets:
                both = [coder.offsets(x) for x in ids]
                cols += [pa.array([x[i].tolist() for x in both], pa.list_(pa.int32())) for i in (0, 1)]
                names += ["starts", "ends"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def encoded(docs: DataFrame, path: str, pattern: str, with_offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and, if asked for, the tokens' character offsets starts and ends, for each row of docs."""
    more = ", starts array<int>, ends array<int>" if with_offsets else ""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(path, pattern, with_offsets), f"doc_id long, ids array<int>{more}")


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for b in batches:
            texts = [coder.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of encoded rows (doc_id, ids)."""
    return rows.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(_decode(path, pattern), "doc_id long, text string")


def _digests(path: str, pattern: str):
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                pieces = coder.pieces(t.as_py() or "")
                ids = list(chain.from_iterable(x[0] for x in pieces))
                n.append(len(ids))
                ids_sha.append(sha(" ".join([x[1] for x in pieces]).encode()))
                text_sha.append(sha(coder.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        coder.forget()  # the worker lives on for other stages

    return run


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and digest of each text's ids, and digest of the bytes that they decode to."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary())
