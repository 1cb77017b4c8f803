"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within `distance` differing bits are linked; linked fingerprints form components.

How the index is laid out. The 64 bits are cut into blocks; two fingerprints that differ in at most 3 bits agree in all
but 3 of the blocks at least. For each choice of blocks that may agree, the bits of these blocks are the mask of an upper
node, and the fingerprints that share the masked pattern hang below it. A node's members are sorted by Gray rank and cut
into windows; each window becomes a node that holds the bits in which all its members agree and that no node above holds
already, and windows of windows follow up to the root. A search starts with no difference, adds the differing bits of each
node that it enters and leaves a node, with all below it, once the sum is over the distance. At the leaves the sum is
the exact distance, so no link is lost and none is false.

Upper nodes with very many members (near copies of one text) are not worked on in one task: their members go on
to the next, finer cut into blocks, which leaves fewer free bits below a node: 32 bits at first, then 24, then 12, where a node
can't have over 4096 members whatever the data are.

Nulls and edge cases. A null or empty text, and one without words, has fingerprint zero, which links like any other. A text
of one or two words is one shingle. Rows with a null doc_id get a result row; they never name a component, which is null
if no member has an id. Repeated rows and repeated ids each get their row. An empty table gives an empty result. Other columns of the
input are neither read nor returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, word_blocks, written
from .components import connected_components

BITS, DISTANCE = 64, 3
#: Cuts into blocks, coarse to fine.
CUTS = (6, 8, 16)
#: Members of an upper node from which on they go to the next cut.
LARGE = 2000
WINDOW = 16


def shingle_blocks(data: bytes, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of the word shingles (repeats included) of UTF-8 text, block by block; bytes.lower() lower-cases A-Z alone."""
    none, carry = True, []
    for words in word_blocks(data.lower()):
        words = carry + words
        n = len(words) - width + 1
        if n > 0:
            none = False
            yield np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(width)))), repeat(seed)), np.uint64, n)
        carry = words[-(width - 1) :] if width > 1 else []
    if none and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), seed)], np.uint64)


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, lowest first."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def majority(ones: np.ndarray, total: int) -> int:
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of UTF-8 text."""
    ones, total = np.zeros(64, np.int64), 0
    for h in shingle_blocks(data, width, seed):
        ones += bit_sums(h)
        total += len(h)
    return majority(ones, total)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = [fingerprint(t.encode()) if t else 0 for t in map(lambda x: x.as_py(), b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """Masks of the upper nodes: all choices of blocks but `distance`, each as its bits."""
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [sum(c) for c in combinations(block, blocks - distance)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence: the prefix XOR of its bits. Codes of several words (a column each) go on over the words, highest first."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    if x.ndim > 1:
        odd = np.cumsum(x & np.uint64(1), axis=1)[:, :-1] & np.uint64(1)  # whether the words before have an odd number of bits
        x[:, 1:] ^= np.uint64(0) - odd
    return x


class GrayIndex:
    """Hierarchical index over the distinct codes of one upper node whose masked bits are known to agree. A code is a number, or a row of several words."""

    def __init__(self, codes: np.ndarray, known: int = 0, window: int = WINDOW) -> None:
        rank = gray_rank(codes)
        self.order = np.argsort(rank) if codes.ndim == 1 else np.lexsort(rank.T[::-1])
        self.codes, self.window = codes[self.order], window
        rows = self.codes.reshape(len(codes), -1)
        same = [np.full(rows.shape, np.uint64(0xFFFFFFFFFFFFFFFF))]  # by level, leaves first: bits in which all below agree
        pattern = [rows]
        while len(pattern[-1]) > 1:
            starts = np.arange(0, len(pattern[-1]), window)
            one = np.bitwise_and.reduceat(pattern[-1] & same[-1], starts)
            zero = np.bitwise_and.reduceat(~pattern[-1] & same[-1], starts)
            same.append(one | zero)
            pattern.append(one)
        same.append(np.full((1, rows.shape[1]), known, np.uint64))
        #: What a node adds to its parent's mask.
        self.own = [same[k] & ~same[k + 1][np.arange(len(same[k])) // window if k + 2 < len(same) else np.zeros(len(same[k]), int)] for k in range(len(same) - 1)]
        self.pattern = pattern

    def near(self, queries: np.ndarray, distance: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (query, code) and distance of all pairs within `distance` where the code's place is over floor[query]."""
        queries = queries.reshape(len(queries), -1)
        top = len(self.pattern) - 1
        q, node, acc = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for k in range(top, -1, -1):
            if k < top:  # enter the children
                n = len(self.pattern[k])
                q, acc = np.repeat(q, self.window), np.repeat(acc, self.window)
                node = (node[:, None] * self.window + np.arange(self.window)).ravel()
                keep = node < n
                q, acc, node = q[keep], acc[keep], node[keep]
            keep = (node + 1) * self.window**k - 1 > floor[q]
            q, acc, node = q[keep], acc[keep], node[keep]
            acc = acc + np.bitwise_count((queries[q] ^ self.pattern[k][node]) & self.own[k][node]).sum(axis=1, dtype=np.int64)
            keep = acc <= distance
            q, acc, node = q[keep], acc[keep], node[keep]
        return q, node, acc

    def search(self, queries: np.ndarray, distance: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """near() without the distances."""
        return self.near(queries, distance, floor)[:2]

    def links(self, distance: int = DISTANCE, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links among the codes: at most one row for each code, never all pairs."""
        parent = list(range(len(self.codes)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for at in range(0, len(self.codes), chunk):
            here = np.arange(at, min(at + chunk, len(self.codes)))
            q, node = self.search(self.codes[here], distance, here)
            for a, b in zip((q + at).tolist(), node.tolist()):
                if (x := root(a)) != (y := root(b)):
                    parent[max(x, y)] = min(x, y)
        up = np.array([root(i) for i in range(len(parent))])
        far = np.flatnonzero(up != np.arange(len(up)))
        return self.codes[up[far]], self.codes[far]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _group_links(mask: list[int], distance: int):
    """Links of the members of each upper node; rows come sorted by (node, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_key = None

        def close() -> pa.RecordBatch | None:
            codes = np.unique(np.concatenate(held))
            if len(codes) < 2:
                return None
            a, b = GrayIndex(codes, mask[held_key[0]]).links(distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=_LINK) if len(a) else None

        for batch in batches:
            node, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            key = fp & np.array(mask, np.uint64)[node]
            cut = np.flatnonzero((node[1:] != node[:-1]) | (key[1:] != key[:-1])) + 1
            edges = [0, *cut.tolist(), len(node)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                this = (int(node[i]), int(key[i]))
                if this != held_key:
                    if held and sum(map(len, held)) > 1 and (out := close()) is not None:
                        yield out
                    held, held_key = [], this
                held.append(fp[i:j])
        if held and sum(map(len, held)) > 1 and (out := close()) is not None:
            yield out

    return run


def links(codes: DataFrame, distance: int = DISTANCE, cuts: tuple[int, ...] = CUTS, large: int = LARGE) -> DataFrame:
    """(a, b): links among the distinct codes in column fp, as a spanning forest for each upper node. Written in the shared folder."""
    found = []
    for level, blocks in enumerate(cuts):
        mask = masks(blocks, distance)
        signed = [m - (1 << 64) if m >> 63 else m for m in mask]
        node = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("node"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"), F.col("fp").alias("fp")) for i, m in enumerate(signed)])).alias("x")
        rows = codes.select(node).select("x.*")
        size = rows.groupBy("node", "key").count().where("count > 1")
        size = written(size, "nodes")
        hot = size.where(F.col("count") > large) if level + 1 < len(cuts) else None
        member = rows.join(size.where(F.col("count") <= large) if hot is not None else size, ["node", "key"], "left_semi")
        member = member.repartition("node", "key").sortWithinPartitions("node", "key").select("node", "fp")
        found.append(written(member.mapInArrow(_group_links(mask, distance), "a long, b long"), "links"))
        if hot is None or not hot.take(1):
            break
        codes = written(rows.join(hot, ["node", "key"], "left_semi").select("fp").distinct(), "codes")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def classes(rows: DataFrame, distance: int = DISTANCE, cuts: tuple[int, ...] = CUTS, large: int = LARGE) -> DataFrame:
    """fp, root and component_id for each distinct fingerprint of rows (doc_id, fp); written. root names the class even where component_id is null."""
    codes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "codes")
    found = links(codes.select("fp"), distance, cuts, large)
    root = connected_components(found)  # node, root
    joined = written(codes.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "codes")
    drop(codes)
    smallest = written(joined.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
    return written(joined.join(smallest, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, cuts: tuple[int, ...] = CUTS, large: int = LARGE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) for each row of docs."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    named = classes(rows, distance, cuts, large)
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
