"""Exact top-k search by columnar branch and bound.

Vectors become integers, floor(256 * x). Candidates are held in vertical layout, one row of memory for each dimension. For a group of queries, partial scores
grow block of dimensions by block; after each block what is left of a score is bounded by the product of the remaining norms of
query and candidate (Cauchy-Schwarz), candidates whose upper bound is under the k-th best lower bound of every query of the group go, and the survivors are compacted
before the next block. Bounds are widened by a relative 1e-9 against rounding, scores are sums of integers and so exact.

Components too large for sums that are exact in doubles are rare: rows that hold one, and queries that hold one against all rows, are scored in doubles with an error bound first,
and those that may be among the k best again in whole numbers of any size. Other rows of the same block aren't slowed down. A score beyond the range of a long is given as
the nearest of -(2**63 - 1) and 2**63 - 1, and ranked as such.

How it is spread. Queries are a stated set, so the work is queries times rows. The queries go out in blocks of `query_block` rows and VALUES numbers at most, a
bounded broadcast each, which is destroyed once the block's result is written; each task takes its part of the candidates in blocks of `row_block` rows and VALUES numbers at most,
keeps k rows for each query, and the k best of all tasks are found by an aggregation that adds the tasks' lists up in steps of k rows.

Nulls and edge cases. Rows with a null vec_id, a null vector or one with null or non-finite components (or ones whose 256-fold isn't finite) take no part; nor do, for a query,
vectors of another length. Rows with the query's own vec_id are never its candidates. Other repeated rows are candidates each; of query
rows that repeat a vec_id the one with the smallest vector asks. Ties go to the smaller vec_id. Empty tables give an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, reread

K, EVERY, SCALE = 5, 50, 256
DIM_BLOCK, ROW_BLOCK, QUERY_BLOCK = 16, 1 << 16, 4096
#: Queries that are scored together, and the numbers that a block of rows or of queries holds at most (but one row's).
GROUP, VALUES = 32, 1 << 22
MOST = (1 << 63) - 1


def exact_limit(dims: int) -> float:
    """Integers up to here keep a sum of so many products exact in doubles."""
    return 2.0 ** ((53 - max(1, dims).bit_length()) // 2)


def whole_scores(rows: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(-score, id) of the k best rows for vectors of any size: doubles with an error bound choose whom to score in whole numbers."""
    with np.errstate(over="ignore", invalid="ignore"):
        about = rows @ q
        off = (np.abs(rows) @ np.abs(q)) * (2.0**-50 * max(1, len(q)))
        low, high = about - off, about + off
    unsure = ~(np.isfinite(low) & np.isfinite(high))
    low[unsure], high[unsure] = -np.inf, np.inf
    low, high = np.minimum(low, 2.0**63), np.clip(high, -(2.0**63), None)  # scores beyond these are equal
    if len(ids) > k:
        some = np.flatnonzero(high >= np.partition(low, len(low) - k)[len(low) - k])
    else:
        some = np.arange(len(ids))
    whole = [int(x) for x in q]
    return sorted((-max(-MOST, min(MOST, sum(a * int(b) for a, b in zip(whole, rows[i])))), int(ids[i])) for i in some)[:k]


class Columns:
    """Candidates in vertical layout, with the norm of what remains after each block of dimensions; rows with outlying components aside."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dim_block: int = DIM_BLOCK) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.limit = exact_limit(vectors.shape[1])
        out = np.abs(vectors).max(axis=1, initial=0) > self.limit
        self.out_ids, self.out_rows = ids[out], vectors[out]
        self.ids, self.columns = ids[~out], np.ascontiguousarray(vectors[~out].T)
        self.cuts = [*range(0, len(self.columns), dim_block), len(self.columns)]
        self.rest = remaining(self.columns, self.cuts)

    def search(self, query_ids: list[int], queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """(-score, id) of each query's k best rows, in order; rows surely under the query's floor may be left out."""
        floors = np.full(len(queries), -np.inf) if floors is None else floors
        plain = np.abs(queries).max(axis=1, initial=0) <= self.limit
        found: list[list[tuple[int, int]]] = [[] for _ in queries]
        at = np.flatnonzero(plain)
        for part in (at[i : i + GROUP] for i in range(0, len(at), GROUP)):
            for i, got in zip(part, self._bounded([query_ids[j] for j in part], queries[part], k, floors[part])):
                found[i] = got
        for i in range(len(queries)):
            if not plain[i]:
                found[i] += self._whole(self.columns.T, self.ids, query_ids[i], queries[i], k)
            if len(self.out_ids):
                found[i] += self._whole(self.out_rows, self.out_ids, query_ids[i], queries[i], k)
            found[i] = sorted(found[i])[:k]
        return found

    @staticmethod
    def _whole(rows: np.ndarray, ids: np.ndarray, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        other = ids != query_id
        return whole_scores(rows[other], ids[other], q, k)

    def _bounded(self, query_ids: list[int], queries: np.ndarray, k: int, floors: np.ndarray) -> list[list[tuple[int, int]]]:
        mass = remaining(np.ascontiguousarray(queries.T), self.cuts)
        at, score, floors = None, np.zeros((len(queries), len(self.ids))), floors.copy()
        for i, q in enumerate(query_ids):
            score[i, np.searchsorted(self.ids, q) : np.searchsorted(self.ids, q, side="right")] = -np.inf
        for b, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:])):
            score += queries[:, lo:hi] @ (self.columns[lo:hi] if at is None else self.columns[lo:hi, at])
            n = score.shape[1]
            if hi == self.cuts[-1] or n <= k:
                continue
            bound = mass[b + 1][:, None] * (self.rest[b + 1] if at is None else self.rest[b + 1][at]) * (1 + 1e-9) + 1e-6
            floors = np.maximum(floors, np.partition(score - bound, n - k, axis=1)[:, n - k])
            kept = np.flatnonzero((score + bound >= floors[:, None]).any(axis=0))
            if len(kept) < 0.75 * n:
                at, score = kept if at is None else at[kept], score[:, kept]
        ids, out = self.ids if at is None else self.ids[at], []
        for own, floor in zip(score, floors):
            some = np.flatnonzero((own >= floor) & (own > -np.inf))
            if len(some) > k:
                some = some[own[some] >= np.partition(own[some], len(some) - k)[len(some) - k]]
            best = some[np.lexsort((ids[some], -own[some]))[:k]]
            out.append([(-int(s), int(i)) for s, i in zip(own[best], ids[best])])
        return out


def remaining(columns: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norms of the dimensions from each cut on."""
    own = [(columns[a:b] ** 2).sum(axis=0) for a, b in zip(cuts, cuts[1:])]
    return np.sqrt(np.cumsum([np.zeros(columns.shape[1]), *own[::-1]], axis=0)[::-1])


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(SCALE * x) as doubles, of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * float(SCALE)) < float("inf")))
    return df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Blocks of about `size` rows and VALUES numbers: by vector length, the ids and the integers."""
    held: dict[int, list] = {}
    rows = values = 0
    for b in batches:
        ids = b.column(0).to_numpy()
        offsets = b.column(1).offsets.to_numpy()
        flat = np.floor(SCALE * b.column(1).values.to_numpy(zero_copy_only=False).astype(np.float64))
        length = np.diff(offsets)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            held.setdefault(int(n), []).append((ids[at], flat[offsets[at][:, None] + np.arange(n)]))
        rows, values = rows + len(ids), values + int(length.sum())
        if rows >= size or values >= VALUES:
            yield {n: tuple(map(np.concatenate, zip(*x))) for n, x in held.items()}
            held, rows, values = {}, 0, 0
    if rows:
        yield {n: tuple(map(np.concatenate, zip(*x))) for n, x in held.items()}


def _search(queries, k: int, row_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[tuple[int, np.ndarray]]] = {}
        for query_id, q in queries.value:
            asked.setdefault(len(q), []).append((query_id, q))
        groups = {n: ([i for i, _ in x], np.stack([q for _, q in x])) for n, x in asked.items()}
        best: dict[int, list[tuple[int, int]]] = {}
        for block in _blocks(batches, row_block):
            for n, (ids, vectors) in block.items():
                if n not in groups:
                    continue
                query_ids, own = groups[n]
                floors = np.array([-best[i][-1][0] if len(best.get(i, ())) == k else -np.inf for i in query_ids], np.float64)
                for i, got in zip(query_ids, Columns(ids, vectors).search(query_ids, own, k, np.nextafter(floors, -np.inf))):
                    best[i] = sorted(best.get(i, []) + got)[:k]
        rows = [(i, vec_id, -s) for i, x in best.items() for s, vec_id in x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query_id", "vec_id", "score"])

    return run


RESULT = "query_id long, rank int, vec_id long, score long"


def _best(candidates: DataFrame, held, k: int, row_block: int) -> DataFrame:
    rows = candidates.mapInArrow(_search(held, k, row_block), "query_id long, vec_id long, score long")
    # The lists of all tasks meet by query: at most k rows from each task; salted so that no query's lists meet in one step.
    entry = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))
    some = rows.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("salt")).agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("best"))
    best = some.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("i", "e")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("e.v").alias("vec_id"), (-F.col("e.s")).alias("score"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query; both sides as integers() returns them. Written block of queries by block."""
    spark, path = candidates.sparkSession, new_path(candidates.sparkSession, "topk")
    asked: list[tuple[int, np.ndarray]] = []

    def close() -> None:
        held = spark.sparkContext.broadcast(list(asked))
        _best(candidates, held, k, row_block).write.mode("append").parquet(path)
        held.destroy()
        asked.clear()

    for r in queries.groupBy("vec_id").agg(F.min("x").alias("x")).toLocalIterator():  # one partition at a time, never all queries
        asked.append((r.vec_id, np.floor(SCALE * np.array(r.x, np.float64))))
        if len(asked) >= query_block or len(asked) * len(r.x) >= VALUES:
            close()
    if asked:
        close()
    return reread(spark, path, RESULT)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows.where(F.col("vec_id") % EVERY == 0), rows)


SQL = """
WITH v AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, list_transform(min(embedding), lambda x: floor(256 * x::DOUBLE)) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
