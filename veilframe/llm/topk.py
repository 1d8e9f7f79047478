"""Exact top-k by inner product with columnar branch and bound (operator 10).

A task keeps its vectors by column, block of dimensions by block. For a query it
adds up the score one block after the other, largest query mass first; after
each block the score so far plus the product of the remaining norms (Cauchy and
Schwarz) bounds what a candidate can still reach, and only candidates whose
bound reaches the k-th best score so far are kept, compacted for the next block.
Bounds only ever drop what can't be in the result, so it is exact.

Queries go to the tasks in blocks of bounded size, each block against all rows;
a task returns k rows per query, and a ranking per query merges them. Components
are scaled and floored to integers. Vectors that are null or hold a null or
non-finite component, and rows without an id, take no part; shorter vectors
(an empty one too) count as filled with zeros. Repeated rows each take part; a
query is not matched with rows of its own id. Ties go to the smaller id. Scores
are exact: where products may leave 64 bits, a chunk is scored in full in Python's
integers. A component of 2^62 or more once scaled, or a score beyond 64 bits,
stops the job with a message.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veilframe.llm import text as tx

DIMENSIONS = 16
#: Rows of a columnar chunk, and queries of a block.
CHUNK_ROWS, BLOCK_QUERIES = 8192, 4096
_FOUND = tx.struct_of(("query", T.LongType()), ("query_id", T.LongType()), ("vec_id", T.LongType()), ("score", T.LongType()))


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * component) of each component, null unless all are finite; too large a number is an error."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    fits = F.forall(doubles, lambda x: F.abs(x * scale) < 2.0**62)
    too_large = F.raise_error(F.lit("a vector component is too large for a 64-bit integer")).cast("array<bigint>")
    return F.when(finite & fits, F.transform(doubles, lambda x: F.floor(x * scale).cast("long"))).when(finite, too_large)


class Queries:
    """A block of queries: ids and an integer matrix (queries, dimensions)."""

    def __init__(self, ids: list[int], vectors: list[list[int]], k: int):
        width = max((len(v) for v in vectors), default=0)
        self.ids, self.k = np.array(ids, np.int64), k
        self.matrix = _matrix(vectors, width)

    def top(self, chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The best k (number, ids, scores) of each query over chunks of (ids, rows by dimension)."""
        n = len(self.ids)
        best_ids = [np.zeros(0, np.int64)] * n
        best_scores = [np.zeros(0, np.int64)] * n
        for ids, columns in chunks:
            layout = Columns(ids, columns)
            for q in range(n):
                least = best_scores[q][-1] if len(best_scores[q]) == self.k else None
                found, scores = layout.search(self.matrix[q], int(self.ids[q]), self.k, least)
                if len(found):
                    found, scores = np.concatenate([best_ids[q], found]), np.concatenate([best_scores[q], scores])
                    order = np.lexsort((found, -scores))[: self.k]
                    best_ids[q], best_scores[q] = found[order], scores[order]
        for q in range(n):
            yield q, best_ids[q], best_scores[q]


class Columns:
    """A chunk of vectors by dimension, with the norms of each block of dimensions."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray):
        self.ids, self.n = ids, len(ids)
        #: Products are summed in doubles while every sum is exact, else in integers.
        self.columns = columns
        self.high = int(np.abs(columns).max(initial=0))
        self.exact = columns.astype(np.float64)
        self.blocks = [slice(a, min(a + DIMENSIONS, len(columns))) for a in range(0, len(columns), DIMENSIONS)]
        self.norms = np.array([np.sqrt((self.exact[b] ** 2).sum(0)) for b in self.blocks]).reshape(len(self.blocks), self.n)
        self.sample = np.arange(min(self.n, 256))

    def search(self, query: np.ndarray, own: int, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that can be among the best k, with their scores; ``least`` is the k-th best score known."""
        depth = min(len(query), len(self.columns))
        query = np.concatenate([query[:depth], np.zeros(len(self.columns) - depth, np.int64)])
        highest = self.high * int(np.abs(query).max(initial=0)) * max(1, len(query))
        if highest >= 2**62:
            return self._wide(query, own)
        doubles = highest < 2**53
        q, data = (query.astype(np.float64), self.exact) if doubles else (query, self.columns)
        mass = np.array([np.sqrt((query[b].astype(np.float64) ** 2).sum()) for b in self.blocks])
        order = np.argsort(-mass)
        if least is None and self.n > 4 * k:
            some = self.sample[self.ids[self.sample] != own]
            if len(some) >= k:
                least = np.partition(q @ data[:, some], len(some) - k)[len(some) - k]
        alive, score = None, np.zeros(self.n, data.dtype)
        for step, b in enumerate(order):
            part = self.blocks[b]
            rows = data[part] if alive is None else data[part][:, alive]
            score = score + q[part] @ rows
            if least is None or step == len(order) - 1:
                continue
            # what the blocks after this one can still add
            rest = sum(mass[c] * (self.norms[c] if alive is None else self.norms[c][alive]) for c in order[step + 1 :])
            keep = score + rest * (1 + 1e-9) + 1e-6 >= least
            alive = np.flatnonzero(keep) if alive is None else alive[keep]
            score = score[keep]
            if not len(alive):
                break
        ids = self.ids if alive is None else self.ids[alive]
        keep = ids != own
        if least is not None:
            keep &= score >= least
        return ids[keep], score[keep].astype(np.int64)


    def _wide(self, query: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """All candidates with their scores, in integers of any size."""
        scores = query.astype(object) @ self.columns.astype(object)
        keep = self.ids != own
        if any(abs(s) >= 2**63 for s in scores[keep]):
            raise ValueError("an inner product does not fit 64 bits")
        return self.ids[keep], scores[keep].astype(np.int64)


def _matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(at, CHUNK_ROWS)
            column = part.column("vector")
            sizes = column.value_lengths().to_numpy()
            flat = column.flatten().to_numpy()
            matrix = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
            matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = flat
            yield part.column("vec_id").to_numpy(), np.ascontiguousarray(matrix.T)


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0, block: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's best k rows."""
    rows = vectors.withColumn("is_query__", is_query).select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("vector"), "is_query__")
    rows = rows.where("vec_id is not null and vector is not null")
    queries = rows.where("is_query__").select("vec_id", "vector")
    total = queries.count()
    blocks = max(1, -(-total // block))
    number = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks))
    found = None
    for b in range(blocks):
        part = sorted((r.vec_id, r.vector) for r in queries.where(number == b).collect())
        hits = rows.select("vec_id", "vector").mapInArrow(_search(Queries([i for i, _ in part], [v for _, v in part], k)), _FOUND).withColumn("block", F.lit(b))
        found = hits if found is None else found.unionByName(hits)
    order = Window.partitionBy("block", "query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(queries: Queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, ids, scores in queries.top(_chunks(batches)):
            columns = [np.full(len(ids), q), np.full(len(ids), queries.ids[q]), ids, scores]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_FOUND.names)

    return run
