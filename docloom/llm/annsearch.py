"""Approximate nearest neighbours by a permutation index.

Pivots are taken from a bounded sample of vectors, each next one the farthest from those taken, so
that a crowd of near copies gives one pivot. A vector is represented by the order of its ``POSTED``
nearest pivots; these orders are computed and written once. A block of vectors is posted in the
inverted files of its pivots, with the places in the orders. A query reads the files of its
``ASKED`` nearest pivots and ranks vectors by the footrule distance of the orders, where a pivot
that a vector doesn't list counts as one place past its list. The first ``AMPLE`` and a share of
``SHARE`` of each block, and all vectors within ``RADIUS`` of the largest footrule distance (so that
a crowd of near copies is never cut) are ranked again by the exact cosine in double precision.

Every row is indexed. Queries come in blocks of ``QUERY_BLOCK`` that are broadcast, one after the
other, to tasks that each hold some blocks of the table; tasks keep the best of each query, and the
bests are merged. Equal vectors of a block are compared once.

Defined results: rows without an id, and vectors that are null, zero or hold a null or a non-finite
component take no part; of rows with equal ids the one with the smallest vector counts; vectors are
compared with those of equal length; ties go to the smaller id; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import discard, written

PIVOTS, POSTED, ASKED, SHARE, AMPLE, RADIUS = 256, 128, 64, 0.2, 500, 0.25
#: Vectors that pivots are taken from.
PIVOT_SAMPLE = 1024
BLOCK = 16_384
QUERY_BLOCK = 16_384


def orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of the nearest ``POSTED`` pivots of each vector, nearest first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :POSTED].astype(np.uint8)


@dataclass
class PermutationIndex:
    """The inverted files of a block of distinct vectors in the order of their smallest ids."""

    vectors: np.ndarray
    order: np.ndarray

    def __post_init__(self) -> None:
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        flat = self.order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[by_pivot], np.arange(PIVOTS + 1))
        rows, places = by_pivot // self.order.shape[1], (by_pivot % self.order.shape[1]).astype(np.int32)
        self.files = [(rows[a:b], places[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def absent(self, asked: int) -> np.ndarray:
        """What a pivot at each place of a query counts in an order that lacks it."""
        return self.order.shape[1] - np.arange(asked, dtype=np.int32)

    def footrule(self, asked: np.ndarray) -> np.ndarray:
        """The distance of every row's order from a query's list of pivots."""
        absent = self.absent(len(asked))
        total = np.full(len(self.vectors), absent.sum(), np.int32)
        for place, pivot in enumerate(asked.tolist()):
            rows, places = self.files[pivot]
            total[rows] += np.abs(places - place) - absent[place]
        return total


def spread(vectors: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the unit vectors, each the least similar to those before it; no copies."""
    taken, nearest = [0], vectors @ vectors[0]
    while len(taken) < min(most, len(vectors)) and nearest.min() < 1 - 1e-9:
        taken.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[taken[-1]])
    return vectors[taken]


def usable(vector: Column) -> Column:
    """A vector as doubles, or null where it takes no part."""
    doubles = vector.cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite & F.exists(doubles, lambda x: x != 0), doubles)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def _orders_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _distinct(ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, copies: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(the smallest ``copies`` ids of each distinct vector, those vectors, their orders), by their smallest ids."""
    by_id = np.argsort(ids, kind="stable")
    ids, vectors, order = ids[by_id], np.ascontiguousarray(vectors[by_id]), order[by_id]
    keys = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    groups = np.split(np.argsort(inverse, kind="stable"), np.cumsum(np.bincount(inverse))[:-1])
    return [ids[groups[g][:copies]] for g in np.argsort(first).tolist()], vectors[np.sort(first)], order[np.sort(first)]


def _indexed(table: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``table`` (vec_id, vector) with ``order``: the numbers of each vector's nearest pivots, a byte each."""
    shared = table.sparkSession.sparkContext.broadcast(pivots)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = orders(_matrix(batch.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o.tobytes() for o in order], pa.binary())], ["vec_id", "vector", "order"])

    return table.mapInArrow(ordered, "vec_id long, vector array<double>, order binary")


def _search(table: DataFrame, part: pa.Table, k: int) -> DataFrame:
    """(query_id, vec_id, score): each task's best of one block of queries (vec_id, vector, order)."""
    shared = table.sparkSession.sparkContext.broadcast((_matrix(part.column(1)), part.column(0).to_numpy(), _orders_of(part.column(2))[:, :ASKED]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_ids, asked = shared.value
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        best: list[list[tuple[float, int]]] = [[] for _ in query_ids]
        for rows in _blocks(batches):
            copies, distinct, order = _distinct(rows.column(0).to_numpy(), _matrix(rows.column(1)), _orders_of(rows.column(2)), k + 1)
            index = PermutationIndex(distinct, order)
            kept = min(len(distinct), AMPLE - int(-SHARE * len(distinct) // 1))
            for i, own in enumerate(query_ids.tolist()):
                footrule = index.footrule(asked[i]).astype(np.int64)
                ranked = footrule * len(distinct) + np.arange(len(distinct))
                near = int((footrule <= RADIUS * index.absent(len(asked[i])).sum()).sum())
                rows = np.argpartition(ranked, max(kept, near) - 1)[: max(kept, near)]
                score = np.einsum("ij,j->i", distinct[rows], queries[i]) / (index.norms[rows] * norms[i])
                # All rows that can be among the best k + 1, ties at the last place included.
                least = np.partition(score, len(score) - min(k + 1, len(score)))[len(score) - min(k + 1, len(score))]
                near = np.flatnonzero(score >= least)
                found = [(-float(score[j]), int(x)) for j in near.tolist() for x in copies[rows[j]].tolist() if x != own]
                best[i] = sorted(best[i] + found)[:k]
        rows = [(q, x, -s) for q, pairs in zip(query_ids.tolist(), best, strict=True) for s, x in pairs]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return table.mapInArrow(searched, "query_id long, vec_id long, score double")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of up to BLOCK."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.num_rows for b in held) + batch.num_rows > BLOCK:
            yield pa.Table.from_batches(held)
            held = []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _sample(table: DataFrame, size: int) -> pa.Table:
    """The ``size`` rows (vec_id, vector) with the least hashes. Of all rows, only some four times as many are ordered."""
    rows = table.withColumn("h", F.xxhash64("vec_id"))
    share = (F.col("h") / float(1 << 64) + 0.5) * table.count()
    near = rows.where(share <= 4 * size).orderBy("h", "vec_id").limit(size)
    return near.select("vec_id", "vector").toArrow()


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row that ``is_query`` (of ``vec_id``) holds for."""
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), usable(F.col(vector_column)).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    table = written(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    found = None
    for (length,) in table.select(F.size("vector")).distinct().collect():
        alike = table.where(F.size("vector") == length)
        vectors = _matrix(_sample(alike, PIVOT_SAMPLE).column(1))
        vectors = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        index = written(_indexed(alike, spread(vectors, PIVOTS)), "orders")
        asked = index.where(is_query)
        blocks = -(-asked.count() // QUERY_BLOCK)
        for block in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").toArrow()
            if part.num_rows:
                best = written(_search(index, part, k), "nearest")
                found = best if found is None else found.unionByName(best)
        discard(index)
    discard(table)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)
