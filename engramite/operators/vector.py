"""Exact vector search and near-duplicate probes."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one search, broadcast. More are searched in blocks of about half this size.
MAX_QUERIES = 10_000
#: Queries multiplied with a batch of rows at once: its scores take 8 bytes a row and query of this many.
BLOCK = 512
#: Rows multiplied with a block at once, 16 MB of scores whatever a batch holds.
ROWS = 4096
#: Decimals a score is rounded to, so that equal vectors tie wherever they lie in a batch.
PLACES = 12


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that hold ``width`` numbers, as doubles, and where they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    if column.flatten().null_count:
        fits = pa.array([bool(f) and None not in x for f, x in zip(fits.to_pylist(), column.to_pylist(), strict=True)], pa.bool_())
    rows = np.nonzero(fits.to_numpy(zero_copy_only=False))[0]
    kept = column.filter(fits) if len(rows) < len(column) else column
    return kept.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), width), rows


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row, or one that holds no finite length, is zero."""
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.isfinite(n) & (n > 0), x / n, 0.0)


class Queries:
    """The queries of one search, ready to be multiplied with batches of vectors."""

    def __init__(self, found: pa.Table, metric: str):
        lengths = pc.list_value_length(found.column(1).combine_chunks())
        self.width, self.metric = (pc.max(lengths).as_py() or 0), metric
        q, rows = matrix(found.column(1), self.width)
        if metric == "cosine":  # a query of another width is like nothing
            every = np.zeros((found.num_rows, self.width))
            every[rows] = units(q)
            q, rows = every, np.arange(found.num_rows)
        self.ids, self.q = np.array(found.column(0).to_pylist(), np.int64)[rows], q

    def scores(self, x: np.ndarray, at: slice) -> np.ndarray:
        """A row a vector, a column a query; the more the better."""
        q = self.q[at]
        if self.metric == "l2":
            return -np.round(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * (x @ q.T)), PLACES)
        return np.round(x @ q.T, PLACES) + 0.0

    def vectors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x, rows = matrix(column, self.width)
        if self.metric != "cosine":
            return x, rows
        every = np.zeros((len(column), self.width))
        every[rows] = units(x)
        return every, np.arange(len(column))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` greatest scores, ties to the lesser id, in order."""
    near = np.arange(len(scores))
    if len(scores) > k:
        near = np.nonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])[0]
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


class Best:
    """The ``k`` best of each query among all rows that a task has seen, so that nothing but these leaves it."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n

    def take(self, at: int, scores: np.ndarray, ids: np.ndarray, may: np.ndarray) -> None:
        """A row a vector, a column a query from ``at`` on; ``may`` says which count."""
        may &= scores >= self.least[None, at : at + scores.shape[1]]
        for j in np.nonzero(may.any(axis=0))[0]:
            rows = np.nonzero(may[:, j])[0]
            s, i = scores[rows, j], ids[rows]
            if self.held[at + j] is not None:
                s, i = np.concatenate((self.held[at + j][0], s)), np.concatenate((self.held[at + j][1], i))
            best = best_of(s, i, self.k)
            self.held[at + j] = s[best], i[best]
            if len(best) == self.k:
                self.least[at + j] = s[best[-1]]

    def batches(self, qids: np.ndarray):
        for at in range(0, len(qids), BLOCK):
            held = [(qid, *h) for qid, h in zip(qids[at : at + BLOCK], self.held[at : at + BLOCK], strict=True) if h is not None]
            if held:
                qid = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(np.concatenate([h[2] for h in held])), pa.array(np.concatenate([h[1] for h in held]))], schema=FOUND)


FOUND = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = True, near=None) -> DataFrame:
    """(qid, vec_id, score, rank): the k best of ``vectors(vec_id, embedding)`` for each of ``queries(qid, query)``.

    A block of queries is broadcast; each task multiplies it with its rows and keeps the k best a query, and only those are
    shuffled. Metadata filters go on ``vectors`` first. ``l2`` scores are squared distances,
    least first; ties go to the lesser id, scores being rounded to 12 places. A vector that is null, zero, of another
    width than the queries or holds a null scores 0 by cosine and is left out by the other metrics; null ids are left out.
    ``near(x, q)``, a table of a row a vector and a column a query, says which may be found by which.
    """
    n = queries.count()
    if n > MAX_QUERIES:
        blocks = math.ceil(2 * n / MAX_QUERIES)
        block = F.pmod(F.xxhash64("qid"), F.lit(blocks))
        return reduce(DataFrame.unionByName, (_top_k(vectors, queries.where(block == i), k, metric, exclude_self, near) for i in range(blocks)))
    return _top_k(vectors, queries, k, metric, exclude_self, near)


def asked(queries: DataFrame, metric: str) -> Queries:
    """The queries in the driver; at most a block of them."""
    rows = queries.select(F.col("qid").cast("long").alias("qid"), F.col("query").cast("array<double>").alias("query")).where("qid is not null")
    return Queries(rows.toArrow(), metric)


def _top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str, exclude_self: bool, near=None) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(asked(queries, metric))

    def run(batches):
        q = sent.value
        best = Best(len(q.ids), k)
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            x, rows = q.vectors(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)[rows]
            for start in range(0, len(q.ids) if len(rows) else 0, BLOCK):
                at = slice(start, start + BLOCK)
                may = np.ones((len(ids), len(q.ids[at])), bool) if near is None else near(x, q.q[at])
                if exclude_self:
                    may = may & (ids[:, None] != q.ids[None, at])
                best.take(start, q.scores(x, at), ids, may)
        yield from best.batches(q.ids)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    return ranked(rows.mapInArrow(run, "qid long, vec_id long, score double"), k, metric)


def gathered(run, rows: int = 20_000):
    """``run``'s small batches put together."""

    def over(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return over


def ranked(found: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The ``k`` best rows of ``found(qid, vec_id, score)`` a query, with their rank."""
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.withColumn("score", F.abs("score")) if metric == "l2" else best


def nearest_merge(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(qid, into, score): queries whose nearest vector is at cosine ``least`` or more are merged into it, others inserted."""
    best = top_k(vectors, queries, 1)
    return best.select("qid", F.when(F.col("score") >= least, F.col("vec_id")).alias("into"), "score")


def upsert(current: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """Rows of ``new`` replace those of ``current`` with the same key."""
    return current.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(current: DataFrame, keys: DataFrame, key: str = "vec_id") -> DataFrame:
    return current.join(keys.select(key), key, "left_anti")
