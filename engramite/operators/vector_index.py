"""An inverted-file index over vectors: coarse centroids, a list of rows for each, and searches that read the lists nearest
to their queries. Adds and deletes are commits; compaction drops what is dead."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vector
from .versions import Versions

#: Rows the centroids are fitted on, by least hashed id; the driver holds them.
SAMPLE = 20_000
#: Lists of an index at most. Centroids are broadcast: 8 bytes a number.
MAX_LISTS = 16_384
#: Rows of a list that one file holds, and the tasks that a list is written by.
FILE_ROWS, SPLITS = 500_000, 8


def _means(x: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means of unit rows; an empty list takes the row that is farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        of, score = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        for i in np.nonzero(np.bincount(of, minlength=lists) == 0)[0]:
            far = int(score.argmin())
            sums[i], score[far] = x[far], np.inf
        c = vector.units(sums)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each row, nearest first."""
    score = x @ c.T
    near = np.argpartition(-score, min(n, len(c)) - 1, axis=1)[:, :n]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, axis=1), axis=1, kind="stable"), axis=1)


class VectorIndex:
    """Cosine search over ``(vec_id, embedding)`` in ``root``, a folder that driver and executors share.

    Every row with an id and a vector of the index's width, null and zero vectors aside, lies in the list of its nearest
    centroid. A row is alive while no later commit has deleted or replaced its id. Equal ids within one add are all kept;
    columns beyond the two are not."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Versions(spark, root)

    def build(self, vectors: DataFrame, lists: int = 64, rounds: int = 12, sample: int = SAMPLE, seed: int = 42) -> None:
        """Fit centroids on the ``sample`` rows of least hashed id and index all rows, in place of what was there."""
        if lists > MAX_LISTS:
            raise ValueError(f"at most {MAX_LISTS} lists")
        rows = self._rows(vectors)
        chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
        width = max((len(v) for v in chosen.column(1).to_pylist()), default=0)
        x = vector.units(vector.matrix(chosen.column(1), width)[0])
        x = np.unique(x[np.abs(x).sum(axis=1) > 0], axis=0)
        centroids = _means(x, min(lists, len(x)), rounds, seed) if len(x) else np.zeros((0, width))
        with self.store.change("build") as change:
            change.replace("centroids", self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centroids)], "list int, centroid array<double>"))
            change.replace("rows", self._assigned(rows, centroids, change.base + 1), by=("list",), max_rows=FILE_ROWS)
            change.empty("dead", "vec_id long, seq long")

    def add(self, vectors: DataFrame) -> None:
        """Index more rows; those whose id is there already take its place."""
        rows, centroids = self._rows(vectors), self.centroids()
        with self.store.change("add") as change:
            change.append("rows", self._assigned(rows, centroids, change.base + 1), by=("list",), max_rows=FILE_ROWS)
            change.append("dead", self._killed(rows, change.base))

    def delete(self, ids: DataFrame) -> None:
        """Forget the rows of ``ids(vec_id)``."""
        with self.store.change("delete") as change:
            change.append("dead", self._killed(ids, change.base + 1))

    def wipe(self) -> None:
        """No rows; the centroids stay for what is added next."""
        with self.store.change("wipe") as change:
            change.clear("rows")
            change.clear("dead")

    def compact(self) -> None:
        """Write the rows that are alive anew, a few files a list, and forget what was dead. Centroids stay."""
        with self.store.change("compact") as change:
            change.replace("rows", self._spread(self._alive()), by=("list",), max_rows=FILE_ROWS)
            change.clear("dead")

    def rebuild(self, lists: int = 64, **fit) -> None:
        """Fit anew on the rows that are alive: for when the data has drifted from the centroids."""
        self.build(self._alive().select("vec_id", "embedding"), lists, **fit)

    def centroids(self) -> np.ndarray:
        rows = self.store.read("centroids").orderBy("list").collect()
        return np.array([r.centroid for r in rows]) if rows else np.zeros((0, 0))

    def rows(self, version: int | None = None) -> DataFrame:
        """(vec_id, embedding): the unit vectors that are alive."""
        return self._alive(version).select("vec_id", "embedding")

    def search(self, queries: DataFrame, k: int, probes: int = 8, exclude_self: bool = True) -> DataFrame:
        """(qid, vec_id, score, rank): the k best by cosine among the rows in the ``probes`` lists nearest to each of
        ``queries(qid, query)``; scores are exact.

        Lists that no query probes are pruned at the scan. A block of queries (``vector.MAX_QUERIES``) is broadcast with
        its probes; each task multiplies a list's rows with the queries that probe it and keeps k a query and batch, so
        rows of the index are never shuffled. Queries of another width, null or zero have no result."""
        n = queries.count()
        blocks = max(1, -(-2 * n // vector.MAX_QUERIES)) if n > vector.MAX_QUERIES else 1
        found = None
        for i in range(blocks):
            part = self._search(queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) if blocks > 1 else queries, k, probes, exclude_self)
            found = part if found is None else found.unionByName(part)
        return found

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.95, sample: int = 200) -> int:
        """The least number of lists to probe, by doubling, at which ``sample`` of the queries find ``recall`` of their k
        nearest. The sample is compared with all rows."""
        asked = queries.orderBy(F.xxhash64("qid")).limit(sample).cache()
        want = vector.top_k(self.rows(), asked, k).select("qid", "vec_id").cache()
        most, probes = len(self.centroids()), 1
        total = want.count()
        while probes < most and self.search(asked, k, probes).join(want, ["qid", "vec_id"], "left_semi").count() < recall * total:
            probes *= 2
        asked.unpersist()
        want.unpersist()
        return min(probes, max(1, most))

    # parts

    def _rows(self, vectors: DataFrame) -> DataFrame:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")

    def _assigned(self, rows: DataFrame, centroids: np.ndarray, seq: int) -> DataFrame:
        sent, width = self.spark.sparkContext.broadcast(centroids), centroids.shape[1]

        def run(batches):
            for b in batches:
                x, at = vector.matrix(b.column(1), width)
                x = vector.units(x)
                some = np.abs(x).sum(axis=1) > 0
                x, at = x[some], at[some]
                if len(at) and len(sent.value):
                    flat = pa.array(x.astype(np.float64).ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width), pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), lists, pa.array(_nearest(x, sent.value, 1)[:, 0].astype(np.int32))], names=["vec_id", "embedding", "list"])

        found = rows.mapInArrow(run, "vec_id long, embedding array<double>, list int")
        return self._spread(found.select("vec_id", "embedding", F.lit(seq).cast("long").alias("seq"), "list"))

    def _spread(self, rows: DataFrame) -> DataFrame:
        """Rows of a list together, a large list over several tasks."""
        return rows.select("vec_id", "embedding", "seq", "list").repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(SPLITS)))

    def _killed(self, ids: DataFrame, seq: int) -> DataFrame:
        return ids.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(seq).cast("long").alias("seq")).where("vec_id is not null").distinct()

    def _alive(self, version: int | None = None) -> DataFrame:
        rows, dead = self.store.read("rows", version), self.store.read("dead", version)
        if not self.store.manifest(version)["tables"]["dead"]["folders"]:
            return rows
        last = dead.groupBy("vec_id").agg(F.max("seq").alias("until"))
        return rows.join(last, "vec_id", "left").where("until is null or seq > until").drop("until")

    def _search(self, queries: DataFrame, k: int, probes: int, exclude_self: bool) -> DataFrame:
        centroids, asked = self.centroids(), vector.asked(queries, "cosine")
        use = (np.abs(asked.q).sum(axis=1) > 0) if len(centroids) and asked.width == centroids.shape[1] else np.zeros(len(asked.ids), bool)
        ids, q = asked.ids[use], asked.q[use]
        probed = _nearest(q, centroids, min(probes, len(centroids))) if len(ids) else np.zeros((0, 0), int)
        wanted = sorted({int(x) for x in probed.ravel()})
        sent = self.spark.sparkContext.broadcast((ids, q, {x: np.nonzero((probed == x).any(axis=1))[0] for x in wanted}))

        def run(batches):
            known, every, of = sent.value
            for b in batches:
                x = vector.matrix(b.column(1), every.shape[1])[0]
                rows, lists = b.column(0).to_numpy(), b.column(2).to_numpy()
                for one in np.unique(lists):
                    here = lists == one
                    score, own, asking = np.round(x[here] @ every[of[one]].T, vector.PLACES) + 0.0, rows[here], known[of[one]]
                    for j, qid in enumerate(asking):
                        other = own != qid if exclude_self else np.ones(len(own), bool)
                        best = vector.best_of(score[other, j], own[other], k)
                        if len(best):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), qid)), pa.array(own[other][best]), pa.array(score[other, j][best])], schema=vector.FOUND)

        read = self._alive().where(F.col("list").isin(wanted)).select("vec_id", "embedding", "list")
        return vector.ranked(read.mapInArrow(vector.gathered(run), "qid long, vec_id long, score double"), k)
