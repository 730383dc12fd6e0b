"""SimHash fingerprints and their exact close pairs, found by vantage-point trees over Hamming distance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, fresh, sliced, text_columns
from .components import connected_components

SEED = 42
LEAF = 48
#: Sampled fingerprints from which the driver builds the top of the tree: a fixed bound, whatever the corpus.
SAMPLE = 8192


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits; bit b is set if it is set in over half of the shingles' hashes. No words: 0."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    spans = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in spans), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` row by row, ``fp`` the 64 bits as a signed long. Whole texts; null texts have no words."""

    def run(batches):
        out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
        for b in batches:
            yield batch(out, b.column(0), np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64))

    return text_columns(docs, id_col, text_col).mapInArrow(sliced(run), "doc_id long, fp long")


def _far(a: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(a ^ np.uint64(v)).astype(np.int16)


class Shards:
    """The top of a vantage-point tree: nodes (vantage, radius); a fingerprint lives in one leaf and visits every leaf
    whose side it is within ``near`` bits of."""

    def __init__(self, sample: np.ndarray, depth: int, near: int):
        self.depth, self.near, self.nodes = depth, near, {}
        parts = {1: sample}
        for level in range(depth):
            for node in range(1 << level, 2 << level):
                own = parts.pop(node)
                v = own[0] if len(own) else np.uint64(0)
                d = _far(own, v)
                r = int(np.median(d[1:])) if len(own) > 1 else 32
                self.nodes[node] = (int(v), r)
                parts[2 * node], parts[2 * node + 1] = own[d <= r], own[d > r]

    def route(self, fps: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, indexes, whether each is at home) over all leaves that are visited."""
        todo, out = [(1, np.arange(len(fps)), np.ones(len(fps), bool))], []
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node >= 1 << self.depth:
                out.append((node, at, home))
                continue
            v, r = self.nodes[node]
            d = _far(fps[at], v)
            low, high = d <= r + self.near, d > r - self.near
            todo += [(2 * node, at[low], home[low] & (d[low] <= r)), (2 * node + 1, at[high], home[high] & (d[high] > r))]
        return out


class Forest:
    """Union-find over positions in one shard, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.root, self.wait, self.size = np.arange(n), [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.wait.append((i, j))
        self.size += len(i)
        if self.size > 1 << 20:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.wait:
            i, j = (np.concatenate(x) for x in zip(*self.wait, strict=True))
            self.wait, self.size = [], 0
            while True:
                a, b = self.root[i], self.root[j]
                off = a != b
                if not off.any():
                    break
                i, j, a, b = i[off], j[off], a[off], b[off]
                np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
                while (again := self.root[self.root] != self.root).any():
                    self.root[again] = self.root[self.root[again]]
        return self.root


def close_pairs(fps: np.ndarray, home: np.ndarray, near: int, found) -> None:
    """Calls ``found(i, j)`` with index arrays of all pairs within ``near`` bits, i at home. Vantage-point recursion: a
    query leaves out a side when the triangle bound puts every member of it further than ``near`` away."""
    every = np.arange(len(fps))
    todo = [(every[home], every)]
    while todo:
        h, q = todo.pop()
        if not len(h) or not len(q):
            continue
        if len(h) > LEAF:
            v = fps[h[len(h) // 2]]
            dh, dq = _far(fps[h], v), _far(fps[q], v)
            r = int(np.median(dh))
            if (dh > r).any():
                todo += [(h[dh <= r], q[dq <= r + near]), (h[dh > r], q[dq > r - near])]
                continue
        step = max(1, (1 << 22) // len(h))
        for k in range(0, len(q), step):
            i, j = np.nonzero(np.bitwise_count(fps[h][:, None] ^ fps[q[k : k + step]][None, :]) <= near)
            if len(i):
                i, j = h[i], q[k + j]
                other = i != j
                found(i[other], j[other])


def link_forest(classes: DataFrame, near: int = 2, shard_rows: int = 30_000) -> DataFrame:
    """``(u, v)``: edges that connect exactly the fingerprints joined by links of ``near`` or fewer bits.

    ``classes(fp)`` holds distinct fingerprints, so copies were collapsed before. A sample of at most ``SAMPLE``
    fingerprints gives the vantage points of the top levels; every fingerprint then goes to its shard and, near a
    boundary, to the shards across it. Each shard sends a spanning forest of its links: fewer rows than members.
    """
    n = classes.count()
    depth = min(9, max(4, math.ceil(math.log2(max(1, n / shard_rows)))))
    sample = np.array([r[0] for r in classes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    shards = Shards(sample, depth, near)

    def route(batches):
        out = pa.schema([("shard", pa.int32()), ("fp", pa.int64()), ("home", pa.bool_())])
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for leaf, at, home in shards.route(fps.view(np.uint64)):
                yield batch(out, np.full(len(at), leaf, np.int32), fps[at], home)

    def search(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy()
        forest = Forest(len(fps))
        close_pairs(fps.view(np.uint64), table.column("home").to_numpy(), near, forest.add)
        root = forest.settle()
        at = np.nonzero(root != np.arange(len(fps)))[0]
        return pa.table({"u": fps[at], "v": fps[root[at]]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return classes.select("fp").mapInArrow(route, "shard int, fp long, home boolean").groupBy("shard").applyInArrow(search, "u long, v long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, near: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``.

    ``component_id`` is the least id reachable over links of ``near`` or fewer differing bits, the row's own included.
    Copies share one fingerprint and are compared once. Documents without words have fingerprint 0 and link like any
    other. A null id is nobody's least id; a group of null ids only has a null component. Repeated rows are answered
    each; an empty table gives an empty result.
    """
    each = cut(fingerprints(docs, id_col, text_col, words))
    classes = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reached = connected_components(link_forest(classes, near))
    named = classes.join(reached, classes.fp == reached.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return each.join(of, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group in ``found(doc_id, component_id)``, the one with the least id; rows with a
    null id stay. Of rows that repeat one id the one whose columns hash least stays, so that a run that is repeated gives
    the same rows. The columns of ``docs`` may have any names."""
    stay, row = fresh(docs, "stay"), fresh(docs, "row")
    least = found.where("doc_id = component_id").select(F.col("doc_id").alias(stay)).distinct()
    own = docs.where(F.col(f"`{id_col}`").isNotNull())
    kept = own.join(least, F.col(f"`{id_col}`") == F.col(stay), "left_semi")
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = kept.groupBy(F.col(f"`{id_col}`").alias(stay)).agg(F.min_by(every, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias(row))
    return one.select(f"{row}.*").unionByName(docs.where(F.col(f"`{id_col}`").isNull()))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, near: int = 2) -> DataFrame:
    """``docs`` with one document of each group, the one with the least id; rows with a null id stay; of rows that repeat
    one id, one stays."""
    return keep_least(docs, groups(docs, id_col, text_col, words, near), id_col)
