"""Exact embedding near-duplicates by dual traversal of cover trees.

The tree's top is relational: vectors fall to the nearest of a bounded sample of pivots, cells have a centre and a
covering radius, and pairs of cells further apart than their radii and the threshold allow are pruned. Each pair that is
left is one task's work: it descends both cells' nested levels of halving radii, pruning pairs of nodes the same way.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components
from .simhash import Forest

#: Vectors in a cell, and pivots over all labels (about 600 bytes each, broadcast).
CELL, PIVOTS = 3000, 4096
#: Areas, about 100 bytes each, up to which their sizes are broadcast; where labels are many they meet by a shuffle.
BROADCAST_AREAS = 100_000
SLACK = 1e-9


def unit(vector) -> np.ndarray | None:
    """The vector at length one in double precision; None if it is null, empty, zero or holds a null or non-finite part."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    if not np.isfinite(v).all() or not (most := np.abs(v).max()):
        return None
    v = v / most  # neither overflow nor underflow in the squares
    return v / math.sqrt(float(v @ v))


def levels(x: np.ndarray, smallest: float):
    """Nested levels of a cover tree over the rows of ``x``: (centres, parent of each in the level before, radius that
    covers all rows below each). Radii halve from 2 down to ``smallest``; the last level is the rows themselves."""
    out = [(np.array([0]), np.array([0]))]
    near = np.zeros(len(x), np.int64)  # position in the level's centres of the one that covers each row
    r = 2.0
    while r / 2 >= smallest and len(out[-1][0]) < len(x):
        r /= 2
        centres, parents, new = [], [], np.empty(len(x), np.int64)
        for k in range(len(out[-1][0])):
            left = np.nonzero(near == k)[0]
            left = np.concatenate([[out[-1][0][k]], left[left != out[-1][0][k]]])  # a centre stays one
            while len(left):
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (x[left] @ x[left[0]])))
                inside = d <= r
                inside[0] = True
                new[left[inside]] = len(centres)
                centres.append(left[0])
                parents.append(k)
                left = left[~inside]
                if len(centres) > len(x) // 2:  # the rest hardly groups: rows are their own centres
                    for i in left:
                        new[i] = len(centres)
                        centres.append(i)
                        parents.append(k)
                    left = left[:0]
        out.append((np.array(centres), np.array(parents)))
        near = new
    # radii as they are, from each row to the centre of its node on every level
    found, at = [], near
    for centres, parents in reversed(out):
        d = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", x, x[centres[at]])))
        radius = np.zeros(len(centres))
        np.maximum.at(radius, at, d)
        found.append((centres, parents, radius))
        at = parents[at]
    return [*found[::-1], (np.arange(len(x)), near, np.zeros(len(x)))]


def links(a: np.ndarray, b: np.ndarray, least: float):
    """Boolean matrix of the rows of ``a`` and ``b`` with cosine ``least`` or more, by dual traversal."""
    far = math.sqrt(max(0.0, 2 - 2 * least))
    la, lb = levels(a, far / 2), levels(b, far / 2)
    depth = max(len(la), len(lb)) - 1
    alive = np.ones((1, 1), bool)
    for k in range(depth + 1):
        ia, ib = min(k, len(la) - 1), min(k, len(lb) - 1)
        if k:
            if ia == k:
                alive = alive[la[ia][1], :]
            if ib == k:
                alive = alive[:, lb[ib][1]]
        if not alive.any():
            return np.zeros((len(a), len(b)), bool)
        cosine = a[la[ia][0]] @ b[lb[ib][0]].T
        if ia == len(la) - 1 and ib == len(lb) - 1:
            return alive & (cosine >= least)
        d = np.sqrt(np.maximum(0.0, 2 - 2 * cosine))
        alive = alive & (d <= la[ia][2][:, None] + lb[ib][2][None, :] + far + SLACK)
    raise AssertionError


def _prepare(batches):
    for b in batches:
        out = []
        for label, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            u = unit(v) if label is not None else None
            raw = None if u is None else u.tobytes()
            out.append((None, None, None, None) if u is None else (xxhash.xxh3_128_digest(str(label).encode() + b"\0" + raw), f"{label}/{len(u)}", raw, len(u)))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary())], names=["vec_id", "h", "grp", "unit"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, cell: int = CELL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Vectors of equal, non-null label (and width) are linked at cosine ``least`` or more, in double precision. Vectors
    that :func:`unit` refuses and rows with a null label link with nothing: no links, their own component, kept. Copies
    are collapsed to one vector with a count, so their number costs nothing; a repeated id counts as a vector each time. A
    null id has a null component and a null ``kept``; a cosine of exactly ``least`` links; columns beyond the three may have
    any names. Tasks send counts and a spanning forest, never their pairs.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    each = rows.mapInArrow(_prepare, "vec_id long, h binary, grp string, unit binary")
    classes = cut(each.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("times"), F.any_value("grp").alias("grp"), F.any_value("unit").alias("unit")))
    total = classes.count()
    share = min(1.0, min(2 * total / cell, PIVOTS / 2) / max(1, total))
    hashed = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / float(1 << 30)
    pivots: dict[str, list] = {}
    for r in classes.where(hashed < share).select("grp", "unit").orderBy("grp", "h").limit(PIVOTS).collect():  # PIVOTS at most
        pivots.setdefault(r.grp, []).append(np.frombuffer(r.unit))
    tops = {g: np.stack(p) for g, p in pivots.items()}

    def settle(batches):
        for b in batches:
            at = []
            for grp, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                top = tops.get(grp)
                at.append(f"{grp}/{-1 if top is None else int((top @ np.frombuffer(raw)).argmax())}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.string())], names=["h", "grp", "unit", "times", "area"])

    placed = classes.select("h", "grp", "unit", "times").mapInArrow(settle, "h binary, grp string, unit binary, times long, area string")
    sizes = cut(placed.groupBy("area").agg(F.count("*").alias("n")))  # a row a pivot, and one a label without any
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_AREAS else sizes
    member = cut(placed.join(sizes, "area").select("h", "grp", "unit", "times", F.concat_ws("/", "area", F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / cell)).cast("string")).alias("cell")))

    def centre(table: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(u) for u in table.column("unit").to_pylist()])
        c = x.mean(axis=0)
        return pa.table({"cell": table.column("cell")[:1], "grp": table.column("grp")[:1], "centre": [c.tolist()], "radius": [float(np.sqrt(((x - c) ** 2).sum(axis=1)).max())]}, schema=pa.schema([("cell", pa.string()), ("grp", pa.string()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))

    cells = cut(member.groupBy("cell").applyInArrow(centre, "cell string, grp string, centre array<double>, radius double"))
    other = cells.select(*(F.col(c).alias(f"{c}_b") for c in cells.columns))
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "centre_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x))
    reach = math.sqrt(2 - 2 * least) + SLACK
    pairs = cells.join(other, (F.col("grp") == F.col("grp_b")) & (F.col("cell") <= F.col("cell_b"))).where(apart <= F.col("radius") + F.col("radius_b") + reach).select("cell", "cell_b")
    pairs = cut(pairs.select("cell", "cell_b", F.concat_ws("|", "cell", "cell_b").alias("pair")))
    left = pairs.select("pair", "cell", F.lit(0).alias("side")).union(pairs.where("cell <> cell_b").select("pair", F.col("cell_b").alias("cell"), F.lit(1).alias("side")))
    work = left.join(member, "cell").select("pair", "side", "h", "unit", "times")

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        h, times = table.column("h").to_pylist(), table.column("times").to_numpy()
        x = np.stack([np.frombuffer(u) for u in table.column("unit").to_pylist()])
        a, b = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        alone = not len(b)
        found = links(x[a], x[a] if alone else x[b], least)
        if alone:
            np.fill_diagonal(found, False)
            b = a
        n = np.zeros(len(h), np.int64)
        n[a] += found @ times[b]
        if not alone:
            n[b] += found.T @ times[a]
        forest = Forest(len(h))
        i, j = np.nonzero(found)
        forest.add(a[i], b[j])
        root = forest.settle()
        at = np.nonzero((n > 0) | (root != np.arange(len(h))))[0]
        return pa.table({"h": [h[k] for k in at], "n": n[at], "to": [h[root[k]] for k in at]}, schema=pa.schema([("h", pa.binary()), ("n", pa.int64()), ("to", pa.binary())]))

    met = cut(work.groupBy("pair").applyInArrow(meet, "h binary, n long, to binary"))
    reached = connected_components(met.select(F.col("h").alias("u"), F.col("to").alias("v")))
    counts = met.groupBy("h").agg(F.sum("n").alias("n"))
    named = classes.select("h", "least_id", "times").join(counts, "h", "left").join(reached, classes.h == reached.node, "left").select("h", "least_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "h").alias("root"))
    component = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = named.join(component, "root").select(F.col("h").alias("_h"), "n_links", "component_id")
    both = each.select("vec_id", "h").join(of, F.col("h") == F.col("_h"), "left")
    out = both.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
