"""Rolling exact median and median absolute deviation of many series over a time window: equal-count time chunks, each
with a copied halo of one window before it, and a sliding sorted list in blocks of about the square root of its size."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

#: Keys sampled to cut the chunks: as many as this, or this many a chunk where that is more. The driver sorts them.
SAMPLE, SAMPLE_A_CHUNK = 20_000, 16
#: A chunk holds a quarter of its halo at least, so that no row is copied to many chunks.
HALO_SHARE = 4
#: A block is split beyond this or twice the square root of the list's size, whichever is more.
LEAST_BLOCK = 1024


class SortedBlocks:
    """A sorted multiset of numbers: blocks of about the square root of its size, found by their greatest numbers."""

    def __init__(self):
        self.blocks, self.tops, self.n, self.ends = [[]], [], 0, None

    def __len__(self) -> int:
        return self.n

    def add(self, v) -> None:
        self.n, self.ends = self.n + 1, None
        if not self.tops:
            self.blocks, self.tops = [[v]], [v]
            return
        at = min(bisect_left(self.tops, v), len(self.tops) - 1)
        block = self.blocks[at]
        insort(block, v)
        self.tops[at] = block[-1]
        if len(block) > LEAST_BLOCK and len(block) > 2 * isqrt(self.n):
            half = len(block) // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]
            self.tops[at : at + 1] = [block[half - 1], block[-1]]

    def remove(self, v) -> None:
        self.n, self.ends = self.n - 1, None
        at = bisect_left(self.tops, v)
        block = self.blocks[at]
        del block[bisect_left(block, v)]
        if block:
            self.tops[at] = block[-1]
        elif len(self.blocks) > 1:
            del self.blocks[at], self.tops[at]
        else:
            self.tops = []
        if len(self.blocks) > 8 and len(self.blocks) > 4 * isqrt(self.n):  # it shrank: fewer, fuller blocks
            every, step = [x for b in self.blocks for x in b], max(LEAST_BLOCK // 2, isqrt(self.n))
            self.blocks = [every[i : i + step] for i in range(0, len(every), step)] or [[]]
            self.tops = [b[-1] for b in self.blocks if b]

    def __getitem__(self, rank: int):
        if self.ends is None:
            self.ends = list(accumulate(map(len, self.blocks)))
        at = bisect_right(self.ends, rank)
        return self.blocks[at][rank - self.ends[at]]

    def ranks(self):
        """Something to index by rank: the list itself while it is one block."""
        return self.blocks[0] if len(self.blocks) == 1 else self


def doubled_median(s: SortedBlocks):
    a, n = s.ranks(), len(s)
    return a[(n - 1) // 2] + a[n // 2]


def doubled_spread(s: SortedBlocks, median2):
    """The doubled median of ``|2 * x - median2|``: its k-th least value over the two sorted sides of the median. The k
    nearest numbers are neighbours in the list; a bisection over where they begin finds them."""
    a, n = s.ranks(), len(s)
    k = (n + 1) // 2
    low, high = 0, n - k
    while low < high:
        mid = (low + high) // 2
        if a[mid] + a[mid + k] >= median2:
            high = mid
        else:
            low = mid + 1
    kth = max(median2 - 2 * a[low], 2 * a[low + k - 1] - median2)
    if n % 2:
        return 2 * kth
    sides = [median2 - 2 * a[low - 1]] if low else []
    if low + k < n:
        sides.append(2 * a[low + k] - median2)
    return kth + min(sides)


def cut_points(keys: list[tuple], chunks: int, window: int) -> list[tuple]:
    """Where chunks begin: evenly spaced among the sorted sampled ``keys`` (series, time), never twice at one key, and
    only where a chunk has gathered its share of the rows in the window before the next."""
    keys = sorted(keys, key=_order)
    order = [_order(k) for k in keys]
    points, last = [], 0
    for i in range(1, chunks):
        at = i * len(keys) // chunks
        if at <= last or at >= len(keys):
            continue
        series, t = keys[at]
        halo = at - bisect_left(order, _order((series, t - window)))
        if HALO_SHARE * (at - last) >= halo and (not points or _order(points[-1]) < order[at]):
            points.append(keys[at])
            last = at
    return points


def _order(key: tuple) -> tuple:
    return (key[0] is not None, key[0] or "", key[1])


CHUNKED = "chunk int, own boolean, id long, series string, t long, v long"


def _chunked(points: list[tuple], window: int, id_type: pa.DataType):
    """Each row to its own chunk, and a copy of its value to each later chunk that begins within one window."""
    first: dict[str | None, tuple[int, np.ndarray]] = {}
    for i, (series, t) in enumerate(points):
        first.setdefault(series, (i, []))[1].append(t)
    first = {s: (i, np.array(ts, np.int64)) for s, (i, ts) in first.items()}
    starts = [_order((s, -(2**63))) for s, _ in points]
    out = pa.schema([("chunk", pa.int32()), ("own", pa.bool_()), ("id", id_type), ("series", pa.string()), ("t", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for b in batches:
            ids, series, v = b.column(0), b.column(1), b.column(3)
            t = b.column(2).cast(pa.int64()).to_numpy(zero_copy_only=False)
            coded = series.dictionary_encode()
            codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            own, upto = np.empty(len(t), np.int32), np.empty(len(t), np.int32)
            for code in np.unique(codes):
                name, rows = (None if code < 0 else coded.dictionary[int(code)].as_py()), np.nonzero(codes == code)[0]
                base, ts = first.get(name) or (bisect_left(starts, _order((name, -(2**63)))), np.empty(0, np.int64))
                own[rows] = base + np.searchsorted(ts, t[rows], "right")
                upto[rows] = base + np.searchsorted(ts, t[rows] + window, "right")
            yield batch(out, own, np.ones(len(t), bool), ids, series, t, v)
            more = np.where(v.is_valid().to_numpy(zero_copy_only=False), upto - own, 0)
            if more.any():
                rows = np.repeat(np.arange(len(t)), more)
                step = np.arange(len(rows)) - np.repeat(np.cumsum(more) - more, more) + 1
                yield batch(out, own[rows] + step, np.zeros(len(rows), bool), pa.nulls(len(rows), id_type), series.take(pa.array(rows)), t[rows], v.take(pa.array(rows)))

    return run


FOUND = "series string, n long, median2 long, mad4 long, far boolean"


def _slide(window: int, id_type: pa.DataType, rows: int = 8192):
    """Streams a chunk sorted by series and time. Held at once: the window's values, each in the blocks and in the queue
    of those that will leave, and the rows of one instant."""
    out = pa.schema([("id", id_type), ("series", pa.string()), ("n", pa.int64()), ("median2", pa.int64()), ("mad4", pa.int64()), ("far", pa.bool_())])

    def run(batches):
        held, leaving, done, series, now, instant = SortedBlocks(), deque(), [], None, None, []

        def settle():
            while leaving and leaving[0][0] < now - window:
                held.remove(leaving.popleft()[1])
            mine = False
            for own, _, v in instant:
                mine |= own
                if v is not None:
                    held.add(v)
                    leaving.append((now, v))
            if not mine:
                return
            n, median2, mad4 = len(held), None, None
            if n >= 2:
                median2 = doubled_median(held)
                mad4 = doubled_spread(held, median2)
            for own, key, v in instant:
                if own:
                    done.append((key, series, n, median2, mad4, None if v is None or n < 2 else 2 * abs(2 * v - median2) > 3 * mad4))

        for b in batches:
            for own, key, s, t, v in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                if t != now or s != series:
                    settle() if instant else None
                    instant.clear()
                    if s != series:
                        held, leaving = SortedBlocks(), deque()
                    series, now = s, t
                    if len(done) >= rows:
                        yield batch(out, *zip(*done, strict=True))
                        done.clear()
                instant.append((own, key, v))
        settle() if instant else None
        if done:
            yield batch(out, *zip(*done, strict=True))

    return run


def rolling_median(rows: DataFrame, id_col: str, time_col: str, value_col: str, series_col: str, minutes: int = 60, scale: int = 100) -> DataFrame:
    """``(id, series, n, median2, mad4, far)``: a row for each id of ``rows`` with a time, under the names ``id_col`` and
    ``series_col``.

    Values are floor(scale * value + 0.5). The window of a row holds the values of its series (null is a series) at times
    from ``minutes`` before its own to its own, all rows at its own time included, to the microsecond and without a zone.
    ``n`` counts them; ``median2`` is their doubled median, ``mad4`` the doubled median of ``|2 * v - median2|``, ``far``
    whether ``2 * |2 * v - median2| > 3 * mad4`` for the row's own v. With n below 2 the three are null; ``far`` is too
    for a row without a value. Null, NaN and infinite values are none.

    An id counts once: of its rows that with the least time (nulls last), then series and value. Rows whose null id
    repeats are one id too. Rows without a time are left out after that. Ids are integers; series are read as text; equal
    values of different ids all count; an empty table gives no rows; other columns may have any names.

    Two shuffles: by id, with a combine in the tasks, and to the chunks. Chunks are cut by a bounded sample of (series,
    time), as many as the session has shuffle partitions, and hold a quarter of the window before them at least: where
    one window holds a large part of all rows, chunks are fewer, and a task holds the values of one window whatever the
    cut. Only the sampled keys go to the driver.
    """
    spark, window = rows.sparkSession, minutes * 60_000_000
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(f"`{value_col}`").cast("double")
    cents = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.floor(value * scale + 0.5))
    read = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{series_col}`").cast("string").alias("series"), F.col(f"`{time_col}`").alias("t"), cents.alias("v"))
    timed, most = read.where("t is not null").select("series", "t"), max(SAMPLE, SAMPLE_A_CHUNK * chunks)
    sample = timed.sample(min(1.0, most / max(1, rows.count())), seed=7).toArrow()
    points = cut_points(list(zip(sample.column(0).to_pylist(), sample.column(1).cast(pa.int64()).to_pylist(), strict=True)), chunks, window)
    once = read.groupBy("id").agg(F.min(F.struct(F.col("t").isNull().alias("late"), "t", "series", "v")).alias("r")).select("id", "r.series", "r.t", "r.v").where("t is not null")
    chunked = once.mapInArrow(_chunked(points, window, pa.int64()), CHUNKED)
    sorted_ = chunked.repartitionById(chunks, F.col("chunk")).sortWithinPartitions("series", "t")
    found = sorted_.mapInArrow(_slide(window, pa.int64()), f"id long, {FOUND}")
    return found.select(F.col("id").alias(id_col), F.col("series").alias(series_col), "n", "median2", "mad4", "far")
