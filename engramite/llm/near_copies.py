"""Near copies by exact word-shingle similarity, the pairs to compare found by MinHash bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, drop_dir, sliced, table, text_columns
from .components import connected_components
from .simhash import keep_least

SEED = 42
#: A pair at similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9997.
BANDS, ROWS = 20, 5
#: A band's bucket of up to FEW classes is compared pair by pair, a larger one with LEADERS of its classes and then, where
#: that left it in several components, by blocks of about BLOCK classes.
FEW, LEADERS, BLOCK = 16, 4, 256

_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_MUL = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word runs; a shorter text is one run, a text without words has none."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    spans = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in spans), np.uint64))


def bands(h: np.ndarray) -> np.ndarray:
    """One value a band: the hash of ROWS minima over the shingles."""
    if not len(h):
        return np.zeros(BANDS, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 4096):
        least = np.minimum(least, ((h[None, i : i + 4096] ^ _XOR) * _MUL).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _key(h: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, key, n, bands)``: rows with equal shingles share ``key``."""

    def run(batches):
        out = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
        for b in batches:
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            yield batch(out, b.column(0), [_key(h) for h in sets], [len(h) for h in sets], [bands(h) for h in sets])

    return docs.mapInArrow(sliced(run), "doc_id long, key long, n long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        out = pa.schema([("key", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        for b in batches:
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            yield batch(out, [_key(h) for h in sets], [h.view(np.int64) for h in sets])

    return docs.mapInArrow(sliced(run), "key long, shingles array<long>")


def _candidates(met: DataFrame) -> DataFrame:
    """``(u, v)`` once each, u < v: classes of one small bucket, or of a large one and its leaders, not too unlike in size."""
    few = met.where(F.col("members") <= FEW).select("band", "value", "key", "n")
    other = few.select("band", "value", F.col("key").alias("key2"), F.col("n").alias("n2"))
    pairs = few.join(other, ["band", "value"]).where("key < key2").select("key", "n", "key2", "n2")
    led = F.array(*(F.col(f"l{i}") for i in range(LEADERS)))
    stars = met.where(F.col("members") > FEW).select("key", "n", F.explode(led).alias("l")).select("key", "n", F.col("l.key").alias("key2"), F.col("l.n").alias("n2"))
    every = pairs.union(stars).where("key <> key2 and 5 * least(n, n2) >= 4 * greatest(n, n2)")
    return every.select(F.least("key", "key2").alias("u"), F.greatest("key", "key2").alias("v")).distinct()


def links_across(large: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(u, v)``: a link between every two components of a bucket that hold similar classes.

    ``large(band, value, key, root)`` holds the classes of large buckets and the components they are in so far,
    ``sets(key, shingles)`` their shingles. A bucket's largest component needs no comparing within itself; every class
    outside it meets every class of another component, in groups of about ``block`` by ``block`` classes. Only the
    first link found between two components is sent.
    """
    parts = large.groupBy("band", "value", "root").agg(F.count("*").alias("c"))
    main = parts.groupBy("band", "value").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("m")).where("m > top.c")
    main = main.select("band", "value", F.col("top.root").alias("main"), F.ceil(F.col("m") / block).cast("int").alias("rows"), F.ceil((F.col("m") - F.col("top.c")) / block).cast("int").alias("cols"))
    open_ = large.join(main, ["band", "value"])
    row, col = F.pmod(F.xxhash64("key"), F.col("rows")).cast("int"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("cols")).cast("int")
    held = open_.select("band", "value", "key", "root", row.alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), F.lit(False).alias("stray"))
    stray = open_.where("root <> main").select("band", "value", "key", "root", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), col.alias("col"), F.lit(True).alias("stray"))
    work = held.union(stray).join(sets, "key")

    def meet(table: pa.Table) -> pa.Table:
        stray = table.column("stray").to_numpy()
        key, root, lists = table.column("key").to_numpy(), table.column("root").to_numpy(), table.column("shingles").combine_chunks()
        held, size = np.nonzero(~stray)[0], pc.list_value_length(lists).to_numpy()
        out = {}
        if len(held):
            flat = lists.take(pa.array(held)).flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(size[held])[:-1]])
            order = np.argsort(flat, kind="stable")
            ranked = flat[order]
            for i in np.nonzero(stray)[0]:
                own = lists[int(i)].values.to_numpy()
                low, high = np.searchsorted(ranked, own, "left"), np.searchsorted(ranked, own, "right")
                at = order[np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())]
                shared = np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(held))
                for j in np.nonzero((5 * shared >= 4 * (size[i] + size[held] - shared)) & (root[held] != root[i]))[0]:
                    out.setdefault((root[i], root[held[j]]), (key[i], key[held[j]]))
        return pa.table({"u": [u for u, _ in out.values()], "v": [v for _, v in out.values()]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return work.groupBy("band", "value", "row", "col").applyInArrow(meet, "u long, v long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """``(doc_id, key, component_id)``, one row per row of ``docs``: the least id reachable over pairs whose sets of
    ``words``-word shingles have a Jaccard similarity of 0.8 or more. Pairs that share no band are not compared; of those
    that do, none is left out unless its two classes are joined already."""
    read = text_columns(docs, id_col, text_col)
    each = cut(_profiles(read, words))
    classes = cut(each.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    keyed = classes.select("key", "n", F.posexplode("bands").alias("band", "value"))
    lead = [F.min(F.struct(F.xxhash64("key", F.lit(i)).alias("h"), "key", "n")).alias(f"l{i}") for i in range(LEADERS)]
    sized = keyed.groupBy("band", "value").agg(F.count("*").alias("members"), *lead).where("members > 1")
    met, at_met = table(keyed.join(sized, ["band", "value"]), "met")
    asked, at_asked = table(_candidates(met), "asked")
    large = met.where(F.col("members") > FEW).select("band", "value", "key")
    ends, at_ends = table(asked.select(F.col("u").alias("end")).union(asked.select("v")).union(large.select("key")).distinct(), "ends")
    rows = classes.join(ends, F.col("key") == F.col("end"), "left_semi").select(F.col("least").alias("_least"))
    found = _sets(read.join(rows, F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi"), words)
    sets, at_sets = table(found.join(ends, F.col("key") == F.col("end"), "left_semi").dropDuplicates(["key"]), "sets")
    a, b = (sets.select(F.col("key").alias(e), F.col("shingles").alias(f"s{e}")) for e in "uv")
    both = asked.join(a, "u").join(b, "v").select("u", "v", F.size("su").alias("nu"), F.size("sv").alias("nv"), F.size(F.array_intersect("su", "sv")).alias("shared"))
    first = connected_components(both.where("5 * shared >= 4 * (nu + nv - shared)").select("u", "v"))
    rooted = large.join(first, F.col("key") == F.col("node"), "left").select("band", "value", "key", F.coalesce("root", "key").alias("root"))
    rooted, at_rooted = table(rooted, "rooted")
    rest = links_across(rooted, sets)
    reached = connected_components(first.select(F.col("node").alias("u"), F.col("root").alias("v")).union(rest))
    for path in (at_met, at_asked, at_ends, at_sets, at_rooted):  # the components are settled and written
        drop_dir(docs.sparkSession, path)
    named = classes.join(reached, classes.key == reached.node, "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select(F.col("key").alias("_key"), "component_id")
    return each.join(of, F.col("key") == F.col("_key"), "left").select("doc_id", "key", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """``docs`` with one document of each group, as ``simhash.keep_one``."""
    return keep_least(docs, groups(docs, id_col, text_col, words), id_col)
