"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_dir, table


def _star(directed: DataFrame) -> DataFrame:
    """For each u, its least neighbour or itself, next to every edge. The minimum is combined before it is dealt, and the
    join's exchange is one that Spark splits where a hub holds many edges."""
    least = directed.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    return directed.join(least, F.col("u") == F.col("w")).select("u", "v", F.least("m", "u").alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` (any orderable type, either direction, repeats and loops allowed) to ``(node, root)``.

    ``root`` is the least node reachable. Nodes without an edge to another node don't appear; null ends are
    ignored; an empty input gives an empty result. Each round is two map-side combined minima and joins, its result
    written to the shared folder, where it replaces the round's before. No group is ever collected.
    """
    now, path = table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "round")
    before = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        last = path
        now, path = table(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "round")
        drop_dir(now.sparkSession, last)
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = sign
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def merged(*groups: DataFrame) -> DataFrame:
    """``(doc_id, component_id)`` over the links of several tables of that form: the least id reachable through any."""
    own = [g.where("doc_id <> component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")) for g in groups]
    reached = connected_components(reduce(DataFrame.union, own))
    ids = groups[0].select("doc_id").distinct()
    return ids.join(reached, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))
