"""Ranked retrieval: candidates from vectors and graph, their features, and the context built from them. All queries of a
batch go together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from . import graph, vector


def candidates(hits: DataFrame, linked: DataFrame) -> DataFrame:
    """(qid, memory_id, similarity, boost): vector hits ``(qid, memory_id, score)`` and graph-linked ones ``(qid, memory_id,
    boost)`` together, each memory once a query with the greatest of either."""
    a = hits.select("qid", "memory_id", F.col("score").alias("similarity"), F.lit(0.0).alias("boost"))
    b = linked.select("qid", "memory_id", F.lit(0.0).alias("similarity"), "boost")
    return a.unionByName(b).groupBy("qid", "memory_id").agg(F.max("similarity").alias("similarity"), F.max("boost").alias("boost"))


def linked(asked: DataFrame, index: DataFrame, timed: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(qid, memory_id): the memories of ``index(memory_id, entity)`` that share an entity with ``asked(qid, entity)`` and are
    among ``hits(qid, memory_id)`` or can be among a query's ``k`` best by :func:`hybrid` at one boost for all; no memory is
    linked with a query of its own id.

    Without words of their own, memories with the same entities that both carry a time or don't differ by nothing but their
    ids, so of those only the first ``k``, and one more for the query's own, are met: pairs grow with the queries and the
    sets of entities, not with queries times memories."""
    sets = index.groupBy("memory_id").agg(F.array_sort(F.collect_list("entity")).alias("entities"))  # a memory's entities
    kinds = sets.join(timed.select("memory_id").distinct().withColumn("timed", F.lit(True)), "memory_id", "left")
    place = F.row_number().over(Window.partitionBy("entities", "timed").orderBy("memory_id"))
    first = kinds.withColumn("place", place).where(F.col("place") <= k + 1).select("memory_id", F.explode(F.array_distinct("entities")).alias("entity"))
    met = asked.join(first, "entity").select("qid", "memory_id")
    found = hits.select("qid", "memory_id").join(index, "memory_id").join(asked, ["qid", "entity"], "left_semi").select("qid", "memory_id")
    return met.union(found).where("qid <> memory_id").distinct()


def hybrid(found: DataFrame, asked: DataFrame, index: DataFrame, degrees: DataFrame, timed: DataFrame, k: int) -> DataFrame:
    """(qid, memory_id, score, rank): the k best candidates by the hybrid score, without words.

    Overlap is how many of ``asked(qid, entity)`` are among a memory's entities in ``index(memory_id, entity)``, evidence
    0.02 a neighbour up to five of each entity in ``degrees(entity, degree)``, ``timed(memory_id)`` the memories that
    carry a time."""
    names = found.select("qid", "memory_id").join(index, "memory_id")
    wanted = asked.select("qid", "entity").distinct().withColumn("hit", F.lit(1))
    shared = names.join(wanted, ["qid", "entity"], "left").join(degrees, "entity", "left").groupBy("qid", "memory_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("overlap"), F.sum(0.02 * F.least(F.coalesce("degree", F.lit(0)), F.lit(5))).alias("evidence"))
    full = found.join(shared, ["qid", "memory_id"], "left").join(timed.select("memory_id").distinct().withColumn("timed", F.lit(True)), "memory_id", "left")
    return best_hybrid(full.withColumn("lexical", F.lit(0.0)), k)


def best_hybrid(full: DataFrame, k: int) -> DataFrame:
    """(qid, memory_id, score, rank): the ``k`` best a question of ``full(qid, memory_id, similarity, boost, overlap, timed, evidence,
    lexical)``. A candidate's similarity is its boost where that is greater. Ties go to the lesser id."""
    none = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    score = scoring.hybrid(F.greatest("similarity", "boost"), none("overlap", 0), none("timed", False), none("evidence", 0.0), none("lexical", 0.0))
    ranked = full.select("qid", "memory_id", F.round(score, 6).alias("score"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "memory_id"))).where(F.col("rank") <= k)


def expansion(near: DataFrame, words: DataFrame, own: DataFrame, least: float, most: float, top: int) -> DataFrame:
    """(qid, word, score): words of memories that are alike but not the same, most alike first; words of three letters or
    fewer and the query's own are left out."""
    fit = near.where((F.col("score") > least) & (F.col("score") < most))
    said = fit.join(words.where("char_length(word) > 3"), "memory_id").groupBy("qid", "word").agg(F.max("score").alias("score"))
    fresh = said.join(own.select("qid", "word").distinct(), ["qid", "word"], "left_anti")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "word"))
    return fresh.withColumn("place", place).where(F.col("place") <= top)


def context(results: DataFrame, lines: DataFrame, most: int) -> DataFrame:
    """(qid, context): per query the edge lines of its first ``most`` results, then their texts, each line once, by rank."""
    kept = results.where(F.col("rank") <= most)
    edges = kept.join(lines, "memory_id").select("qid", "rank", F.lit(0).alias("part"), "line")
    texts = kept.select("qid", "rank", F.lit(1).alias("part"), F.col("text").alias("line"))
    once = edges.unionByName(texts).where("line is not null").groupBy("qid", "line").agg(F.min(F.struct("rank", "part")).alias("at"))
    said = once.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))  # ``most`` results' lines
    return said.select("qid", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))


def diverse(items: DataFrame, most: int = 2) -> DataFrame:
    """``items(qid, item, kind, score, n_edges, n_chains, entities)`` picked greedily per query: by score, edges and chains;
    memories beyond ``most`` are passed over, as is what shares an entity with the chosen at a score under 0.7 once two are
    chosen; at 2 * ``most`` it ends. A query's items are few: candidates of one ranked list."""

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        chosen, met, memories = [], set(), 0
        for r in group.sort_values(["score", "n_edges", "n_chains", "item"], ascending=[False, False, False, True], kind="stable").itertuples():
            if len(chosen) >= 2 * most:
                break
            if r.kind == "memory" and memories >= most or len(chosen) >= 2 and r.score < 0.7 and met & {*r.entities}:
                continue
            chosen.append((r.qid, r.item, len(chosen) + 1))
            met |= {*r.entities}
            memories += r.kind == "memory"
        return pd.DataFrame(chosen, columns=["qid", "item", "place"])

    return items.groupBy("qid").applyInPandas(pick, "qid long, item long, place long")


def lsh_top_k(vectors: DataFrame, queries: DataFrame, k: int, bits: int = 4, tables: int = 16, seed: int = 42) -> DataFrame:
    """(qid, vec_id, score, rank): the k best by cosine among the vectors that fall on the same side of ``bits`` random
    planes as the query in one of ``tables`` tables; every row is indexed.

    Two vectors at angle a share a table with probability (1 - a / pi) ** bits. More bits are faster and miss more: vectors
    without close neighbours, such as random ones, need few. Scores of what is met are exact."""
    width = vectors.select(F.max(F.size("embedding"))).first()[0] or 1
    planes = np.random.default_rng(seed).standard_normal((width, tables * bits))
    weights = (1 << np.arange(bits)).astype(np.int64)

    def sides(x: np.ndarray) -> np.ndarray:
        return ((x @ planes > 0).reshape(-1, tables, bits) * weights).sum(axis=2)

    def near(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        a, b = sides(x), sides(q)
        met = np.zeros((len(x), len(q)), bool)
        for t in range(tables):
            met |= a[:, t, None] == b[None, :, t]
        return met

    # few bits leave a large part of all pairs: they are met in the task that holds the vector, by a block of queries at once
    fit = lambda frame, c: frame.where(F.size(c) == width)
    return vector.top_k(fit(vectors, "embedding"), fit(queries, "query"), k, near=near)


def outcome(skipped, n_related, n_entities, n_payloads):
    """How a graph-first search ends: the gate's reason, vector_fallback, no_entities, relations_only, or ranked."""
    return F.coalesce(skipped, F.when((n_related == 0) & (n_entities > 0), "vector_fallback").when(n_related == 0, "no_entities").when(n_payloads == 0, "relations_only").otherwise("ranked"))
