"""Boosts and fusions of retrieval as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The (dense, sparse, token) weights by how much the graph says.
GRAPH_WEIGHTS = {"overlap": (0.3, 0.4, 0.3), "confident": (0.3, 0.3, 0.4), "strong": (0.4, 0.3, 0.3), "plain": (0.35, 0.35, 0.3)}


def traversal_boost(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 + 0.3 * score))


def temporal_boost(score: Column, same_window: Column, same_date: Column) -> Column:
    """The score, 0.2 at least where the time window is the asked one, 0.25 where the date is."""
    return F.greatest(score, F.when(same_window, 0.2).otherwise(0.0), F.when(same_date, 0.25).otherwise(0.0))


def confidence(relations: Column, overlap: Column, strength: Column) -> Column:
    """How far a memory's place in the graph is to be trusted, 1 at most."""
    part = lambda most, x: F.least(F.lit(most), x)
    return F.least(F.lit(1.0), part(0.6, 0.2 * relations) + part(0.4, 0.2 * overlap) + part(0.3, 0.3 * strength))


def graph_aware(dense: Column, sparse: Column, token: Column, overlap: Column, trust: Column, strength: Column, related: Column) -> Column:
    """Three pair scores lifted by entity overlap, trust and traversal, weighted by which of them is strong."""
    e, k, t = F.least(F.lit(0.3), 0.15 * overlap), F.least(F.lit(0.2), 0.1 * trust), F.least(F.lit(0.25), 0.12 * strength)
    lifted = (dense + e + 0.5 * k, sparse + 1.5 * e + k, token + t + 0.8 * e)
    blend = lambda kind: sum((w * x for w, x in zip(GRAPH_WEIGHTS[kind], lifted, strict=True)), F.lit(0.0))
    base = F.when(overlap > 2, blend("overlap")).when(related & (trust > 0.6), blend("confident")).when(strength > 0.7, blend("strong")).otherwise(blend("plain"))
    score = base * (1 + 0.1 * trust)
    return F.when((overlap > 1) & (trust > 0.8), F.least(F.lit(1.0), 1.1 * score)).otherwise(score)


def lexical_match(a: Column, b: Column) -> Column:
    """Sum over shared tokens of the product of their weights, of two maps from token to weight."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(F.transform(shared, lambda t: F.try_element_at(a, t) * F.try_element_at(b, t)), F.lit(0.0), lambda s, x: s + x)


def relation_score(cosine: Column, entity_words: Column, relation_words: Column) -> Column:
    """One expanded query's share in an edge's score."""
    return 0.3 * cosine + 0.2 * entity_words + 0.15 * relation_words
