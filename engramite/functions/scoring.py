"""Vector arithmetic and ranking formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the hybrid score.
WEIGHTS = {"similarity": 0.6, "overlap": 0.2, "recency": 0.15, "evidence": 0.05, "lexical": 0.2}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def padded(v: Column, width: int) -> Column:
    """Cut or zero-filled to ``width``; null gives zeros."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return F.slice(F.concat(F.coalesce(v.cast("array<double>"), F.array().cast("array<double>")), zeros), 1, width)


def unit(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def hybrid(similarity: Column, overlap: Column, has_time: Column, evidence: Column, lexical: Column) -> Column:
    """Weighted blend; overlap saturates at three shared entities, evidence at one."""
    w = WEIGHTS
    return w["similarity"] * similarity + w["overlap"] * F.least(F.lit(1.0), overlap / 3) + w["recency"] * F.when(has_time, 0.5).otherwise(0.0) + w["evidence"] * F.least(F.lit(1.0), evidence) + w["lexical"] * lexical


def blended(original: Column, quality: Column, overlap: Column) -> Column:
    """More graph where the context is good: weight on the original of 0.25, 0.4, 0.6 or 0.8."""
    keep = F.when((overlap > 1) & (quality > 0.7), 0.25).when((overlap > 0) & (quality > 0.4), 0.4).when(quality > 0.2, 0.6).otherwise(0.8)
    return keep * original + (1 - keep) * quality


#: Words of factual and of conceptual queries (as substrings), and the (dense, sparse, token) weights by kind.
FACTUAL = ("who", "what", "when", "where", "which")
CONCEPTUAL = ("how", "why", "explain", "describe", "about")
KIND_WEIGHTS = {"factual": (0.3, 0.5, 0.2), "conceptual": (0.6, 0.2, 0.2), "short": (0.3, 0.3, 0.4), "long": (0.5, 0.3, 0.2), "balanced": (0.4, 0.3, 0.3)}


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a plain column would be evaluated again wherever it stands."""
    return F.transform(F.array(value), body)[0]


def fusion_words(c: Column) -> Column:
    """The words of a lower-cased text, repeats included."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def asks(query: Column) -> Column:
    """What a lower-cased query asks for: (factual, conceptual)."""
    contains_any = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(query, w))
    return F.struct(contains_any(FACTUAL).alias("factual"), contains_any(CONCEPTUAL).alias("conceptual"))


def adaptive_fusion(query: Column, doc: Column, dense: Column, sparse: Column, token: Column) -> Column:
    """Query-adaptive blend of three pair scores, negative ones taken as 0 (a power of them has no real value)."""
    # lower-cased and split once a pair
    read = F.struct(F.lower(query).alias("query"), F.lower(doc).alias("doc"))
    words = lambda x: F.struct(x["query"].alias("query"), x["doc"].alias("doc"), fusion_words(x["query"]).alias("q"), fusion_words(x["doc"]).alias("d"))

    def told(x: Column) -> Column:
        exact = F.exists(x["q"], lambda w: F.contains(x["doc"], w))
        return F.struct(asks(x["query"]).alias("asks"), F.size(x["q"]).alias("n"), F.size(F.array_intersect(x["q"], x["d"])).alias("shared"), exact.alias("exact"), F.size(x["d"]).alias("length"))

    return _bound(_bound(_bound(read, words), told), lambda x: adaptive_fusion_of(x["asks"], x["n"], x["shared"], x["exact"], x["length"], dense, sparse, token))


def adaptive_fusion_of(asks: Column, n: Column, shared: Column, exact: Column, length: Column, dense: Column, sparse: Column, token: Column) -> Column:
    """:func:`adaptive_fusion` of what is known of a pair without its texts: what the query asks for and its number of words,
    how many different ones the document shares, whether it holds any, and its length in words."""
    overlap = shared / F.greatest(n, F.lit(1))
    kind = F.when(asks["factual"] & (overlap > 0.3), "factual").when(asks["conceptual"], "conceptual").when(n <= 3, "short").when(n > 8, "long").otherwise("balanced")
    read = F.struct(kind.alias("kind"), overlap.alias("overlap"), exact.alias("exact"), length.alias("length"), *(F.greatest(F.lit(0.0), c).alias(k) for c, k in ((dense, "d"), (sparse, "s"), (token, "t"))))

    def weights(x: Column) -> Column:
        base = [F.element_at(F.create_map(*(F.lit(v) for k, w in KIND_WEIGHTS.items() for v in (k, w[i]))), x["kind"]) for i in range(3)]
        s1 = F.when(x["exact"], F.least(F.lit(0.6), base[1] + 0.2)).otherwise(base[1])
        d1 = F.when(x["exact"], F.greatest(F.lit(0.2), base[0] - 0.1)).otherwise(base[0])
        apart = (x["overlap"] < 0.1) & (x["d"] > 0.7)
        return F.struct(F.when(apart, F.least(F.lit(0.7), d1 + 0.2)).otherwise(d1).alias("d"), F.when(apart, F.greatest(F.lit(0.1), s1 - 0.1)).otherwise(s1).alias("s"), base[2].alias("t"))

    def fused(x: Column, w: Column) -> Column:
        pairs = [(x[k], w[k]) for k in "dst"]
        linear = sum((v * f for v, f in pairs), F.lit(0.0))
        most = F.greatest(*(v * f for v, f in pairs))
        geometric = pairs[0][0] ** pairs[0][1] * pairs[1][0] ** pairs[1][1] * pairs[2][0] ** pairs[2][1]
        present = sum((F.when(v > 0, 1).otherwise(0) for v, _ in pairs), F.lit(0))
        harmonic = F.coalesce(F.try_divide(present.cast("double"), sum((F.when(v > 0, f / v).otherwise(0.0) for v, f in pairs), F.lit(0.0))), F.lit(0.0))
        best = F.greatest(x["d"], x["s"], x["t"])
        return F.when(x["overlap"] > 0.5, 0.7 * linear + 0.3 * most).when(best > 0.8, 0.6 * linear + 0.4 * most).otherwise(0.5 * linear + 0.3 * geometric + 0.2 * harmonic)

    def boosted(x: Column, score: Column) -> Column:
        once = F.when(F.greatest(x["d"], x["s"], x["t"]) > 0.85, F.least(F.lit(1.0), score * 1.1)).otherwise(score)
        return F.when((x["length"] > 10) & (once > 0.6), F.least(F.lit(1.0), once * 1.05)).otherwise(once)

    return _bound(read, lambda x: _bound(_bound(weights(x), lambda w: fused(x, w)), lambda score: boosted(x, score)))
