"""Queries without SQL against brute force on small tables."""

import pytest
from pyspark.sql import functions as F

from engramite.functions import scoring
from engramite.operators import graph, vector
from engramite.plans import registry


def test_fusion_adaptive_pairs_all_that_share_a_token(spark, tmp_path):
    docs = [(1, "Red apples fall"), (2, "nothing here"), (3, "who saw the RED boat"), (50, "a  boat\nunder way"), (51, ""), (52, None)]
    asked = [(1, "red boat"), (2, "Fall"), (7, "who saw it"), (50, "no match"), (51, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tokens = lambda t: set((t or "").lower().split())
    rows = [(d, i, t, q) for d, t in docs for i, q in asked if tokens(t) & tokens(q)]
    part = lambda k: F.pmod(F.xxhash64("doc_id", "item_id", F.lit(k)), F.lit(1000)) / 1000.0
    score = F.round(scoring.adaptive_fusion(F.col("query"), F.col("text"), part(1), part(2), part(3)), 6)
    want = {tuple(r) for r in spark.createDataFrame(rows, "doc_id long, item_id long, text string, query string").select("doc_id", "item_id", score).collect()}
    got = [tuple(r) for r in registry.fusion_adaptive(spark, str(tmp_path)).collect()]
    assert len(want) == len(got) == 5
    assert set(got) == want


def test_elongation_groups_of_long_words(spark, tmp_path):
    turns = [(1, 1, "so sooooooooooooo good"), (1, 2, "sooooooooooooooo hm")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.canonical, r.variants, r.total) for r in registry.elongation_groups(spark, str(tmp_path)).collect()]
    assert got == [("so", 3, 3)]


def test_distances_unsettled_raise(spark):
    chain = [(f"n{i}", "R", f"n{i + 1}", 1.0) for i in range(5)]
    edges = spark.createDataFrame(chain, "source string, relationship string, destination string, weight double")
    assert graph.distances(edges, "n0", max_rounds=6).count() == 6
    with pytest.raises(RuntimeError):
        graph.distances(edges, "n0", max_rounds=3)


def test_top_k_searches_more_queries_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 5) + 1, float(i % 3), float(i)]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.selectExpr("vec_id as qid", "embedding as query")
    want = sorted(map(tuple, vector.top_k(vectors, queries, 3).collect()))
    monkeypatch.setattr(vector, "MAX_QUERIES", 6)
    assert len(want) == 60
    assert sorted(map(tuple, vector.top_k(vectors, queries, 3).collect())) == want


def test_fusion_adaptive_joins_no_texts(spark, tmp_path):
    """A pair's text would be carried, lower-cased and split once a pair."""
    spark.createDataFrame([(1, "red boat")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "red")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def joined(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        own = [node.output().apply(i).name() for i in range(node.output().size())] if node.nodeName() == "Join" else []
        return own + [name for b in below for name in joined(b)]

    names = set(joined(registry.fusion_adaptive(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()))
    assert "doc_id" in names and not names & {"text", "query", "low", "d", "q"}


def _edges(spark, pairs):
    return spark.createDataFrame([(a, "R", b, 1.0 + i % 3) for i, (a, b) in enumerate(pairs)], "source string, relationship string, destination string, weight double")


def test_components_of_a_chain_take_one_round_and_join_what_ends_leave_apart(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    # two cliques whose only link is neither the least nor the greatest one at its ends; a loop alone is no component
    clique = lambda c: [(f"{c}{i}", f"{c}{j}") for i in range(5) for j in range(i)]
    pairs = [*chain, *clique("p"), *clique("r"), ("p2", "r2"), ("q0", "p2"), ("z", "r2"), ("r2", "a"), ("loop", "loop"), ("n004", "n003")]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def least(x):
        seen, to = {x}, [x]
        while to:
            new = near[to.pop()] - seen
            seen |= new
            to += new
        return min(seen)

    assert {r.id: r.cluster_id for r in graph.components(_edges(spark, pairs), max_rounds=2).collect()} == {x: least(x) for x in near}


def test_distances_without_paths_are_the_same(spark):
    edges = _edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a"), ("d", "e")])
    bare = graph.distances(edges, "a", paths=False)
    assert bare.columns == ["id", "dist"]
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, graph.distances(edges, "a").select("id", "dist").collect()))
